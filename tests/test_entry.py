"""The entry file: every query has its columns, and the SQL names are queries."""

import __spark_entry__


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "n_redactions", "n_entities", "redacted_text"] and df.count() > 0


def test_names():
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and len(found) > 100


def test_a_sample_against_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    for t in "documents pages conversations events orders benchmark labels".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for name in ("r1_scan_email", "w1_merge_overlaps", "e11_apply_replacements", "e9_make_chunks", "a5_score_sets", "x6_cluster_key", "s2_stitch_parts", "j3_overlap_join"):
        want = con.sql(sql[name]).df()
        got = found[name](spark, sf).toPandas()[list(want.columns)]
        assert sorted(map(str, got.itertuples(index=False))) == sorted(map(str, want.itertuples(index=False))), name
