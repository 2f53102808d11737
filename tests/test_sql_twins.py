"""Queries and their SQL on rows that the tables hold too rarely."""

import duckdb

from redactory.plans import queries as Q


def both(spark, tmp_path, name, texts):
    """The rows of the query and of its SQL over a documents table of ``texts``."""
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as db:
        db.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        sql = db.sql(Q.SQL[name])
        got = Q.QUERIES[name](spark, str(tmp_path)).select(*sql.columns)
        return sorted(tuple(r) for r in got.collect()), sorted(sql.fetchall())


def test_org_suffix_ends_before_what_follows(spark, tmp_path):
    texts = ["Consolidated, Inc. of Kent", "Consolidated Incorporated", "Consolidated L.L.C.; Brotherhood co", "Consolidated S.A. and", "Consolidated\x0bInc.", "no"]
    got, want = both(spark, tmp_path, "e5_extend_org_suffix", texts)
    assert got == want
    assert got[0] == (0, 0, 18)


def test_address_begins_at_a_number_before_it(spark, tmp_path):
    texts = ["room 8973\nThan the hall.", "plain", "Location: Kent, Surrey\nmore", "see 12\x0bThan."]
    got, want = both(spark, tmp_path, "r16_scan_address", texts)
    assert got == want
    assert ("8973\nThan the hall.\nat 1 Evergreen Terrace, Springfield, IL 62704") in [r[4] for r in got]
