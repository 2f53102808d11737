import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest

from redactory.llm.queries import op1_sharding
from redactory.llm.sharding import row_size, shuffle_into_shards, write_shards
from tests.llm.common import edge_rows


def test_rows_law_and_gapless_slots(spark):
    df = spark.range(1000).selectExpr("id AS doc_id", "repeat('x', int(id % 50)) AS text")
    rows = shuffle_into_shards(df, 24, bucket_bytes=4096).collect()
    count = Counter(r.shard for r in rows)
    assert len(rows) == 1000 and set(count) == set(range(24)) and max(count.values()) - min(count.values()) <= 1
    for s in range(24):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.slot, r.shard))]
    assert order != sorted(order)
    again = {(r.doc_id, r.shard, r.slot) for r in shuffle_into_shards(df.repartition(7), 24, bucket_bytes=4096).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in rows}
    assert again != {(r.doc_id, r.shard, r.slot) for r in shuffle_into_shards(df, 24, seed=18, bucket_bytes=4096).collect()}


def test_edges_and_clashing_columns(spark):
    df = spark.createDataFrame([(*r, 9, 9) for r in edge_rows()], "doc_id long, text string, shard int, slot int")
    rows = shuffle_into_shards(df, 3, bucket_bytes=64).collect()
    assert len(rows) == len(edge_rows()) and sorted(Counter(r.shard for r in rows).values()) == [3, 3, 4]
    assert shuffle_into_shards(df.limit(0), 3).count() == 0
    sizes = {r.doc_id: r.n for r in df.select("doc_id", row_size(df.text).alias("n")).collect()}
    assert sizes[1] == 8 and sizes[7] == 9 and sizes[2] == 8


def test_written_shards_keep_their_order(spark, tmp_path):
    df = spark.range(2000).selectExpr("id AS doc_id", "'t' AS text")
    write_shards(shuffle_into_shards(df, 4), str(tmp_path / "out"), width=60)
    want = {s: [r.doc_id for r in shuffle_into_shards(df, 4).where(f"shard = {s}").orderBy("slot").collect()] for s in range(4)}
    for s in range(4):
        files = sorted((tmp_path / "out" / f"shard={s}").glob("*.parquet"))
        read = [x for f in files for x in pq.read_table(f)["doc_id"].to_pylist()]
        assert len(files) >= 500 // 60 and read == want[s]


def test_names_in_use_are_refused(spark):
    with pytest.raises(ValueError, match="_start"):
        shuffle_into_shards(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, _start int"), 2)


def test_query_is_a_permutation_of_the_table(spark, sf):
    out = op1_sharding(spark, sf).collect()
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in out) == sorted(docs)
    assert all(r["size"] == len(docs[r.doc_id]) + 8 and r.text_crc32 == zlib.crc32(docs[r.doc_id]) and r.law == "rows" and r.grown_shard is None for r in out)
    assert sorted((r.slot, r.shard) for r in out) == [divmod(i, 24) for i in range(len(out))]
