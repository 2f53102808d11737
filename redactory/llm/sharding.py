"""Sharding by a two-pass external shuffle.

Pass 1 scatters rows uniformly over memory-sized buckets with a seeded hash.
Pass 2 Fisher-Yates shuffles each bucket in memory and deals it out. A prefix
sum over bucket counts turns (bucket, place in bucket) into one position of a
uniform random permutation, so shard = position mod n and slot = position div n:
shard sizes are at most one row apart (the ``rows`` law) and slots are gapless.

Nulls, ties, repeats: a null text or id hashes as a null; rows equal in id and
text are dealt separately, each with its own slot (they share a bucket). An
empty table gives an empty result. A very long text makes its bucket larger, not
wrong. Other columns pass through untouched; columns of the input named shard or
slot are replaced, and ``_bucket`` and ``_start`` are refused.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redactory.llm.common import materialise

BUCKET_BYTES = 8 << 20
#: Hash cells, runs of which make up a bucket; and most tasks of the second pass.
CELLS, TASKS = 1 << 24, 20_000
_OWN = ("_bucket", "_start")


def row_size(text) -> F.Column:
    """Bytes a record takes: UTF-8 length (null: none) plus an 8-byte id."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def _prefix_sums(counts: DataFrame) -> DataFrame:
    """(_of, _start): rows in all earlier buckets. Two levels, so that no
    task sees more than 1024 buckets or one row for each 1024 of them."""
    block = F.expr("_bucket div 1024")
    within = Window.partitionBy("_block").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy(block.alias("_block")).agg(F.sum("_n").alias("_total"))
    blocks = blocks.select("_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inner = counts.withColumn("_block", block).withColumn("_inner", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    return inner.join(blocks, "_block").select(F.col("_bucket").alias("_of"), (F.col("_base") + F.col("_inner")).alias("_start"))


def shuffle_into_shards(docs: DataFrame, n_shards: int, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with ``shard`` int and ``slot`` long: a seeded uniform shuffle."""
    if clash := set(_OWN) & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} must be renamed first")
    cell = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(F.col(text_col))), F.lit(CELLS))
    # one pass for sizes and counts; it is read again, so it must not change
    cells = materialise(docs.groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"), F.sum(row_size(F.col(text_col))).alias("_bytes")), "cells")
    n_buckets = max(1, math.ceil((cells.agg(F.sum("_bytes")).first()[0] or 0) / bucket_bytes))
    bucket = lambda cell: (F.shiftrightunsigned(cell * n_buckets, 24)).cast("int").alias("_bucket")
    scattered = docs.drop("shard", "slot").select("*", bucket(cell)).repartition(min(n_buckets, TASKS), "_bucket")
    starts = _prefix_sums(cells.groupBy(bucket(F.col("_cell"))).agg(F.sum("_n").alias("_n"))).repartition(min(n_buckets, TASKS), "_of")
    out = T.StructType([*(f for f in scattered.schema.fields if f.name not in _OWN), T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    # a task that is run again may get its rows in another order: these columns put them in one
    ties = [f.name for f in out.fields if pa.types.is_primitive(_arrow(f.dataType)) or isinstance(f.dataType, T.StringType)]
    ties = [c for c in ties if c not in ("shard", "slot")]

    def deal(key, rows: pa.Table, start: pa.Table) -> pa.Table:
        rows = rows.drop_columns([c for c in _OWN if c in rows.column_names])
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ties])) if ties else rows
        order = np.arange(rows.num_rows)
        np.random.Generator(np.random.PCG64([seed, key[0].as_py()])).shuffle(order)  # Fisher-Yates
        position = start["_start"][0].as_py() + np.arange(rows.num_rows)
        rows = rows.take(pa.array(order))
        return rows.append_column("shard", pa.array(position % n_shards, pa.int32())).append_column("slot", pa.array(position // n_shards, pa.int64()))

    return scattered.groupBy("_bucket").cogroup(starts.groupBy("_of")).applyInArrow(deal, out)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def write_shards(sharded: DataFrame, path: str, width: int = 1 << 16) -> None:
    """One folder per shard, rows in slot order; a shard is cut into files of at
    most ``width`` rows, whose names keep the order."""
    piece = F.expr(f"slot div {width}")
    ranged = sharded.withColumn("_piece", piece).repartitionByRange(F.col("shard"), F.col("_piece"))
    ranged.sortWithinPartitions("shard", "slot").drop("_piece").write.partitionBy("shard").option("maxRecordsPerFile", width).parquet(path)
