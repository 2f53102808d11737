"""Jaccard join of documents on word n-grams by prefix filtering.

Shingles of a text are ordered rare first, by their frequency over all documents.
Two sets of sizes m and n with similarity t or more share at least a = t / (1 + t) *
(m + n) shingles, so one shingle of each text's prefix, its m - ceil(t m) + 1 rarest.

1. A pass over all documents counts shingles in ``SLOTS`` slots; the order is by the
   count of a shingle's slot, then by its hash. The counts have a fixed size.
2. A second pass writes each text's size, set fingerprints and prefix. Texts with
   equal sets are one node from here on.
3. Nodes are joined on prefix shingles. Pairs are dropped by the length filter, by
   the positional filter (what is left of the two sets from the shared shingle on is
   less than a) and by the suffix filter (the parts of both sets between some of
   their shingles differ in size too much). Each pair left is verified once, on
   full sets.
4. A bucket of more than ``large`` nodes does not emit all its pairs: its pivot is
   compared with the others, and what then still stands in different components is
   compared as in ``neardup.linked``; no link between different texts is lost.

Nulls, ties, repeats: a null or wordless text has the empty set and is linked with
nothing; a text of fewer words than a shingle is one shingle. A row without an id
keeps a null component. Rows that repeat an id are returned one by one, each with
the component of its own text; equal sets share a component, whose smallest id
names it. Very long texts are hashed in slices, whole. Other columns take no part,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm.common import discard, distinct_by_row, materialise, mix, shingle_hashes, word_hashes
from redactory.llm.neardup import linked, shingle_sets, text_hash

SLOTS = 1 << 18
CUT = 512


def slot_counts(docs: DataFrame, words: int) -> np.ndarray:
    """How many (document, shingle) pairs of the table fall in each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for whole in batches:
            for at in range(0, len(whole), CUT):
                sets, _ = distinct_by_row(*shingle_hashes(*word_hashes(whole.slice(at, CUT).column("text")), words))
                counts += np.bincount(_slot(sets), minlength=SLOTS)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["slot", "n"])

    rows = docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.zeros(SLOTS, np.int64)
    table = rows.toArrow()  # SLOTS rows at most
    out[table.column("slot").to_numpy()] = table.column("n").to_numpy()
    return out


def _slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(46)).astype(np.int64)


def prefixes(docs: DataFrame, words: int, num: int, den: int, counts: np.ndarray) -> DataFrame:
    """(doc_id, h, size, fp1, fp2, prefix): the set's size and fingerprints, and its
    rarest shingles in order."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for whole in batches:
            for at in range(0, len(whole), CUT):
                batch = whole.slice(at, CUT)
                sets, rows = distinct_by_row(*shingle_hashes(*word_hashes(batch.column("text")), words))
                sizes = np.diff(rows)
                full = np.flatnonzero(sizes)
                prints = np.zeros((2, len(batch)), np.uint64)
                if len(full):
                    prints[0, full] = np.add.reduceat(sets, rows[:-1][full])
                    prints[1, full] = np.bitwise_xor.reduceat(mix(sets ^ np.uint64(0xA0761D6478BD642F)), rows[:-1][full])
                row = np.repeat(np.arange(len(batch)), sizes)
                order = np.lexsort((sets, counts[_slot(sets)], row))
                length = np.where(sizes > 0, sizes + (-num * sizes) // den + 1, 0)  # m - ceil(t m) + 1
                prefix = sets[order][np.arange(len(sets)) - rows[row] < length[row]]
                ends = np.append(0, np.cumsum(length)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("h"), pa.array(sizes), *(pa.array(p.view(np.int64)) for p in prints), pa.ListArray.from_arrays(pa.array(ends), pa.array(prefix.view(np.int64)))],
                    names=["doc_id", "h", "size", "fp1", "fp2", "prefix"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_hash(), "text").mapInArrow(run, f"doc_id {kind}, h long, size long, fp1 long, fp2 long, prefix array<long>")


def most_common(x: np.ndarray, y: np.ndarray, parts: int = 16) -> int:
    """An upper bound of the intersection of two sorted sets: in each part between
    two of the first set's elements they share at most the smaller number."""
    cuts = x[np.arange(1, parts) * len(x) // parts]
    ends = [np.concatenate([[0], np.searchsorted(z, cuts), [len(z)]]) for z in (x, y)]
    return int(np.minimum(*(np.diff(e) for e in ends)).sum())


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that link, on full sets, after the length and the suffix filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, blobs in enumerate(zip(batch.column("ta"), batch.column("tb"), strict=True)):
                x, y = (np.frombuffer(b.as_py(), np.uint64) for b in blobs)
                need = -(-num * (len(x) + len(y)) // (num + den))
                if min(len(x), len(y)) * den < max(len(x), len(y)) * num or most_common(x, y) < need:
                    continue
                if len(np.intersect1d(x, y, assume_unique=True)) >= need:
                    keep.append(i)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(rows) for c in ("a", "b")], names=["a", "b"])

    one, two = (sets.select(F.col("node").alias(n), F.col("shingles").alias(f"t{n}")) for n in ("a", "b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def ngram_components(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, large: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``: documents
    link when den * |intersection| >= num * |union| of their sets of ``words``-word
    shingles; component_id is the smallest doc_id reachable. ``large`` only decides
    how what the pivots leave is paired, not what is found."""
    counts = slot_counts(docs, words)
    ordered = materialise(prefixes(docs, words, num, den, counts).withColumn("node", F.monotonically_increasing_id()), "prefixes")
    table = materialise(ordered.drop("prefix"), "rows")
    full = table.where("size > 0 and doc_id is not null")
    copies = full.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("first"), F.first("size").alias("size"), F.min_by(F.struct("h", "node"), F.struct("doc_id", "node")).alias("r"))
    copies = materialise(copies.select("fp1", "fp2", "first", "size", "r.h", "r.node"), "copies")
    placed = ordered.where("size > 0 and doc_id is not null").select("node", F.posexplode("prefix").alias("place", "key"))
    often = placed.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("key")
    met = materialise(placed.join(often, "key").join(copies.select("node", "size"), "node").select("key", "node", "size", (F.col("size") - F.col("place")).alias("left")), "met")
    discard(ordered)
    # what is left from the shared shingle on bounds the partner's size as well
    most = F.floor(F.col("left") * (num + den) / num - F.col("size"))
    group = met.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n"), F.min("size").alias("small"), F.max(most).alias("reach")).where("pivot < last")
    # nodes that no node of their bucket can link with leave it
    members = met.join(group, "key").where((most >= F.col("small")) & (F.col("size") <= F.col("reach"))).select("key", "node", "size", "left", "pivot", "n")
    members = materialise(members, "members")
    discard(met)
    small, wide = members.where(F.col("n") <= large), members.where(F.col("n") > large)
    its = F.col("node").alias("other"), F.col("size").alias("its"), F.col("left").alias("remains")
    pairs = small.drop("pivot").join(small.select("key", *its), "key").where("node > other")
    pairs = pairs.select("node", "size", "left", "other", "its", "remains")
    pivots = wide.join(wide.where("node = pivot").select("key", *its), "key").where("node != other")
    pairs = pairs.unionByName(pivots.select(*pairs.columns))
    need = (F.col("size") + F.col("its")) * num
    near = pairs.where((F.least("size", "its") * den >= F.greatest("size", "its") * num) & (F.least("left", "remains") * (num + den) >= need))
    near = materialise(near.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "near")
    compared = near.select(F.explode(F.array("a", "b")).alias("node")).unionByName(wide.select("node"))
    named = copies.select(F.col("first").alias("doc_id"), "h", "node").join(compared.distinct(), "node", "left_semi")
    # the only pass that moves texts; the join is the same at every size
    texts = docs.select("doc_id", text_hash(), "text").join(named.hint("merge"), ["doc_id", "h"]).groupBy("doc_id", "h").agg(F.first("node").alias("node"), F.first("text").alias("text"))
    sets = materialise(shingle_sets(texts, words), "sets")

    def links(pairs: DataFrame) -> DataFrame:
        return materialise(verified(pairs.distinct(), sets, num, den), "links")

    known = linked(links(near), wide.select("key", "node", "size", "pivot", "n"), sets, links, large, num, den)
    joined = known.join(copies.select("node", "first"), "node")
    least = joined.groupBy("component").agg(F.min("first").alias("label"))
    label = copies.join(known.join(least, "component").select("node", "label"), "node", "left").select("fp1", "fp2", F.coalesce("label", "first").alias("component_id"))
    some = F.expr("size > 0 and doc_id is not null")
    alone = table.where(~some).select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return table.where(some).join(label, ["fp1", "fp2"]).select("doc_id", F.col("size").alias("n_shingles"), "component_id").unionByName(alone)
