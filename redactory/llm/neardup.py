"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes its set of word shingles, a MinHash signature and banded
   keys. Texts with equal sets collapse to one node, so copies make no pairs.
2. In each (band, key) bucket every node is paired with the bucket's pivot only:
   a bucket of n nodes makes n - 1 pairs.
3. Signatures of a pair are compared batch by batch. After each batch the pair is
   dropped if the posterior probability (uniform prior) that its similarity
   reaches the threshold is below ``miss``. Survivors are verified on full sets.
4. Verified links are contracted to components. Buckets that still hold several
   components get a second pivot, the text with most of the common shingles; what
   is then left is paired across components as far as sizes and counts of frequent
   and rare shingles allow a link (see ``_rest``), so a bucket never hides one.

Nodes are numbered by set, not by id, so rows that repeat an id with different
texts are different nodes.

Nulls, ties, repeats: a null or wordless text has the empty set and is linked
with nothing. A row without an id keeps a null component and stays. Rows that
repeat an id are returned one by one, each with the component of its own text.
Ties resolve to the smallest id. Ids may be of any type that can be ordered. Very
long texts are hashed in slices, whole. Other columns take no part, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactory.llm.common import distinct_by_row, materialise, measured, mix, shingle_hashes, word_hashes

PIECE = 4096


def _coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 32, (2, n), dtype=np.uint64).astype(np.uint32)
    return (draw[0] | np.uint32(1))[:, None], draw[1][:, None]


def minhash(hashes: np.ndarray, rows: np.ndarray, coefficients) -> np.ndarray:
    """Signatures (rows x permutations, uint32) of non-empty sets of hashes."""
    a, b = coefficients
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full((len(rows) - 1, len(a)), np.iinfo(np.uint32).max, np.uint32)
    cuts = np.unique(np.concatenate([rows, np.arange(0, len(x), PIECE)]))
    cuts = cuts[cuts < len(x)]
    owner = np.searchsorted(rows, cuts, side="right") - 1
    at = 0
    while at < len(cuts):
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + PIECE)))
        stop = int(cuts[to]) if to < len(cuts) else len(x)
        low = np.minimum.reduceat(x[None, cuts[at] : stop] * a + b, cuts[at:to] - cuts[at], axis=1).T
        np.minimum.at(out, owner[at:to], low)
        at = to
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    parts = signatures.reshape(-1, bands, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for k in range(rows):
        keys = mix(keys ^ (parts[:, :, k] + np.uint64(k + 1)))
    return keys


def least_matches(size: int, batch: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(hashes compared, fewest matches that keep a pair) for each batch.

    With a uniform prior, P(similarity >= t | m of n match) = P(Bin(n + 1, t) <= m)."""
    out = []
    for n in range(batch, size + 1, batch):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out.append((n, m))
    return out


def signatures(docs: DataFrame, words: int, bands: int, band_rows: int, seed: int) -> DataFrame:
    """(doc_id, h, n_shingles, fp1, fp2, keys, signature); h: the text's hash, fp: the
    set's fingerprint."""
    coefficients = _coefficients(bands * band_rows, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                sets, rows = distinct_by_row(*shingle_hashes(*word_hashes(batch.column("text")), words))
                sizes = np.diff(rows)
                full = np.flatnonzero(sizes)
                prints = np.zeros((2, len(batch)), np.uint64)
                sign, keys = np.zeros((0, bands * band_rows), np.uint32), np.zeros((0, bands), np.uint64)
                if len(full):
                    starts = rows[:-1][full]
                    prints[0, full] = np.add.reduceat(sets, starts)
                    prints[1, full] = np.bitwise_xor.reduceat(mix(sets ^ np.uint64(0xA0761D6478BD642F)), starts)
                    sign = minhash(sets, np.append(starts, len(sets)), coefficients)
                    keys = band_keys(sign, bands, band_rows)
                has = sizes > 0
                ends = np.append(0, np.cumsum(has * bands)).astype(np.int32)
                blobs = iter(sign)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("h"),
                        pa.array(sizes.astype(np.int64)),
                        pa.array(prints[0].view(np.int64)),
                        pa.array(prints[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64))),
                        pa.array([next(blobs).tobytes() if x else None for x in has], pa.binary()),
                    ],
                    names=["doc_id", "h", "n_shingles", "fp1", "fp2", "keys", "signature"],
                )

    return docs.select("doc_id", text_hash(), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, n_shingles long, fp1 long, fp2 long, keys array<long>, signature binary")


def text_hash() -> Column:
    return F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of (node, text): the sorted 64-bit hashes of each full set."""

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                sets, rows = distinct_by_row(*shingle_hashes(*word_hashes(batch.column("text")), words))
                blobs = [sets[rows[i] : rows[i + 1]].tobytes() for i in range(len(batch))]
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(blobs, pa.binary())], names=["node", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, shingles binary")


def _survivors(pairs: DataFrame, nodes: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """Pairs whose posterior stays above the miss probability in every batch."""

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(len(batch), -1) for c in ("sa", "sb"))
            alive, found, before = np.arange(len(batch)), np.zeros(len(batch), np.int64), 0
            for n, least in steps:
                found[alive] += (a[alive, before:n] == b[alive, before:n]).sum(axis=1)
                alive, before = alive[found[alive] >= least], n
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(alive)), batch.column("b").take(pa.array(alive))], names=["a", "b"])

    one = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    two = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs with den * |intersection| >= num * |union| on full shingle sets."""

    def run(batches):
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column("ta"), batch.column("tb"), strict=True)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both and den * both >= num * (len(x) + len(y) - both):
                    keep.append(i)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows)], names=["a", "b"])

    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("ta"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): connected components by alternating large and small
    stars. Both steps are a grouped minimum and a join, so a node of very many
    links is combined before the shuffle and its join is split by key."""
    hi, lo = F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")
    stars, before = edges.where(F.col(a) != F.col(b)).select(hi, lo), None
    facts = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("sum")
    while True:
        both = stars.unionByName(stars.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = both.join(least, "hi").where("lo > hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*")
        stars, now = measured(small.where("hi != lo").distinct(), "stars", *facts)
        if now == before:
            break
        before = now
    roots = stars.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, bands: int = 26, band_rows: int = 5, batch: int = 26, miss: float = 1e-9, large: int = 64, seed: int = 7) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Documents are linked when their shingle sets have a Jaccard similarity of
    num / den or more; component_id is the smallest doc_id reachable. ``large``
    only decides how what the pivots leave is paired, not what is found."""
    return _components(docs, words, num, den, bands, band_rows, batch, miss, large, seed).drop("h")


def _components(docs: DataFrame, words: int, num: int, den: int, bands: int, band_rows: int, batch: int, miss: float, large: int, seed: int) -> DataFrame:
    """``near_duplicates`` with the hash ``h`` of each row's text."""
    sig = materialise(signatures(docs, words, bands, band_rows, seed), "signatures")
    steps = least_matches(bands * band_rows, batch, num / den, miss)
    full = sig.where("n_shingles > 0 and doc_id is not null")
    # one node for each set; its text and signature come from the row of smallest id
    copies = full.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("first"), F.min_by("h", "doc_id").alias("h"))
    copies = materialise(copies.withColumn("node", F.monotonically_increasing_id()), "copies")
    of = copies.select(F.col("first").alias("doc_id"), "h", "node")
    nodes = full.join(of, ["doc_id", "h"]).groupBy("doc_id", "h").agg(*(F.first(c).alias(c) for c in ("node", "n_shingles", "keys", "signature")))
    nodes = materialise(nodes.withColumnRenamed("n_shingles", "size"), "nodes")
    members = nodes.select("node", "size", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n"))
    members = materialise(members.join(shared.where("pivot < last"), "key").select("key", "node", "size", "pivot", "n"), "members")
    # the only pass that moves texts; the join is the same at every size
    named = of.join(members.select("node").distinct(), "node", "left_semi")
    texts = docs.select("doc_id", text_hash(), "text").join(named.hint("merge"), ["doc_id", "h"]).groupBy("doc_id", "h").agg(F.first("node").alias("node"), F.first("text").alias("text"))
    sets = materialise(shingle_sets(texts, words), "sets")

    def links(pairs: DataFrame) -> DataFrame:
        return materialise(_verified(_survivors(pairs.distinct(), nodes, steps), sets, num, den), "links")

    first = members.where("node != pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    return _labelled(sig, copies, linked(links(first), members, sets, links, large, num, den))


def linked(first: DataFrame, members: DataFrame, sets: DataFrame, links: Callable[[DataFrame], DataFrame], large: int, num: int, den: int) -> DataFrame:
    """(node, component) of the nodes that link. ``members`` (key, node, size, pivot,
    n) are the nodes of each bucket, ``first`` the links found between pivots and
    their buckets; ``links`` confirms pairs. Every link between members of a bucket
    counts, by whatever pairs are compared."""
    found = [first]
    known = components(found[0])
    # a bucket of two has been compared in full, and every pivot with its bucket
    open_, some = _unsettled(members.where("n > 2 and node != pivot").select("key", "node", "size"), known, "open")
    if not some:
        return known
    held = materialise(_shingle_rows(open_.select("node").distinct(), sets), "held")
    rare = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= large)
    # the rare shingles of a text are few where a bucket is large, so those are joined and counted
    cold = held.join(rare, "shingle", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("cold"))
    often = held.groupBy("node").agg(F.count(F.lit(1)).alias("all")).join(cold, "node", "left").select("node", (F.col("all") - F.coalesce("cold", F.lit(0))).alias("hot"))
    open_ = materialise(open_.join(materialise(often, "often"), "node"), "ranked")
    # the text with the largest share of frequent shingles is the next pivot
    pivot = open_.groupBy("key").agg(F.min(F.struct(-F.col("hot") / F.col("size"), "node", "component")).alias("p")).select("key", F.col("p.node").alias("far"), F.col("p.component").alias("home"))
    at = open_.join(pivot, "key")
    found.append(links(materialise(_ordered(at.where("component != home")), "pairs")))
    known = components(reduce(DataFrame.unionByName, found))
    open_, some = _unsettled(at.where("node != far").select("key", "node", "size", "hot"), known, "open")
    if not some:
        return known
    found.append(links(materialise(_rest(open_, sets, large, num, den), "pairs")))
    return components(reduce(DataFrame.unionByName, found))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("node", "far").alias("a"), F.greatest("node", "far").alias("b")).distinct()


def _rest(open_: DataFrame, sets: DataFrame, large: int, num: int, den: int) -> DataFrame:
    """All pairs across components that may still link, without a quadratic step.

    A link needs (num + den) |A and B| >= num (|A| + |B|). In buckets of up to
    ``large`` nodes all pairs are taken. In larger ones, shingles held by more than
    ``large`` of the open nodes are hot, the others cold. Two texts with no cold
    shingle in common share at most the smaller number of hot ones, so only texts
    made of hot shingles almost alone can link; texts that do share cold ones are
    paired on the rarest of these (``_heads``)."""
    sizes = open_.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    placed = open_.join(sizes, "key")
    other = lambda df: df.select("key", F.col("node").alias("far"), F.col("size").alias("other"), F.col("hot").alias("most"), F.col("component").alias("home"))
    across = F.col("component") < F.col("home")
    fits = F.least("size", "other") * den >= F.greatest("size", "other") * num
    need = (F.col("size") + F.col("other")) * num
    small = placed.where(F.col("n") <= large)
    small = small.join(other(small), "key").where(across & fits)
    big = placed.where(F.col("n") > large)
    core = big.where(F.col("hot") * den >= F.col("size") * num)
    core = core.join(other(core), "key").where(across & (F.least("hot", "most") * (num + den) >= need))
    facts = big.select("node", "size", "hot", "component").distinct()
    mine = materialise(_shingle_rows(facts.select("node").distinct(), sets), "mine")
    head = materialise(_heads(mine, facts, large, num, den), "head")
    far = head.toDF("shingle", "far", "place2", "all2", "other", "most", "home")
    met = head.join(far, "shingle").where((F.col("node") < F.col("far")) & (F.col("component") != F.col("home")) & fits)
    met = met.groupBy("node", "far", "size", "other", "hot", "most").agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("p"), F.max("place2").alias("p2"), F.first("all").alias("all"), F.first("all2").alias("all2"))
    # what they share up to their last common place, and behind it the shorter rest
    shared = F.least("hot", "most") + F.col("n") + F.least(F.col("all") - F.col("p"), F.col("all2") - F.col("p2"))
    met = met.where(shared * (num + den) >= need)
    return _ordered(small).unionByName(_ordered(core)).unionByName(_ordered(met)).distinct()


def _heads(mine: DataFrame, facts: DataFrame, large: int, num: int, den: int) -> DataFrame:
    """(shingle, node, place, all, size, hot, component): of each text's ``all`` cold
    shingles that others hold, the rarest, without which it cannot link.

    A partner of a text of n shingles is no smaller than n num / den, so they share
    n num / den or more, and c = n num / den - hot of the cold ones at least. Two
    texts that share c in one order of all shingles have the first of them in common
    among the ``all`` - c + 1 first of each."""
    rare = mine.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, large))
    own = Window.partitionBy("node")
    placed = mine.join(rare, "shingle").select("shingle", "node", F.row_number().over(own.orderBy("n", "shingle")).alias("place"), F.count(F.lit(1)).over(own).alias("all"))
    least = F.greatest(F.lit(1), F.ceil(F.col("size") * num / den) - F.col("hot"))
    return placed.join(facts, "node").where(F.col("place") <= F.col("all") - least + 1).select("shingle", "node", "place", "all", "size", "hot", "component")


def _unsettled(members: DataFrame, known: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Members, with their component, of buckets that hold several components, and
    their number."""
    placed = members.join(known, "node", "left").select(*members.columns, F.coalesce("component", "node").alias("component"))
    split = placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("key")
    out, facts = measured(placed.join(split, "key", "left_semi"), name, F.count(F.lit(1)).alias("n"))
    return out, facts["n"]


def _shingle_rows(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, shingle): the full sets of some nodes as rows."""

    def explode(batches):
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.slice(at, 1024)
                parts = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("shingles")]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), [len(p) for p in parts])), pa.array(np.concatenate(parts))], names=["node", "shingle"])

    return sets.join(nodes, "node", "left_semi").mapInArrow(explode, "node long, shingle long").distinct()


def _labelled(sig: DataFrame, copies: DataFrame, known: DataFrame) -> DataFrame:
    linked = known.join(copies.select("node", "first"), "node")
    least = linked.groupBy("component").agg(F.min("first").alias("label"))
    named = copies.join(known.join(least, "component").select("node", "label"), "node", "left").select("fp1", "fp2", F.coalesce("label", "first").alias("component_id"))
    own = "doc_id", "h", "n_shingles"
    some = F.expr("n_shingles > 0 and doc_id is not null")
    both = sig.where(some).join(named, ["fp1", "fp2"]).select(*own, "component_id").unionByName(sig.where(~some).select(*own, F.col("doc_id").alias("component_id")))
    return both.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, bands: int = 26, band_rows: int = 5, batch: int = 26, miss: float = 1e-9, large: int = 64, seed: int = 7) -> DataFrame:
    """``docs`` with one document of each group left, the one of smallest id.

    Rows are told apart by id and text: of rows equal in both one stays, and a row
    that repeats an id with another text is judged by its own. Where a group's
    smallest id stands with several of its texts, the one of smallest hash stays.
    Rows without an id or without words stay."""
    rows = _components(docs, words, num, den, bands, band_rows, batch, miss, large, seed).where("n_shingles > 0 and doc_id is not null")
    one = F.min("h").over(Window.partitionBy("component_id"))
    first = rows.where("kept").groupBy("component_id", "h").agg(F.count(F.lit(1)).alias("n")).withColumn("one", F.col("h") == one)
    first = materialise(first, "first")
    gone = rows.where("not kept").select("doc_id", "h").unionByName(first.where("n > 1 or not one").select(F.col("component_id").alias("doc_id"), "h"))
    twice = materialise(first.where("n > 1 and one").select(F.col("component_id").alias("doc_id"), "h"), "twice")
    gone = materialise(gone.select(F.col("doc_id").alias("_gone"), F.col("h").alias("_hash")).distinct(), "gone")
    at = (F.col("doc_id") == F.col("_gone")) & (text_hash() == F.col("_hash"))
    left = docs.join(gone, at, "left_anti").select(*docs.columns)
    again = docs.join(twice.toDF("_gone", "_hash"), at, "left_semi").groupBy("doc_id", F.xxhash64("text").alias("_hash"))
    again = again.agg(*(F.first(c).alias(c) for c in docs.columns if c != "doc_id")).select(*docs.columns)
    return left.unionByName(again)
