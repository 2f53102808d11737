"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so the Jaccard similarity of the two
says little. Items are therefore partitioned by the size of their shingle set,
each partition spanning a factor of two up to ``u``. For a partition, a document
is read as overlapping segments of ``2u`` shingles, one starting every ``u``
(a shorter document is one segment), so any run of ``u`` shingles lies whole in
one segment. Between an item with containment t and such a segment the Jaccard
similarity is at least t (u/2) / (2u + (1-t) u/2): the number of one-row MinHash
bands follows from it and the chosen miss probability. A segment that shares a
band with an item makes a candidate, which is verified by the exact containment
of the item's shingles in the whole document.

The items travel to the tasks in blocks of about ``block_items`` items and
``block_bytes`` of text at most; each block is one pass over the documents, so
what is broadcast has a fixed bound.

Nulls, ties, repeats: a null or wordless item or document matches nothing. An
item of fewer than ``words`` words is one shingle of its own length, and found
wherever a text holds it. Repeated rows and items are matched one by one; ids may
be of any type. Very long texts are hashed in slices, whole. Other columns take no
part, whatever their names. Either table may be empty: no matches.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm.common import distinct_by_row, mix, shingle_hashes, word_hashes

BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20
STEP = 1 << 14
_BAND = np.uint64(0x9E3779B97F4A7C15)


def bands_for(containment: float, miss: float) -> int:
    """One-row bands that miss the least similar segment with probability ``miss``."""
    least = containment * 0.5 / (2 + (1 - containment) * 0.5)
    return math.ceil(math.log(miss) / math.log(1 - least))


def _permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 32, (2, n), dtype=np.uint64).astype(np.uint32)
    return (draw[0] | np.uint32(1))[:, None], draw[1][:, None]


def _minima(x: np.ndarray, starts: np.ndarray, permutations) -> np.ndarray:
    """(bands x runs): the least permuted value of each run of ``x``, at most
    STEP values at a time."""
    a, b = permutations
    out = np.full((len(a), len(starts)), np.iinfo(np.uint32).max, np.uint32)
    cuts = np.unique(np.concatenate([starts, np.arange(0, len(x), STEP)]))
    owner = np.searchsorted(starts, cuts, side="right") - 1
    at = 0
    while at < len(cuts):
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + STEP)))
        stop = int(cuts[to]) if to < len(cuts) else len(x)
        low = np.minimum.reduceat(x[None, cuts[at] : stop] * a + b, cuts[at:to] - cuts[at], axis=1)
        np.minimum.at(out, (slice(None), owner[at:to]), low)
        at = to
    return out


class ItemIndex:
    """One block of items: band keys by size partition, and the full sets."""

    def __init__(self, ids: pa.Array, column: pa.Array, words: int, containment: float, miss: float, seed: int):
        self.words, self.containment, self.ids = words, containment, ids
        self.permutations = _permutations(bands_for(containment, miss), seed)
        hashes, at = word_hashes(column)
        self.sets, self.rows = distinct_by_row(*shingle_hashes(hashes, at, words))
        self.sizes, lengths = np.diff(self.rows), np.diff(at)
        # items shorter than a shingle: (hashes of their own length in order, item)
        self.short = {}
        for n in set(lengths[(lengths > 0) & (lengths < words)].tolist()):
            items = np.flatnonzero(lengths == n)
            own, first = shingle_hashes(hashes, at, n)
            keys = own[first[items]]
            order = np.argsort(keys, kind="stable")
            self.short[n] = keys[order], items[order]
        part = np.ceil(np.log2(np.maximum(self.sizes, 1))).astype(int)
        self.parts = {}
        whole = (self.sizes > 0) & (lengths >= words)
        for p in sorted(set(part[whole])):
            items = np.flatnonzero((part == p) & whole)
            picked = [self.sets[self.rows[i] : self.rows[i + 1]] for i in items]
            starts = np.append(0, np.cumsum([len(x) for x in picked]))[:-1]
            low = _minima((np.concatenate(picked) >> np.uint64(32)).astype(np.uint32), starts, self.permutations)
            keys = self.keys(low).reshape(-1)
            order = np.argsort(keys, kind="stable")
            self.parts[1 << int(p)] = (keys[order], np.tile(items, len(low))[order])

    @staticmethod
    def keys(low: np.ndarray) -> np.ndarray:
        return mix(low.astype(np.uint64) + np.arange(1, len(low) + 1, dtype=np.uint64)[:, None] * _BAND)

    def candidates(self, hashes: np.ndarray, rows: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs that share a band in some partition."""
        found: set[tuple[int, int]] = set()
        if not len(hashes):
            return found
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        sizes = np.diff(rows)
        for upper, (keys, items) in self.parts.items():
            # blocks of ``upper`` shingles; a segment is two neighbouring blocks
            blocks = -(-sizes // upper)
            row = np.repeat(np.arange(len(sizes)), blocks)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            low = _minima(x, rows[row] + nth * upper, self.permutations)
            joined = low.copy()
            same = row[1:] == row[:-1]
            joined[:, :-1][:, same] = np.minimum(low[:, :-1], low[:, 1:])[:, same]
            key = self.keys(joined)
            at = np.searchsorted(keys, key)
            hit = np.argwhere(keys[np.minimum(at, len(keys) - 1)] == key)
            for band, segment in hit:
                k = at[band, segment]
                while k < len(keys) and keys[k] == key[band, segment]:
                    found.add((int(row[segment]), int(items[k])))
                    k += 1
        return found

    def _short_matches(self, words: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int]]:
        found: set[tuple[int, int, int]] = set()
        for n, (keys, items) in self.short.items():
            hashes, first = shingle_hashes(words, rows, n)
            low, high = np.searchsorted(keys, hashes), np.searchsorted(keys, hashes, side="right")
            at = np.flatnonzero(low < high)
            for row, a, b in zip(np.searchsorted(first, at, side="right") - 1, low[at], high[at], strict=True):
                found.update((int(row), int(item), 1) for item in items[a:b])
        return sorted(found)

    def matches(self, column: pa.Array) -> list[tuple[int, int, int]]:
        """(row, item, shared shingles) with exact containment at the threshold."""
        plain = word_hashes(column)
        hashes, rows = shingle_hashes(*plain, self.words)
        out, own = self._short_matches(*plain), {}
        for row, item in sorted(self.candidates(hashes, rows)):
            if row not in own:
                own = {row: np.unique(hashes[rows[row] : rows[row + 1]])}
            wanted = self.sets[self.rows[item] : self.rows[item + 1]]
            both = len(np.intersect1d(own[row], wanted, assume_unique=True))
            if both >= self.containment * len(wanted) - 1e-9:
                out.append((row, item, both))
        return out


def find_contamination(docs: DataFrame, items: DataFrame, words: int = 5, containment: float = 0.8, miss: float = 1e-4, seed: int = 11, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, shared, item_shingles): every item contained in a text."""
    spark = docs.sparkSession
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n_blocks = max(1, -(-size["n"] // block_items), -(-(size["bytes"] or 0) // block_bytes))
    numbered = items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * n_blocks)).alias("b")) if n_blocks > 1 else items.select("item_id", "text", F.lit(0).alias("b"))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, shared long, item_shingles long"

    def one(block: int) -> DataFrame:
        rows = numbered.where(F.col("b") == block).orderBy("item_id", "text").toArrow()
        texts = rows["text"].combine_chunks() if len(rows) else pa.array([], pa.string())
        index = ItemIndex(pa.array(rows["item_id"].to_pylist(), rows["item_id"].type), texts, words, containment, miss, seed)
        shared = spark.sparkContext.broadcast(index)

        def run(batches):
            ix = shared.value
            for whole in batches:
                for at in range(0, len(whole), 256):
                    batch = whole.slice(at, 256)
                    got = ix.matches(batch.column("text"))
                    rows, picked, both = ([x[k] for x in got] for k in range(3))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(id_col).take(pa.array(rows, pa.int64())), ix.ids.take(pa.array(picked, pa.int64())), pa.array(both, pa.int64()), pa.array([int(ix.sizes[i]) for i in picked], pa.int64())],
                        names=[id_col, "item_id", "shared", "item_shingles"],
                    )

        return docs.select(id_col, "text").mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [one(b) for b in range(2 * n_blocks if n_blocks > 1 else 1)])


def decontaminate(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows whose text contains a test item. Rows are told apart
    by id and text, so each is judged by its own text, those without an id too."""
    row = F.struct("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"))
    hit = find_contamination(docs.select(row.alias("row"), "text"), items, id_col="row", **how).select(F.col("row.doc_id").alias("_hit"), F.col("row.h").alias("_hash")).distinct()
    same = docs["doc_id"].eqNullSafe(hit["_hit"]) & (F.coalesce(F.xxhash64(docs["text"]), F.lit(0)) == hit["_hash"])
    return docs.join(hit, same, "left_anti").select(*docs.columns)
