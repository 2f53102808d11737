"""Stupid-backoff language-model scores, computed as a join of relations.

The relation of exploded n-grams (document, n-gram) is joined to the n-gram
count tables, which are partitioned by n-gram hash, and the log scores are
summed per document. Rows of both relations are packed in sorted arrays:

1. Documents are dealt by hash into blocks of about ``block_bytes``. A block
   sends every distinct n-gram it holds, with its count, to the n-gram's hash
   partition, so a frequent n-gram arrives once for each block, not each row.
   Sorted hashes are sent as their differences, as many bits of each as tell the
   n-grams of this corpus apart (``hash_bits``), counts compressed; none is left out.
2. A hash partition sums the counts (the count table) and answers each block with
   what other blocks add; n-grams of one block alone need no answer.
3. A block joins the answers to its exploded n-grams and sums per document.

Counts cover all documents, less those of the scored document itself, so no text
vouches for itself. S(w | h) = c(hw) / c(h) if c(hw) > 0, else ``alpha`` times the
score with a shorter history; last c(w) / N, where an unseen word counts 0.5.

Nulls, ties, repeats: a null or wordless text has no words and a null score. Rows
equal in id and text are scored one by one and vouch for each other. Ids may be of
any type. A very long text is one row of its block. Other columns take no part,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm.common import materialise, mix, word_hashes

BLOCK_BYTES = 8 << 20
PART_BYTES = 24 << 20


def ngrams(words: np.ndarray, rows: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every n-gram inside a row, index of its last word)."""
    m = len(words) - order + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.full(m, order, np.uint64)
    for k in range(order):
        value = mix(value + words[k : k + m])
    first = np.arange(m)
    inside = first + order <= rows[np.searchsorted(rows, first, side="right")]
    return value[inside], first[inside] + order - 1


def _part(hashes: np.ndarray, n_parts: int) -> np.ndarray:
    """Hash ranges, so that sorted hashes are sorted by partition too."""
    return ((hashes >> np.uint64(32)) * np.uint64(n_parts)) >> np.uint64(32)


def _runs(sorted_: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, stop) of each run of equal values."""
    starts = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(sorted_) else np.zeros(0, np.int64)
    return list(zip(sorted_[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(sorted_)], strict=len(starts) > 0))


def pack(values: np.ndarray, raw: int = 0) -> bytes:
    """Non-negative integers by byte planes: the ``raw`` low ones as they are, the
    others, which are mostly zero, compressed."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return np.uint32(len(values)).tobytes() + planes[:raw].tobytes() + zlib.compress(planes[raw:].tobytes(), 1)


def unpack(data: bytes, raw: int = 0) -> np.ndarray:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    high = np.frombuffer(zlib.decompress(memoryview(data)[4 + raw * n :]), np.uint8)
    planes = np.concatenate([np.frombuffer(data, np.uint8, raw * n, 4), high]).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    steps = np.diff(keys, prepend=np.uint64(0))
    raw = int(np.median(steps)).bit_length() // 8 if len(steps) else 0
    return bytes([raw]) + pack(steps, raw)


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data[1:], data[0]), dtype=np.uint64)


def hash_bits(total_bytes: int, order: int) -> int:
    """High bits of an n-gram's hash that are compared: as many as leave about one
    n-gram in a million of a corpus of this size sharing them with another."""
    return min(64, math.ceil(math.log2(max(2, total_bytes * order / 4))) + 20)


def score_documents(docs: DataFrame, order: int = 3, alpha: float = 0.4, block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_words, log_score, per_word): one row for each row of ``docs``;
    per_word is the mean natural log of S."""
    total = docs.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    n_blocks, n_parts = (max(1, math.ceil(total * k / size)) for k, size in ((1, block_bytes), (order, part_bytes)))
    shift = np.uint64(64 - hash_bits(total, order))
    block = F.pmod(F.xxhash64(F.lit(order), "doc_id", F.xxhash64("text")), F.lit(n_blocks)).cast("int")
    dealt = docs.select("doc_id", "text", block.alias("block")).repartition(n_blocks, "block")

    def send(key: tuple, table: pa.Table) -> pa.Table:
        words, rows = word_hashes(table["text"])
        out: dict[str, list] = {c: [] for c in ("part", "block", "n", "keys", "counts")}
        for n in range(1, order + 1):
            found, counts = np.unique(ngrams(words, rows, n)[0] >> shift, return_counts=True)
            for p, start, stop in _runs(_part(found << shift, n_parts)):
                for c, v in zip(out, (p, key[0].as_py(), n, pack_sorted(found[start:stop]), pack(counts[start:stop])), strict=True):
                    out[c].append(v)
        return pa.table({"part": pa.array(out["part"], pa.int32()), "block": pa.array(out["block"], pa.int32()), "n": pa.array(out["n"], pa.int32()), "keys": pa.array(out["keys"], pa.binary()), "counts": pa.array(out["counts"], pa.binary())})

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        asked = list(zip(*(table[c].to_pylist() for c in ("block", "n", "keys", "counts")), strict=True))
        out: dict[str, list] = {c: [] for c in ("home", "n", "part", "places", "more")}
        for n in sorted({x[1] for x in asked}):
            mine = [x for x in asked if x[1] == n]
            keys = [unpack_sorted(x[2]) for x in mine]
            counts = np.concatenate([unpack(x[3]) for x in mine]).astype(np.int64)
            joined = np.concatenate(keys)
            order_ = np.argsort(joined, kind="stable")
            ranked = joined[order_]
            first = np.append(True, ranked[1:] != ranked[:-1])
            sums = np.add.reduceat(counts[order_], np.flatnonzero(first))
            totals = np.empty(len(joined), np.int64)
            totals[order_] = sums[np.cumsum(first) - 1]
            at, more = 0, totals - counts
            for x, k in zip(mine, keys, strict=True):
                others = more[at : at + len(k)]
                places = np.flatnonzero(others)
                at += len(k)
                if len(places):
                    for c, v in zip(out, (x[0], n, key[0].as_py(), pack(np.diff(places, prepend=0)), pack(others[places])), strict=True):
                        out[c].append(v)
        return pa.table({"home": pa.array(out["home"], pa.int32()), "n": pa.array(out["n"], pa.int32()), "part": pa.array(out["part"], pa.int32()), "places": pa.array(out["places"], pa.binary()), "more": pa.array(out["more"], pa.binary())})

    def join(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        words, rows = word_hashes(table["text"])
        row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
        got = list(zip(*(answers[c].to_pylist() for c in ("n", "part", "places", "more")), strict=True))
        score, last, bare = np.zeros(len(words)), np.zeros(len(words)), np.ones(len(words), bool)
        for n in range(1, order + 1):
            hashes, at = ngrams(words, rows, n)
            seen = np.zeros(len(words))
            hashes >>= shift
            if len(hashes):
                found, which, totals = np.unique(hashes, return_inverse=True, return_counts=True)
                first = {p: start for p, start, _ in _runs(_part(found << shift, n_parts))}
                for _, part, places, more in (x for x in got if x[0] == n):
                    totals[first[part] + np.cumsum(unpack(places)).astype(np.int64)] += unpack(more).astype(np.int64)
                _, mine, own = np.unique(row[at] * len(found) + which, return_inverse=True, return_counts=True)
                seen[at] = totals[which] - own[mine]
            if n == 1:
                score = np.log(np.maximum(seen, 0.5))
            else:
                history = np.append(0.0, last[:-1])
                hit = seen > 0
                backed = np.zeros(len(words), bool)
                backed[at] = True
                score = np.where(hit, np.log(np.maximum(seen, 1)) - np.log(np.maximum(history, 1)), score + np.where(backed, math.log(alpha), 0.0))
                bare &= ~hit
            last = seen
        n_rows = len(rows) - 1
        return pa.table({"doc_id": table["doc_id"], "n_words": pa.array(np.diff(rows).astype(np.int64)), "partial": pa.array(np.bincount(row, score, n_rows)), "bare": pa.array(np.bincount(row, bare, n_rows).astype(np.int64))})

    asked = dealt.groupBy("block").applyInArrow(send, "part int, block int, n int, keys binary, counts binary")
    answers = asked.repartition(2 * n_parts, "part").groupBy("part").applyInArrow(answer, "home int, n int, part int, places binary, more binary")
    parts = dealt.groupBy("block").cogroup(answers.groupBy("home")).applyInArrow(join, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, partial double, bare long")
    parts = materialise(parts, "partial_scores")
    corpus = parts.agg(F.sum("n_words")).first()[0] or 0
    log_score = F.col("partial") - F.col("bare") * math.log(max(corpus, 1))
    some = F.when(F.col("n_words") > 0, log_score)
    return parts.select("doc_id", "n_words", some.alias("log_score"), (some / F.col("n_words")).alias("per_word"))
