"""Shared helpers: a shared scratch folder, written intermediates, text hashing.

The hashing helpers work on a whole Arrow batch at a time. Words are maximal
runs of bytes outside ``[\\x20\\x09-\\x0D]``; only A-Z is lower-cased, so both
steps are exact on UTF-8 bytes.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.cumprod(np.full(4096, _BASE, dtype=np.uint64))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where none is set, a local master gets a
    fresh local one; on a cluster that would be another folder on every machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="redactory-"))
        root = spark.sparkContext.getCheckpointDir()
    return root


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here,
    and a lost executor costs a re-read instead of a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/redactory-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _remove_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialise`` wrote for ``df``, once all that reads it is written."""
    _delete(df.sparkSession, df._written_to.rsplit("/", 1)[0])


def measured(df: DataFrame, name: str, *facts: Column) -> tuple[DataFrame, dict]:
    """``materialise`` and some aggregates of it, taken in the same pass."""
    seen = Observation()
    return materialise(df.observe(seen, *facts), name), seen.get


_written: dict[str, list[str]] = {}


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    """Results read intermediates lazily, so those go when the context stops."""
    app = spark.sparkContext.applicationId
    if app not in _written:
        _written[app] = []
        stop = spark.sparkContext.stop

        def stopped():
            sweep(spark)
            stop()

        spark.sparkContext.stop = stopped
    _written[app].append(path.rsplit("/", 1)[0])


def sweep(spark: SparkSession) -> None:
    """Delete the intermediates written so far in this application; results that
    have not been written yet can no longer be computed."""
    for folder in _written.pop(spark.sparkContext.applicationId, []):
        _delete(spark, folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply), in place on a uint64 array."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 row offsets in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _slices(data: np.ndarray, offsets: np.ndarray):
    """Byte ranges of about SLICE_BYTES that never cut a word."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(at + SLICE_BYTES, end)
        if stop < end:
            row_end = int(offsets[np.searchsorted(offsets, stop)])
            while stop < row_end:
                spaces = np.flatnonzero(_SPACE[data[stop : min(stop + 4096, row_end)]])
                if len(spaces):
                    stop += int(spaces[0])
                    break
                stop = min(stop + 4096, row_end)
        yield at, stop
        at = stop


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, first word index of each row; n + 1 long)."""
    global _powers
    data, offsets = text_bytes(column)
    hashes, places = [], []
    for at, stop in _slices(data, offsets):
        raw = _LOWER[data[at:stop]]
        space = _SPACE[raw]
        first = ~space
        first[1:] &= space[:-1]
        edges = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop)] - at
        first[edges] = ~space[edges]
        starts = np.flatnonzero(first)
        if not len(starts):
            continue
        nth = np.arange(len(raw)) - starts[np.maximum(np.cumsum(first) - 1, 0)]
        nth[space] = 0
        nth[: starts[0]] = 0
        if (longest := int(nth.max()) + 1) > len(_powers):
            _powers = np.cumprod(np.full(2 * longest, _BASE, dtype=np.uint64))
        value = (raw.astype(np.uint64) + np.uint64(1)) * _powers[nth]
        value[space] = 0
        hashes.append(np.add.reduceat(value, starts))
        places.append(starts + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return mix(np.concatenate(hashes)), np.searchsorted(np.concatenate(places), offsets)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every ``size``-word shingle, first shingle index of each row).

    A row of 1 to size - 1 words has one shingle, the whole sequence."""
    counts = np.diff(rows)
    sums = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        sums += words[k : k + len(sums)] * (_powers[k + 7] | np.uint64(1))
    starts = np.arange(len(sums))
    row = np.searchsorted(rows, starts, side="right") - 1
    inside = starts + size <= rows[row + 1]
    sums, row = mix(sums[inside]), row[inside]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            extra[has] += words[rows[short[has]] + k] * (_powers[k + 7] | np.uint64(1))
        extra = mix(extra ^ (counts[short].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        order = np.argsort(np.concatenate([row, short]), kind="stable")
        sums, row = np.concatenate([sums, extra])[order], np.concatenate([row, short])[order]
    return sums, np.searchsorted(row, np.arange(len(rows)))


def distinct_by_row(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's hashes sorted and without repeats."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    return hashes[keep], np.searchsorted(row[keep], np.arange(len(rows)))


def column_size(df: DataFrame, column: str) -> int:
    """Total UTF-8 bytes of one text column, as one sum."""
    return df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


#: A key's rows are dealt over this many tasks; its one answer goes only to those
#: that have rows of it, so rare keys are not copied more often than they occur.
SALTS = 32


def salt(at: str) -> Column:
    """The salt of a row named by column ``at``."""
    return F.pmod(F.xxhash64(at), F.lit(SALTS)).cast("int")


def salts() -> Column:
    """The set of a group's salts, as bits; combined before the shuffle."""
    return F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")


def each_salt() -> Column:
    """One row for each member of ``salts``."""
    return F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda s: F.getbit("salts", s) == 1)).alias("salt")


LONG_KEY = 256


class Memo(dict):
    """Answers of ``make`` by key: those of the last ``bound`` to ``2 * bound``
    keys asked for; a key asked for again moves to the younger half. Answers for
    keys longer than LONG_KEY are not kept, so the memory has a bound in bytes."""

    def __init__(self, make, bound: int):
        self.make, self.bound, self.old = make, bound, {}

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.make(key)
        if isinstance(key, str) and len(key) > LONG_KEY:
            return value
        if len(self) >= self.bound:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


#: Letters, numbers and white space below U+0180, where the standard library's
#: faster patterns can name them: the classes there of \p{L}, \p{N} and white space.
LATIN = {"\\p{L}": "A-Za-zªµºÀ-ÖØ-öø-ſ", "\\p{N}": "0-9²³¹¼-¾", "\\s": "\\t-\\r \\x85\\xa0", "\\S": "\\x00-\\x08\\x0e-\\x1f!-\\x84\\x86-\\x9f¡-\U0010ffff"}
BEYOND = re.compile("[^\\x00-\\u017f\\u0307]")


class Splitter:
    """``findall`` and ``finditer`` of a pattern whose only classes are those of
    LATIN, each in brackets or standing alone."""

    def __init__(self, pattern: str):
        self.any, inside, latin, at = regex.compile(pattern, regex.V0), False, [], 0
        while at < len(pattern):
            part = next((c for c in LATIN if pattern.startswith(c, at)), pattern[at])
            inside = part == "[" or (inside and part != "]")
            latin.append(part if part not in LATIN else LATIN[part] if inside else f"[{LATIN[part]}]")
            at += len(part)
        self.latin = re.compile("".join(latin))

    def of(self, text: str):
        return self.any if BEYOND.search(text) else self.latin

    def findall(self, text: str) -> list[str]:
        return self.of(text).findall(text)

    def finditer(self, text: str):
        return self.of(text).finditer(text)
