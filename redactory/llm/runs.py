"""Periodic runs of words, found online by catchers of squares.

A run is a maximal stretch with smallest period q that holds at least ``least``
periods. Words are appended in portions. Whenever a block of 2**k words is complete
it gets a catcher, which watches the words appended later for the block's return at
a distance p of 2**(k+1) - 1 to 2**(k+2) - 2. In a stretch of period p each block of
that size returns after p words, so four neighbouring blocks that return at one
distance are a square, which suffix comparisons grow to both sides; each portion
appended grows it on until a word differs. Squares of one period that touch are
one run by that. Where a run of a period of at most 2**k covers a block up to its
return, that return tells nothing new and is left out; this also bounds the work:
a portion costs its words times the number of levels.

Documents of a batch are appended to one stream, parted by marks that equal no word.
Words are numbered by a dictionary, so equal numbers mean equal words. Windows are
named by hashes, whose hits are confirmed word by word.

Nulls, ties, repeats: a null, empty or blank text has no words and no run. A null
id is a document like others, whose words are never replaced. Rows that repeat an
id are returned one by one. Of runs with equal exponent the one that starts first,
then the one of smaller period is the greatest. A very long text is appended in
portions; its words are held by one task. Other columns take no part, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from redactory.llm.common import mix

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PORTION = 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)
_NO_HITS = np.zeros((2, 0), np.int64)


class _Level:
    """The catchers of one block size."""

    def __init__(self, k: int):
        self.size, self.low, self.high = 1 << k, (2 << k) - 1, (4 << k) - 2
        self.names = np.zeros(0, np.uint64)  # of the windows that begin at self.base, self.base + 1, ...
        self.base = self.done = 0  # windows that begin before ``done`` have been compared
        self.waiting = _NO_HITS  # (p, block) of groups that may still go on

    def extend(self, names: np.ndarray, at: int) -> None:
        """Take the names of the windows from ``at`` on; forget those no catcher reaches."""
        old = self.names[: at - self.base]
        least = max(self.base, min(self.done, at) - self.high - self.size)
        self.names, self.base = np.concatenate([old[least - self.base :], names]), least

    def hits(self, reach: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """(p, block): returns of blocks among the windows named since the last call."""
        stop, found = self.base + len(self.names), []
        first, last = max(0, -(-(self.done - self.high) // self.size)), (stop - 1 - self.low) // self.size
        rows = max(1, (1 << 20) // (self.high - self.low + 1))
        for at in range(first, last + 1, rows):
            blocks = np.arange(at, min(at + rows, last + 1))
            begins = blocks * self.size
            spans = np.arange(self.low, self.high + 1)
            j = begins[:, None] + spans
            new = (j >= self.done) & (j < stop)
            new &= j + self.size > reach(begins)[:, None]
            new &= self.names[np.where(new, j, stop - 1) - self.base] == self.names[begins - self.base][:, None]
            b, p = np.nonzero(new)
            found.append(np.stack([spans[p], blocks[b]]))
        self.done = max(self.done, stop)
        return np.concatenate(found, axis=1) if found else _NO_HITS


class Catchers:
    """Runs of the words appended so far; ``longest`` bounds the periods looked for."""

    def __init__(self, least: int = 4, longest: int | None = None):
        self.words, self.n, self.least, self.longest = np.zeros(1024, np.int64), 0, max(4, least), longest
        self.levels: list[_Level] = []
        self.growing: list[list[int]] = []  # [p, first, end]: words[i] == words[i + p] for first <= i < end
        self.closed: list[tuple[int, int, int]] = []

    def append(self, words: np.ndarray) -> None:
        before, self.n = self.n, self.n + len(words)
        if self.n > len(self.words):
            self.words = np.concatenate([self.words[:before], np.zeros(max(self.n, 2 * before) - before, np.int64)])
        self.words[before : self.n] = words
        self._grow()
        # a level begins with its first block, while the level below still has all names
        while 1 << len(self.levels) <= self.n and (self.longest is None or (2 << len(self.levels)) - 1 <= self.longest):
            self.levels.append(_Level(len(self.levels)))
        for k, level in enumerate(self.levels):
            self._advance(k, level)

    def _grow(self) -> None:
        """Suffix comparisons of the open squares with the words just appended."""
        still = []
        for run in self.growing:
            run[2] = self._end(run[2], run[0])
            if run[2] + run[0] == self.n:
                still.append(run)
            elif run[2] - run[1] >= (self.least - 1) * run[0]:
                self.closed.append(tuple(run))
        self.growing = still

    def _end(self, at: int, p: int) -> int:
        """The first place from ``at`` on whose word does not return after p words."""
        width = 64
        while at + p < self.n:
            width = min(2 * width, self.n - p - at)
            differ = np.flatnonzero(self.words[at : at + width] != self.words[at + p : at + p + width])
            if len(differ):
                return at + int(differ[0])
            at += width
        return at

    def _begin(self, at: int, p: int) -> int:
        """The first place of the stretch before ``at`` whose words return after p words."""
        width = 64
        while at > 0:
            width = min(2 * width, at)
            differ = np.flatnonzero(self.words[at - width : at] != self.words[at + p - width : at + p])
            if len(differ):
                return at - width + int(differ[-1]) + 1
            at -= width
        return at

    def _advance(self, k: int, level: _Level) -> None:
        at = level.base + len(level.names)
        stop = self.n - level.size + 1
        if stop <= at:
            return
        if k:
            below, half = self.levels[k - 1], level.size // 2
            left, right = (below.names[at + x - below.base : stop + x - below.base] for x in (0, half))
            names = mix(left * _STEP + right)
        else:
            names = mix(self.words[at:stop].astype(np.uint64) + np.uint64(1))
        level.extend(names, at)
        hits = np.concatenate([level.waiting, level.hits(self._cover(level))], axis=1)
        if not hits.shape[1]:
            return
        p, block = hits[:, np.lexsort(hits[::-1])]
        edges = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (block[1:] != block[:-1] + 1)))
        counts = np.diff(np.append(edges, len(p)))
        ends = edges + counts - 1
        open_ = (block[ends] + 1) * level.size + p[ends] >= level.done
        short = counts < 4
        keep = np.repeat(open_ & short, counts)
        level.waiting = np.stack([p[keep], block[keep]])
        for at in np.flatnonzero(~short):
            self._caught(int(p[edges[at]]), int(block[edges[at]]) * level.size, (int(block[ends[at]]) + 1) * level.size)

    def _cover(self, level: _Level) -> Callable[[np.ndarray], np.ndarray]:
        """Place -> how far known runs of a period of at most the block reach from there."""
        known = sorted((a, e + p) for p, a, e in [*self.closed, *self.growing] if p <= level.size)
        starts = np.array([x[0] for x in known], np.int64)
        reach = np.maximum.accumulate(np.array([0, *(x[1] for x in known)], np.int64))
        return lambda places: reach[np.searchsorted(starts, places, side="right")]

    def _caught(self, p: int, begin: int, end: int) -> None:
        """A group of returns at distance p: confirm it, grow it, keep it."""
        if any(run[0] == p and run[1] <= begin and end <= run[2] for run in self.growing):
            return
        at = begin
        while at < end:
            to = self._end(at, p)
            first = self._begin(at, p) if at == begin else at
            if to + p == self.n:
                self.growing.append([p, first, to])
            elif to - first >= (self.least - 1) * p:
                self.closed.append((p, first, to))
            at = to + 1

    def runs(self, shortest: int = 0) -> list[tuple[int, int, int]]:
        """(start, length, period) so far, by start, then period."""
        found: dict[tuple[int, int], int] = {}
        for p, first, end in [*self.closed, *self.growing]:
            if end - first >= (self.least - 1) * p and end - first + p >= shortest:
                at = first, end - first + p
                found[at] = min(p, found.get(at, p))  # a multiple of the period has the same stretch
        return sorted((a, n, p) for (a, n), p in found.items())


def repeat_tail(words: list[str], doc_id: object) -> list[str]:
    """For one id in ten, words from some place on replaced by copies of the first
    few of them: stretches of known period for a check of the operator."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def runs_of(texts: list[list[str]], least: int = 4, shortest: int = 6, portion: int = PORTION) -> list[list[tuple[int, int, int]]]:
    """The runs of each list of words, all appended to one stream."""
    numbers: dict[str, int] = {}
    parts, starts, at = [], [], 0
    for i, words in enumerate(texts):
        starts.append(at)
        parts.append(np.array([*(numbers.setdefault(w, len(numbers)) for w in words), -2 - i], np.int64))
        at += len(words) + 1
    catchers = Catchers(least, max([0, *map(len, texts)]) // least)
    stream = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    for begin in range(0, len(stream), portion):
        catchers.append(stream[begin : begin + portion])
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, length, period in catchers.runs(shortest):
        i = int(np.searchsorted(starts, start, side="right")) - 1
        found[i].append((start - starts[i], length, period))
    return found


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """``words`` without what each run repeats after its first period."""
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"
RESULT = f"n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs {RUN}, collapsed string"


def find_runs(docs: DataFrame, least: int = 4, shortest: int = 6, replace: Callable[[list[str], object], list[str]] | None = None, texts: bool = True, words_at_once: int = PORTION) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli of the greatest run,
    digests of all runs and of the collapsed text, runs, collapsed), one row for
    each row of ``docs``. ``texts``: also return runs and collapsed, else null.
    ``replace`` (words, id) may change a document's words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, size = [], [], 0
            for i, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)):
                words = WORD.findall(text.as_py() or "")
                held.append(replace(words, doc_id) if replace else words)
                ids.append(i)
                size += len(words)
                if size >= words_at_once:
                    yield out(batch, ids, held)
                    ids, held, size = [], [], 0
            if ids:
                yield out(batch, ids, held)

    def out(batch: pa.RecordBatch, ids: list[int], held: list[list[str]]) -> pa.RecordBatch:
        rows = []
        for words, runs in zip(held, runs_of(held, least, shortest), strict=True):
            kept = " ".join(collapse(words, runs) if runs else words)
            start, length, period = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
            digest = _sha("".join(f"{s},{n},{p}\n" for s, n, p in runs))
            listed = [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs]
            rows.append((len(runs), start, length, period, length and 1000 * length // period, digest, _sha(kept), listed if texts else None, kept if texts else None))
        types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        names = [part.split()[0] for part in RESULT.replace(RUN, "list").split(", ")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids)), *columns], names=["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {RESULT}")
