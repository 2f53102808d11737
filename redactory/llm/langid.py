"""Language ID: averaged hashed subword embeddings under a linear softmax.

A text's words (maximal runs of letters, lower-cased) are padded with a mark and
cut into character n-grams; each n-gram is hashed to a row of an embedding
table. The mean of the rows feeds a linear softmax. Table and softmax are
trained by stochastic gradient descent in numpy, in one task, on a bounded sample
of labelled rows: ``train_rows`` documents at most, each by its whole text, dealt
over the languages so that a rare one is not crowded out. Only the finished
model reaches the driver.

Rejection is calibrated on held-back sample rows by two bounds, each of which at
most ``reject_rate`` of the rightly predicted ones miss: the score (a temperature
makes it a probability), and the familiarity, the mean log-probability of the
text's n-grams in the predicted language, in standard deviations for its length.
Junk and languages never seen may score high, but their n-grams are not familiar.

Nulls, ties, repeats: a null text, or one without letters, is ``und`` with score
0 and rejected. Ties go to the first language in alphabetical order. Without any
labelled row every text is ``und``. Rows are predicted one by one, so repeats,
ids and other columns do not matter; very long texts are read in slices, whole.
Rows equal in id, text and language count once in the sample. An empty table
gives an empty result; columns named like an output are replaced.
"""

from __future__ import annotations

import pickle
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactory.llm.common import mix

SIZES = (2, 3, 4)
SLICE_CHARS = 1 << 18
NO_LETTER = re.compile(r"[\W\d_]")
_fold: np.ndarray | None = None


def _folding() -> np.ndarray:
    """Code point -> lower-cased code point if a letter, else 0."""
    global _fold
    if _fold is None:
        table = np.zeros(sys.maxunicode + 1, np.uint32)
        for c in range(sys.maxunicode + 1):
            if (s := chr(c)).isalpha():
                table[c] = ord(low) if len(low := s.lower()) == 1 else c
        _fold = table
    return _fold


def slices(texts: list[str | None]) -> Iterator[tuple[list[str], np.ndarray]]:
    """(pieces, index of the text each is from), about SLICE_CHARS characters at a
    time. A longer text is cut where no word is cut, so its n-grams stay the same."""
    pieces, owner, size = [], [], 0
    for i, text in enumerate(texts):
        text, at = text or "", 0
        while at < len(text) or not at:
            stop = at + SLICE_CHARS - size
            if stop < len(text):
                cut = NO_LETTER.search(text, stop)
                stop = cut.end() if cut else len(text)
            pieces.append(text[at:stop])
            owner.append(i)
            size += len(pieces[-1])
            at = max(stop, 1)
            if size >= SLICE_CHARS:
                yield pieces, np.array(owner)
                pieces, owner, size = [], [], 0
    if pieces:
        yield pieces, np.array(owner)


def ngram_rows(texts: list[str], n_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size of n-grams: (table row of each, text it is from, in order)."""
    joined = "\n".join(texts)
    points = _folding()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)[: len(points)]
    # one mark between words: drop a mark that follows another
    keep = points != 0
    keep[1:] |= points[:-1] != 0
    points, owner = np.concatenate([[0], points[keep], [0]]).astype(np.uint64), np.concatenate([[0], owner[keep], [len(texts) - 1]])
    letter = points != 0
    for n in SIZES:
        m = len(points) - n + 1
        if m <= 0:
            continue
        value = np.full(m, n, np.uint64)
        for k in range(n):
            value *= np.uint64(0x100000001B3)
            value += points[k : k + m]
        inner = np.ones(m, bool)
        for k in range(1, n - 1):
            inner &= letter[k : k + m]
        if n == 2:  # a pair may be a mark and a letter, not two marks
            inner = letter[:m] | letter[1 : m + 1]
        at = np.flatnonzero(inner)
        yield (mix(value[at]) % np.uint64(n_rows)).astype(np.int64), np.where(letter[at], owner[at], owner[np.minimum(at + 1, len(owner) - 1)])


def _sums(values: np.ndarray, owner: np.ndarray, out: np.ndarray, at: np.ndarray) -> None:
    """Add the rows of ``values``, which lie in runs of one owner, to ``out[at[owner]]``."""
    if len(owner):
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        np.add.at(out, at[owner[starts]], np.add.reduceat(values, starts, axis=0, dtype=np.float64))


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # n-gram rows x dims; folded with the softmax when that is no wider
    head: np.ndarray | None
    bias: np.ndarray
    temperature: float
    threshold: float
    #: n-gram rows x languages: log-probabilities; their mean and spread, and that of documents
    usual: np.ndarray = field(default_factory=lambda: np.zeros((1, 0), np.float32))
    spread: np.ndarray = field(default_factory=lambda: np.zeros((3, 0)))
    least_familiar: float = -np.inf

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(logits, best language, its familiarity); nan for texts without a letter."""
        counts, sums = np.zeros(len(texts)), np.zeros((len(texts), self.table.shape[1]))
        found = []
        for pieces, at in slices(texts):
            for rows, owner in ngram_rows(pieces, len(self.table)):
                _sums(self.table[rows], owner, sums, at)
                counts += np.bincount(at[owner], minlength=len(texts))
                found.append((rows.astype(np.int32), at[owner].astype(np.int32)))
        mean = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], np.nan)
        logits = (mean if self.head is None else mean @ self.head) + self.bias
        best = np.where(counts > 0, np.nan_to_num(logits).argmax(axis=1), 0)
        usual, everyone = np.zeros(len(texts)), np.arange(len(texts))
        for rows, owner in found:
            _sums(self.usual[rows, best[owner]], owner, usual, everyone)
        own = self.spread[:, best]
        return logits, best, self.familiarity(usual / np.maximum(counts, 1), counts, own)

    @staticmethod
    def familiarity(mean: np.ndarray, counts: np.ndarray, spread: np.ndarray) -> np.ndarray:
        centre, between, within = spread
        return (mean - centre) / np.sqrt(between + within / np.maximum(counts, 1))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, whether rejected) of each text."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        logits, best, usual = self.read(texts)
        known = ~np.isnan(logits[:, 0])
        top = np.where(known, _softmax(np.nan_to_num(logits) / self.temperature).max(axis=1), 0.0)
        return [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], top, ~known | (top < self.threshold) | (usual < self.least_familiar)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def shares(counts: dict[str, int], total: int) -> dict[str, int]:
    """``total`` rows dealt over languages: equal shares, and what a language is
    short of goes to the others."""
    out, left = {}, total
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, left // (len(counts) - i))
        left -= out[lang]
    return out


def labelled_sample(docs: DataFrame, allowed: Column, train_rows: int, seed: int) -> DataFrame:
    """(lang, key, text): at most ``train_rows`` labelled rows, drawn by a hash of
    id and text within each language (the ``train_rows`` most frequent ones)."""
    key = F.xxhash64(F.lit(seed), "doc_id", "text").alias("key")
    pool = docs.where(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), key, "text")
    counts = {r["lang"]: r["n"] for r in pool.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(train_rows).collect()}
    given = [(lang, n, min(1.0, (2 * n + 50) / counts[lang])) for lang, n in shares(counts, train_rows).items() if n]
    quota = docs.sparkSession.createDataFrame(given, "lang string, quota int, share double")
    # a draw by hash bounds what is ranked; rows that share a key are one
    near = pool.join(F.broadcast(quota), "lang").where(F.pmod("key", F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("lang", "key", "quota").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    picked = near.withColumn("rank", rank).where(F.col("rank") <= max([1, *(n for _, n, _ in given)])).where("rank <= quota").select("lang", "key")
    return pool.join(F.broadcast(picked), ["lang", "key"], "left_semi").dropDuplicates(["lang", "key"])


def _joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    rows, which = np.unique(np.concatenate([r for r, _ in parts]), return_inverse=True)
    return rows, np.bincount(which, np.concatenate([n for _, n in parts]))


def _features(sample: DataFrame, n_rows: int) -> DataFrame:
    """(lang, key, rows, counts): distinct n-gram table rows of each text, uint32."""

    def count(batches):
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                parts: list[list] = [[] for _ in range(len(batch))]
                for pieces, of in slices(batch.column("text").to_pylist()):
                    keys = np.concatenate([np.zeros(0, np.int64), *(owner.astype(np.int64) * n_rows + rows for rows, owner in ngram_rows(pieces, n_rows))])
                    found, n = np.unique(keys, return_counts=True)
                    for i, a, b in zip(of, *np.searchsorted(found // n_rows, [np.arange(len(of)), np.arange(1, len(of) + 1)]), strict=True):
                        parts[i].append((found[a:b] % n_rows, n[a:b]))
                made = [p[0] if len(p) == 1 else _joined(p) for p in parts]
                blobs = [pa.array([m[k].astype(np.uint32).tobytes() for m in made], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("key"), *blobs], names=["lang", "key", "rows", "counts"])

    return sample.mapInArrow(count, "lang string, key long, rows binary, counts binary")


def _fit(sample: list, n_rows: int, dims: int, epochs: int, rate: float, reject_rate: float, seed: int) -> Model:
    """The model of a sample of (lang, n-gram rows, counts)."""
    languages = sorted({x[0] for x in sample})
    draw = np.random.Generator(np.random.PCG64(seed))
    table, head, bias = draw.normal(0, 0.1, (n_rows, dims)), np.zeros((dims, len(languages))), np.zeros(len(languages))
    if not languages:
        return Model([], table[:1], None, bias, 1.0, 0.0)
    sample = [sample[i] for i in draw.permutation(len(sample))]
    wanted = np.array([languages.index(x[0]) for x in sample])
    cut = max(1, len(sample) * 3 // 4)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in draw.permutation(cut):
            _, rows, counts = sample[i]
            share = (counts / counts.sum())[:, None]
            mean = (table[rows] * share).sum(axis=0)
            error = _softmax(mean @ head + bias)
            error[wanted[i]] -= 1
            back = head @ error
            head -= step * 0.1 * np.outer(mean, error)
            bias -= step * 0.01 * error
            table[rows] -= step * share * back
    seen = np.full((n_rows, len(languages)), 0.5, np.float64)
    for (_, rows, counts), w in zip(sample[:cut], wanted[:cut], strict=True):
        seen[rows, w] += counts
    usual = np.log(seen / seen.sum(axis=0)).astype(np.float32)
    held = list(range(cut, len(sample))) or list(range(len(sample)))
    right = wanted[held]
    totals = np.array([sample[i][2].sum() for i in held])
    means = np.array([(usual[sample[i][1]] * (sample[i][2] / sample[i][2].sum())[:, None]).sum(axis=0) for i in held])
    squares = np.array([(usual[sample[i][1]] ** 2 * (sample[i][2] / sample[i][2].sum())[:, None]).sum(axis=0) for i in held])
    spread = np.zeros((3, len(languages)))
    for k in range(len(languages)):
        mine = means[right == k, k] if (right == k).any() else means[:, k]
        inside = (squares - means**2)[right == k, k] if (right == k).any() else (squares - means**2)[:, k]
        spread[:, k] = mine.mean(), mine.var() + 1e-3, inside.mean()
    logits = np.array([(table[sample[i][1]] * (sample[i][2] / sample[i][2].sum())[:, None]).sum(axis=0) @ head + bias for i in held])
    picked = (np.arange(len(right)), right)
    temperature = min((float(t) for t in np.geomspace(0.1, 10, 60)), key=lambda t: -np.log(_softmax(logits / t)[picked] + 1e-12).mean())
    scores = _softmax(logits / temperature)
    hit = scores.argmax(axis=1) == right
    narrow = len(languages) <= dims
    model = Model(languages, (table @ head if narrow else table).astype(np.float32), None if narrow else head, bias, temperature, 0.0, usual, spread)
    if hit.any():
        lowest = lambda x: float(np.sort(x)[int(reject_rate * len(x))])
        model.threshold = lowest(scores.max(axis=1)[hit])
        # twice as far out as the least familiar held-back rows: clean texts stay
        model.least_familiar = min(-4.0, 2 * lowest(model.familiarity(means[picked], totals, spread[:, right])[hit]))
    return model


def train(docs: DataFrame, allowed: Column | None = None, train_rows: int = 4000, n_rows: int = 1 << 16, dims: int = 16, epochs: int = 4, rate: float = 8.0, reject_rate: float = 0.001, seed: int = 3) -> Model:
    """Fit the model on rows of ``docs`` (doc_id, text, lang) where ``allowed``."""
    sample = _features(labelled_sample(docs, F.lit(True) if allowed is None else allowed, train_rows, seed), n_rows)

    def fit(batches):
        rows = [row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("key", "lang", "rows", "counts")), strict=True) if row[2]]
        held = [(lang, np.frombuffer(r, np.uint32), np.frombuffer(c, np.uint32).astype(np.float32)) for _, lang, r, c in sorted(rows)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_fit(held, n_rows, dims, epochs, rate, reject_rate, seed))], pa.binary())], names=["model"])

    return pickle.loads(sample.repartition(1).mapInArrow(fit, "model binary").first()["model"])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected``; only ``text`` is read
    by the model. Columns of these names in the input are replaced."""
    own = ("lang_pred", "score", "rejected")
    docs = docs.drop(*own)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for whole in batches:
            for at in range(0, len(whole), 512):
                batch = whole.slice(at, 512)
                names, scores, rejected = m.predict(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*batch.schema.names, *own])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double, rejected boolean")
