"""Quality classifier by co-training of two views.

One view sees only the text (hashed word and character-shape features of the
whole text, as shares, so not its length), the other only the metadata of the page
(source, language, class of n_chars; never the text). Both are logistic regressions trained on labelled rows. In each round
either view labels the rows of an unlabelled pool it is surest of, in the
proportions of the labels, and the other view trains on them too. Scores of each
view are then calibrated on held-back labelled rows (Platt scaling), and the two
calibrated log-odds are combined, each weighted by what it adds on those rows.
The label ``toxic`` is learned in the same way by a model of its own, whose text
view sees the presence of those words that the labelled rows show to matter;
documents it finds toxic are not kept.

The fit uses bounded samples: ``train_rows`` labelled and ``pool_rows``
unlabelled documents at most, each by its whole text, and runs in one task; only
the models reach the driver. The pool has no document with a label. Every
document is scored.

Nulls, ties, repeats: a null text has no text features, a null column its own
metadata feature. Labels other than 0 and 1 and labels of missing documents are
left out; a document with contrary labels counts under each. Without labels of
both kinds every score is 0.5 or the one class's. Repeated rows are scored one
by one; ties in confidence go by a seeded hash of id and text. Very long texts are
hashed in slices, whole. An empty table gives no rows. Columns of the input named
like an output are replaced; no other name matters, but a column ``_meta`` goes.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm.common import mix, text_bytes, word_hashes

TEXT_DIMS = 1 << 13
#: ``toxic`` hangs on a few words, however long the text: their presence in more slots.
WORD_DIMS = 1 << 20
SHAPES = 11
META_DIMS = 1 << 10


def text_features(column: pa.Array, dims: int = TEXT_DIMS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse rows: square-rooted shares of hashed words (with WORD_DIMS their
    presence), and shape features."""
    words, rows = word_hashes(column)
    data, offsets = text_bytes(column)
    slot = SHAPES + (words % np.uint64(dims - SHAPES)).astype(np.int64)
    out = []
    for i in range(len(column)):
        own, raw = words[rows[i] : rows[i + 1]], data[offsets[i] : offsets[i + 1]]
        n, size = len(own), max(1, len(raw))
        kinds = np.bincount(raw, minlength=256)
        upper, lower, digit = kinds[65:91].sum(), kinds[97:123].sum(), kinds[48:58].sum()
        marks = kinds[[35, 36, 37, 38, 42, 60, 62, 124]].sum()
        again = int((own[1:] == own[:-1]).sum())
        pairs = mix(own[1:] * np.uint64(3) + own[:-1])
        shape = np.array(
            [1.0, len(np.unique(own)) / max(1, n), again / max(1, n), len(np.unique(pairs)) / max(1, n - 1), upper / max(1, upper + lower), digit / size, 10 * marks / size, (kinds[33] + kinds[63]) * 10 / size, kinds[10] * 10 / size, min(size / max(1, n), 30) / 10, kinds[195] * 10 / size]
        )
        found, count = np.unique(slot[rows[i] : rows[i + 1]], return_counts=True)
        out.append((np.append(np.arange(SHAPES), found), np.append(shape, np.ones(len(found)) if dims == WORD_DIMS else np.sqrt(count / max(1, n)))))
    return out


def meta_column(docs: DataFrame):
    """array<int>: hashed metadata features (source, lang, class of n_chars, pairs)."""
    values = {c: F.col(c).cast("string") for c in ("source", "lang") if c in docs.columns}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.floor(F.log2(F.greatest("n_chars", F.lit(0)) + 1)).cast("string")
    one = [F.concat(F.lit(f"{c}="), F.coalesce(v, F.lit("?"))) for c, v in values.items()] or [F.lit("none")]
    keys = F.array(*one, *(F.concat(a, F.lit("&"), b) for i, a in enumerate(one) for b in one[i + 1 :]))
    return F.transform(keys, lambda k: (F.pmod(F.xxhash64(k), F.lit(META_DIMS - 1)) + 1).cast("int"))


class View:
    """Logistic regression on sparse rows, by AdaGrad in numpy."""

    def __init__(self, dims: int):
        self.w, self.dims = np.zeros(dims), dims

    def fit(self, rows, labels, epochs: int, rate: float, decay: float, seed: int) -> None:
        self.w, past = np.zeros(self.dims), np.full(self.dims, 1e-3)
        draw = np.random.Generator(np.random.PCG64(seed))
        for _ in range(epochs):
            for i in draw.permutation(len(rows)):
                at, x = rows[i]
                g = (1 / (1 + np.exp(-np.clip(self.w[at] @ x, -30, 30))) - labels[i]) * x + decay * self.w[at]
                past[at] += g * g
                self.w[at] -= rate * g / np.sqrt(past[at])

    def odds(self, rows) -> np.ndarray:
        return np.array([self.w[at] @ x for at, x in rows]) if len(rows) else np.zeros(0)


def platt(odds: np.ndarray, labels: np.ndarray, steps: int = 400) -> tuple[float, float]:
    """(a, b) of the logistic fit of the labels on a x odds + b."""
    a, b = 1.0, 0.0
    scale = max(1.0, float(np.abs(odds).max())) if len(odds) else 1.0
    z = odds / scale
    a *= scale
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        a -= 0.5 * ((p - labels) @ z / len(z) + 1e-3 * a)
        b -= 0.5 * (p - labels).mean()
    return a / scale, b


@dataclass
class CoTrained:
    text: np.ndarray
    meta: np.ndarray
    text_scale: tuple[float, float]
    meta_scale: tuple[float, float]
    weights: tuple[float, float, float]

    def scores(self, column: pa.Array, meta: list[np.ndarray]) -> np.ndarray:
        one = np.array([self.text[at] @ x for at, x in text_features(column, len(self.text))])
        two = np.array([self.meta[0] + self.meta[m].sum() for m in meta])
        z = self.weights[0] * (self.text_scale[0] * one + self.text_scale[1]) + self.weights[1] * (self.meta_scale[0] * two + self.meta_scale[1]) + self.weights[2]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sample(rows: DataFrame, bound: int, seed: int, dims: int, pool: bool) -> DataFrame:
    """(pool, key, label, meta, at, x): features of at most ``bound`` rows."""
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "text")).select("key", "label", "meta", "text")
    share = min(1.0, 1.1 * bound / max(1, rows.count()))
    if share < 1:
        rows = rows.where(F.pmod("key", F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = rows.orderBy("key", "label").limit(bound).repartition(16, "key")

    def run(batches):
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                made = text_features(batch.column("text"), dims)
                yield pa.RecordBatch.from_arrays([pa.array([pool] * len(batch), pa.bool_()), *(batch.column(c) for c in ("key", "label", "meta")), pa.array([r for r, _ in made], pa.list_(pa.int32())), pa.array([x for _, x in made], pa.list_(pa.float32()))], names=["pool", "key", "label", "meta", "at", "x"])

    return rows.mapInArrow(run, "pool boolean, key long, label int, meta array<int>, at array<int>, x array<float>")


def _rows(batches, pools: dict[bool, list]) -> None:
    """Sort the features that come in into the labelled rows and the pool."""
    for b in batches:
        for p, k, y, m, a, x in zip(*(b.column(c).to_pylist() if c in ("pool", "key", "label") else b.column(c) for c in ("pool", "key", "label", "meta", "at", "x")), strict=True):
            pools[p].append((k, y, (np.asarray(a.values), np.asarray(x.values, np.float64)), np.asarray(m.values)))
    for rows in pools.values():
        rows.sort(key=lambda r: (r[0], r[1] or 0))


def telling(rows: list, labels: np.ndarray, dims: int, least: float = 4.0) -> np.ndarray:
    """Mask of the shape features and of the words whose shares of documents differ
    between the labels by ``least`` standard errors."""
    sides = [np.bincount(np.concatenate([r[2][0] for r, y in zip(rows, labels, strict=True) if y == v] or [np.zeros(0, np.int64)]), minlength=dims) for v in (0, 1)]
    n0, n1 = max(1, int((labels == 0).sum())), max(1, int((labels == 1).sum()))
    share = (sides[0] + sides[1]) / (n0 + n1)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n0 + 1 / n1))
    out = (np.abs(sides[1] / n1 - sides[0] / n0) >= least * error) & (sides[0] + sides[1] >= 3)
    out[:SHAPES] = True
    return out


def co_train(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = 3000, pool_rows: int = 3000, rounds: int = 4, take: float = 0.05, epochs: int = 5, seed: int = 5) -> CoTrained:
    dims = WORD_DIMS if label == "toxic" else TEXT_DIMS
    rows = docs.select("doc_id", "text", meta_column(docs).alias("meta"))
    named = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    known = _sample(rows.join(named, "doc_id"), train_rows, seed, dims, False)
    pool = _sample(rows.join(named.select("doc_id"), "doc_id", "left_anti").withColumn("label", F.lit(None).cast("int")), pool_rows, seed + 1, dims, True)

    def fit(batches):
        pools: dict[bool, list] = {False: [], True: []}
        _rows(batches, pools)
        model = _fit(pools[False], pools[True], dims, rounds, take, epochs, seed)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    return pickle.loads(known.unionByName(pool).repartition(1).mapInArrow(fit, "model binary").first()["model"])


def _fit(known: list, pool: list, dims: int, rounds: int, take: float, epochs: int, seed: int) -> CoTrained:
    views = (lambda r: r[2]), (lambda r: (np.append(0, r[3]), np.ones(len(r[3]) + 1)))
    y = np.array([r[1] for r in known], float)
    cut = len(known) * 3 // 4
    text, meta = View(dims), View(META_DIMS)
    if not len(known) or y.min() == y.max():
        level = 0.0 if not len(known) else (3.0 if y[0] else -3.0)
        return CoTrained(text.w, meta.w, (1.0, 0.0), (1.0, 0.0), (0.0, 0.0, level))
    if dims == WORD_DIMS:
        mask = telling(known[:cut], y[:cut], dims)
        known, pool = ([(*r[:2], (r[2][0][mask[r[2][0]]], r[2][1][mask[r[2][0]]]), r[3]) for r in part] for part in (known, pool))
    models, extra = (text, meta), ([], [])
    free = list(range(len(pool)))
    for _ in range(rounds + 1):
        for m, see, more in zip(models, views, extra, strict=True):
            m.fit([see(r) for r in known[:cut]] + [see(pool[i]) for i, _ in more], np.append(y[:cut], [v for _, v in more]), epochs, 0.3, 1e-5, seed)
        if not free:
            break
        given: set[int] = set()
        for k, (m, see) in enumerate(zip(models, views, strict=True)):
            order = [free[i] for i in np.argsort(m.odds([see(pool[i]) for i in free]), kind="stable")]
            n = max(1, int(take * len(order)))
            good = int(round(n * y.mean()))
            picked = [(i, 0.0) for i in order[: n - good]] + [(i, 1.0) for i in order[len(order) - good :]]
            extra[1 - k].extend(picked)
            given |= {i for i, _ in picked}
        free = [i for i in free if i not in given]
    held, truth = (known[cut:], y[cut:]) if len(set(y[cut:])) == 2 else (known, y)
    odds = [m.odds([see(r) for r in held]) for m, see in zip(models, views, strict=True)]
    scales = [platt(o, truth) for o in odds]
    z = np.stack([a * o + b for (a, b), o in zip(scales, odds, strict=True)])
    weights, bias = np.array([1.0, 0.0]), 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(weights @ z + bias, -30, 30)))
        weights -= 0.1 * (z @ (p - truth) / len(truth) + 1e-3 * weights)
        bias -= 0.1 * (p - truth).mean()
    return CoTrained(text.w, meta.w, scales[0], scales[1], (float(weights[0]), float(weights[1]), float(bias)))


def score(docs: DataFrame, model: CoTrained, threshold: float = 0.3, toxic: CoTrained | None = None, toxic_threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``quality_score`` double and ``kept`` boolean; with a model of
    ``toxic`` also ``toxic_score`` double, and documents that reach its threshold
    are not kept. Columns of these names in the input are replaced."""
    names = ["quality_score", "kept"] if toxic is None else ["quality_score", "toxic_score", "kept"]
    docs = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast((model, toxic))

    def run(batches):
        good, bad = shared.value
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                text, meta = batch.column("text"), [np.asarray(x.values) for x in batch.column("_meta")]
                made = [good.scores(text, meta)]
                kept = made[0] >= threshold
                if bad is not None:
                    made.append(bad.scores(text, meta))
                    kept &= made[1] < toxic_threshold
                keep = [c for c in batch.schema.names if c != "_meta"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(m) for m in made), pa.array(kept)], names=[*keep, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    added = ", ".join(f"{n} {'boolean' if n == 'kept' else 'double'}" for n in names)
    return docs.withColumn("_meta", meta_column(docs)).mapInArrow(run, f"{fields}, {added}")
