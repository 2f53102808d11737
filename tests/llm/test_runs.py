import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from redactory.llm.queries import op11_periodic_runs
from redactory.llm.runs import Catchers, find_runs, runs_of
from tests.llm.common import WORD, edge_rows


def brute(words, least=4, shortest=6):
    """Every maximal stretch of each period, the smallest period of each stretch."""
    found = {}
    for p in range(1, len(words) // least + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(shortest, least * p) and j > i:
                found.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((a, n, p) for (a, n), p in found.items())


def expected(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def periodic(rng):
    """Words of nested and neighbouring repeats of all sizes."""
    out = []
    for _ in range(rng.randrange(1, 6)):
        unit = [rng.randrange(rng.choice((2, 3, 50))) for _ in range(rng.choice((1, 2, 3, 7, 8, 15, 16, 31, 60)))]
        if rng.random() < 0.4:
            unit = unit * rng.randrange(2, 6) + [99]
        out += (unit * rng.randrange(1, 9))[: rng.randrange(1, 400)]
        if rng.random() < 0.4:
            out += [rng.randrange(100) for _ in range(rng.randrange(9))]
    return out


def test_runs_against_brute_force():
    rng = random.Random(5)
    texts = [[str(w) for w in periodic(rng)] for _ in range(250)]
    texts += [[rng.choice("ab") for _ in range(rng.randrange(120))] for _ in range(150)]
    want = [brute(t) for t in texts]
    assert sum(map(len, want)) > 500
    for portion in (1 << 16, 97):
        assert runs_of(texts, portion=portion) == want
    assert runs_of([texts[0]]) == want[:1] and runs_of([]) == [] and runs_of([[], ["a"]]) == [[], []]


def test_words_appended_one_by_one():
    rng = random.Random(6)
    for _ in range(25):
        words = periodic(rng)[:300]
        one = Catchers()
        for i, w in enumerate(words):
            one.append(np.array([w]))
            if i % 50 == 0:
                assert one.runs(6) == brute(words[: i + 1])
        assert one.runs(6) == brute(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(1, 40))
def test_any_words_in_any_portions(words, portion):
    assert runs_of([[str(w) for w in words]], portion=portion) == [brute([str(w) for w in words])]


def test_long_repeats_take_no_quadratic_time():
    for unit in (["a"], ["a", "b"], [str(i) for i in range(33)], [str(i % 77) for i in range(5000)]):
        words = unit * (300_000 // len(unit))
        assert (0, len(words), len(unit)) in runs_of([words])[0]


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    short = docs.where("size(split(text, ' ')) < 1500 or text is null").collect()
    got = {r.doc_id: tuple(r) for r in op11_periodic_runs(spark, sf).collect()}
    assert len(got) == docs.count() and len(short) > 150
    assert all(got[r.doc_id] == expected(r.doc_id, r.text) for r in short)
    assert sum(got[r.doc_id][1] > 0 for r in short) > 5


def test_odd_rows(spark):
    from redactory.llm.runs import repeat_tail

    rows = [(*r, "s") for r in edge_rows()]
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows], "doc_id long, text string, runs string, start int")
    got = [tuple(r)[:8] for r in find_runs(docs, replace=repeat_tail).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[7])
    assert sorted(got, key=key) == sorted((expected(i, t) if len(t or "") < 10_000 else next(g for g in got if g[0] == i) for i, t, _ in rows), key=key)
    texts = {r.doc_id: (r.collapsed, r.runs) for r in find_runs(spark.createDataFrame([("x", "so so so so so so it is")], "doc_id string, text string")).collect()}
    assert texts["x"][0] == "so it is" and [tuple(r) for r in texts["x"][1]] == [(0, 6, 1)]
    assert find_runs(docs.limit(0)).collect() == []
