import random

import pytest

from pyspark.sql import functions as F

from redactory.llm.neardup import _heads, drop_near_duplicates, least_matches, near_duplicates
from redactory.llm.queries import op7_minhash_neardup
from tests.llm.common import edge_rows, sentence, shingles


def brute(rows, n, num, den):
    ids = [d for d, _ in rows]
    sets = {d: shingles(t, n) for d, t in rows}
    up = {d: d for d in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def family(rng, n, length, most):
    base = sentence(rng, length).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(most)):
            w[rng.randrange(length)] = f"m{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("large", [4, 64])
def test_components_match_brute_force(spark, large):
    rng = random.Random(5)
    texts = family(rng, 90, 120, 14) + family(rng, 12, 60, 4) + [sentence(rng, 50) for _ in range(40)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, num=85, den=100, large=large).collect()
    want = brute(rows, 3, 85, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edges(spark):
    df = spark.createDataFrame([(*r, "x") for r in edge_rows()], "doc_id long, text string, keys string")
    got = near_duplicates(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(edge_rows())
    assert by[6].component_id == 5 and not by[6].kept and by[5].kept
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].kept and by[2].component_id == 2
    assert by[None].component_id is None and by[None].kept and by[7].n_shingles == 1
    assert near_duplicates(df.limit(0)).count() == 0
    left = drop_near_duplicates(df)
    # 8 is 5's text behind two more words: 46 of 48 shingles are common; 5 stands twice
    assert left.columns == df.columns and not {6, 8} & {r.doc_id for r in left.collect()} and left.count() == len(got) - 3


def test_repeated_ids_are_judged_by_their_own_text(spark):
    rng = random.Random(2)
    a, b = sentence(rng, 60), sentence(rng, 60)
    rows = [(5, a), (5, b), (3, a + " x"), (9, b + " y"), (9, "one of its own " + sentence(rng, 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
    assert got == {(5, 56, 3), (5, 56, 5), (3, 57, 3), (9, 57, 5), (9, 30, 9)}
    left = {(r.doc_id, r.text) for r in drop_near_duplicates(df).collect()}
    assert left == {(3, a + " x"), (5, b), rows[4]}
    named = spark.createDataFrame([("b", a), ("a", a), ("c", b)], "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(named).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


def test_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op7_minhash_neardup(spark, sf).collect()}
    assert got == brute(rows, 3, 85, 100)


def test_sequential_bounds():
    steps = least_matches(130, 26, 0.85, 1e-9)
    assert [n for n, _ in steps] == [26, 52, 78, 104, 130]
    assert all(m < 0.85 * n for n, m in steps) and steps[-1][1] > 60


def test_copies_meet_on_few_of_their_shingles(spark):
    """A group of near copies is not paired on every shingle they share."""
    mine = spark.createDataFrame([(n, s) for n in range(60) for s in range(100) if (n * 7 + s) % 50], "node long, shingle long")
    facts = spark.createDataFrame([(n, 100, 0, n) for n in range(60)], "node long, size long, hot long, component long")
    head = _heads(mine, facts, 64, 80, 100)
    assert head.count() <= 60 * 21
    pairs = head.alias("x").join(head.alias("y"), "shingle").where("x.node < y.node").select("x.node", "y.node").distinct()
    assert pairs.count() == 60 * 59 // 2  # all of them link, and none is lost
    # 98 cold shingles of 130 are fewer than a link needs
    assert _heads(mine, facts.withColumn("size", F.lit(130)), 64, 80, 100).count() == 0
    # beside hot ones a single shared cold one may be enough
    assert _heads(mine, facts.withColumn("hot", F.lit(90)), 64, 80, 100).count() == mine.count()
