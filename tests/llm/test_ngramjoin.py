import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from redactory.llm.ngramjoin import most_common, ngram_components
from redactory.llm.queries import op12_ngram_join
from tests.llm.common import edge_rows, sentence
from tests.llm.test_neardup import brute, family

SCHEMA = "doc_id long, text string"


@given(st.sets(st.integers(0, 300), min_size=1), st.sets(st.integers(0, 300), min_size=1), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_suffix_filter_never_drops_a_link(x, y, parts):
    a, b = (np.array(sorted(z), np.uint64) for z in (x, y))
    assert len(x & y) <= most_common(a, b, parts) <= min(len(x), len(y))


@pytest.mark.parametrize("large", [4, 64])
def test_components_match_brute_force(spark, large):
    """Families around the threshold, a passage in many texts, short texts, chains."""
    rng = random.Random(15)
    passage = sentence(rng, 60)
    texts = family(rng, 90, 120, 6) + family(rng, 40, 90, 2) + [f"{passage} {sentence(rng, rng.randrange(5, 90))}" for _ in range(60)]
    texts += [sentence(rng, 50) for _ in range(20)] + ["a b", "A  b", "a b c d e", "a b c d e f", "x"]
    chain = sentence(rng, 100, 10**6).split()
    for i in range(25):
        chain = chain[1:] + [f"c{i}"] if i % 2 else [f"d{i}", *chain[:-1]]
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute(rows, 5, 80, 100)
    got = ngram_components(spark.createDataFrame(rows, SCHEMA), large=large).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) < len(texts) - 60


@pytest.mark.parametrize("words, num, den", [(2, 60, 100), (3, 95, 100), (5, 100, 100)])
def test_other_thresholds(spark, words, num, den):
    rng = random.Random(words)
    rows = list(enumerate(family(rng, 40, 60, 8) + family(rng, 20, 30, 3)))
    got = ngram_components(spark.createDataFrame(rows, SCHEMA), words, num, den).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, words, num, den)


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = op12_ngram_join(spark, sf).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute([tuple(r) for r in docs], 5, 80, 100)


def test_odd_rows(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in edge_rows()], SCHEMA + ", node long, prefix string")
    got = ngram_components(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(edge_rows()) and by[6].component_id == by[5].component_id == 5
    assert [(by[i].n_shingles, by[i].component_id) for i in (1, 2, 3)] == [(0, 1), (0, 2), (0, 3)]
    assert by[None].component_id is None and by[7].n_shingles == 1 and by[4].component_id == 4
    assert ngram_components(df.limit(0)).collect() == []
    named = spark.createDataFrame([("b", "one two"), ("a", "ONE two")], "doc_id string, text string")
    assert {tuple(r) for r in ngram_components(named).collect()} == {("a", 1, "a"), ("b", 1, "a")}
