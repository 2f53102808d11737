"""Terms by automaton equal one pattern a term; the corpus-wide join has no nested loop."""

import random
import time

import pytest
from pyspark.sql import functions as F

from redactory.operators import scan
from redactory.operators.dictionary import Dictionary, find_terms
from redactory.operators.scan import CASE_STOPS, matches, scan_terms

WORDS = ["Ann", "ann", "ANN", "Lee", "Lee's", "ACME", "Acme", "acme", "Bank", "of", "May", "MAY", "o'Brien", "é", "Éa", "naïve", "漢字", "😀", "x1", "A&B", "b.", "(c)", "$9", "Ban", "kof", "İstanbul", "K", "s", "ſ", "B-2", "_"]


def by_patterns(docs, terms, *key):
    """One regular expression for each term and text."""
    pairs = docs.join(terms, "doc_id") if key else docs.crossJoin(terms)
    quoted = F.concat(F.lit("\\Q"), F.col("term"), F.lit("\\E"))
    plain = F.col("term").rlike("^[A-Za-z0-9][A-Za-z0-9 '&.,-]*[A-Za-z0-9]$")
    tokens = F.regexp_extract_all("term", F.lit("[A-Za-z0-9]+"), F.lit(0))
    first = F.element_at(tokens, 1)
    alone = (F.size(tokens) == 1) & (F.length(first) >= 5) & ~F.lower(first).isin(*CASE_STOPS) & (F.upper("term") == F.col("term"))
    loose = F.col("label").isin("NAME", "ORG", "BRAND") & ((F.size(tokens) >= 2) | alone)
    exact, folded = (matches(F.col("text"), F.concat(F.lit(rf"(?{f}U)\b"), quoted, F.lit(r"\b"))) for f in ("", "i"))
    found = F.when(plain & (F.size(exact) > 0), exact).when(plain & loose, folded).otherwise(matches(F.col("text"), quoted))
    return rows(pairs.select("doc_id", "label", F.inline(found)))


def rows(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.end, r.label, r.text) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    texts = [rng.choice(["", " "]).join(rng.choice(WORDS) for _ in range(rng.randrange(40))) for _ in range(150)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(200, None), (201, ""), (202, "ACME ACME"), (203, "aaaa")]
    terms = {(" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 4))), rng.choice(["NAME", "ORG", "LOC"])) for _ in range(120)}
    terms |= {("ACME", "ORG"), ("ACME", "LOC"), ("aa", "LOC"), ("a", "NAME"), ("THREEFOLD", "ORG"), ("$9", "LOC"), ("nowhere at all", "ORG")}
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(sorted(terms), "term string, label string")


def test_equal_to_patterns(corpus, spark):
    docs, terms = corpus
    # a capital dotted I and the Kelvin sign fold to letters by themselves
    want = by_patterns(docs, terms)
    assert len(want) > 2000
    assert rows(scan_terms(docs, terms)) == want
    stops = frozenset(CASE_STOPS)
    assert rows(find_terms(docs, terms, stops, sent_terms=0)) == want
    own = docs.select("doc_id").crossJoin(terms).where((F.col("doc_id") + F.length("term")) % 5 == 0)
    assert rows(scan_terms(docs, own)) == by_patterns(docs, own, "doc_id")
    assert scan_terms(docs, terms.limit(0)).collect() == [] and find_terms(docs, terms.limit(0), stops, -1).collect() == []


def test_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "Ann Lee"), (1, "Ann Lee"), (1, "Lee"), (None, "Ann Lee")], "doc_id long, text string")
    terms = spark.createDataFrame([("Ann Lee", "NAME")], "term string, label string")
    for sent in (10, 0):
        assert [r[0] for r in rows(find_terms(docs, terms, frozenset(), sent_terms=sent))] == [-1, 1, 1]


def test_join_has_no_nested_loop(corpus, capsys):
    docs, terms = corpus
    find_terms(docs, terms, frozenset(), sent_terms=0).explain("formatted")
    plan = capsys.readouterr().out
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "MapInArrow" in plan


def test_linear_in_matches_and_terms():
    text, terms = "Ann Lee met Bo Ray. " * 20_000, [(f"Term {i}", "NAME") for i in range(20_000)] + [("Ann Lee", "NAME"), ("bo ray", "ORG")]
    made = Dictionary(terms, frozenset())
    began = time.perf_counter()
    assert len(made.find(text)) == 40_000
    assert time.perf_counter() - began < 5


def test_many_matches_in_one_text(spark):
    """The time of a text of many matches does not grow with their square."""
    n = 40_000
    df = spark.createDataFrame([("é ab12 x " * n,)], "text string")
    found = df.select(scan.matches(F.col("text"), "[0-9]+").alias("m")).select(F.size("m"), F.col("m")[n - 1]["start"])
    found.first()
    began = time.perf_counter()
    assert tuple(found.first()) == (n, 9 * (n - 1) + 4)
    assert time.perf_counter() - began < 10
