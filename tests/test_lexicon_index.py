"""Patterns by needed runs equal every pattern on every phrase; broken ones are set aside."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from redactory.operators import lexicon
from redactory.operators.lexicon import excluded_phrases, indexed_patterns, matched_phrases, needed_run

PATTERNS = [r"loan.*", r"(?:sub)?lease\b", r"t[a-z]+\.$", r"(alpha|beta) fund", r"x{2,}yz", r"net (?:asset|book) value", r"a.c", r"\d+ shares?", r"(?P<q>series) [a-z]$", r".*", r"strasse$", r"K\d", r"(?:ab)+c", r"(?=pre)prefer", r"no"]
BROKEN = ["(abc", "[z-a]", "*x", "a{2,1}", r"(?P<1a>x)"]
PHRASES = ["Loan Co", "the loan", "Sublease", "lease x", "tea.", "Beta fund", "gamma fund", "xxyz", "xyz", "Net Book Value", "ABC", "12 Share", "the Series A", "Series AB", "STRASSE", "ſtrasse", "K9", "ababc", "preferred", "No", "", "an ABC", None]


@pytest.mark.parametrize("pattern, run", [("loan.*", "LOA"), ("(?:sub)?lease", "LEA"), ("(alpha|beta) fund", " FU"), ("a.c", None), (".*", None), ("(?:abc)+", "ABC"), ("(?:abc)*", None), ("x(abcd)", "ABC"), ("no", None)])
def test_needed_runs(pattern, run):
    assert needed_run(pattern) == run


@given(st.sampled_from([p for p in PATTERNS]), st.text("abcdefghijklmnoprstuxyzKſıİ 0.", max_size=12))
@settings(max_examples=400, deadline=None)
def test_a_match_holds_its_run(pattern, text):
    form = text.upper().lower().upper().replace("̇", "")
    run = needed_run(pattern)
    assert run is None or not re.compile(pattern, re.IGNORECASE).match(text) or run in form


def test_equal_to_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "LOOSE_BLOCK", 2)  # several blocks
    rng = random.Random(4)
    phrases = PHRASES + ["".join(rng.choice("abcde lonks.") for _ in range(rng.randrange(12))) for _ in range(200)]
    texts = spark.createDataFrame([(p,) for p in phrases], "text string").where("text is not null").distinct()
    for chosen in (PATTERNS[:9] + PATTERNS[10:], PATTERNS):
        patterns = spark.createDataFrame([(p,) for p in chosen + BROKEN], "pattern string")
        bare = {t: re.sub(r"(?i)^(?:the|a|an|this|that|such)\s+", "", t) for t in {p for p in phrases if p is not None}}
        got = {r.text for r in matched_phrases(texts, patterns).collect()}
        want = {t for t, b in bare.items() if any(re.match(p, b, re.IGNORECASE) for p in chosen)}
        assert {t for t in got if not t.lower().startswith(("the ", "a ", "an "))} == {t for t in want if not t.lower().startswith(("the ", "a ", "an "))}
        assert {"the loan", "the Series A"} <= got
    assert matched_phrases(texts, patterns.limit(0)).collect() == []


def test_a_broken_line_is_set_aside(spark, tmp_path, capsys):
    (tmp_path / "x.txt").write_text("Buyer\nloan.*\n(abc\n[z-a]\n")
    literals, patterns = lexicon.read_exclusions(spark, str(tmp_path / "x.txt"))
    df = spark.createDataFrame([("the Buyer",), ("Loan Co",), ("Acme",)], "text string")
    out = excluded_phrases(df, literals, patterns)
    assert {r.text for r in out.collect()} == {"the Buyer", "Loan Co"}
    assert {r.pattern for r in indexed_patterns(patterns).where("error is not null").collect()} == {"(abc", "[z-a]"}
    out.explain("formatted")
    assert "NestedLoop" not in (plan := capsys.readouterr().out) and "Cartesian" not in plan


def test_combinations_of_any_length():
    """The bound by the longest literal loses nothing."""
    rng = random.Random(8)
    words = ["board", "of", "directors", "the", "company", "acme", "and", "loan"]
    lex = lexicon.Lexicon(frozenset({"board of directors", "company", "loan of the company"}))
    with_pattern = lexicon.Lexicon(lex.literals, ("zzz",))  # a pattern lifts the bound
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 12))) for _ in range(2000)]
    got = [lex.combination(t) for t in texts]
    assert got == [with_pattern.combination(t) for t in texts] and 100 < sum(got) < 1900
    assert lex.combination("the board of directors and the loan of the company") and not lex.combination("the board of acme")
