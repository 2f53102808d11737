"""What is costly is computed once: keys, scores, words; short lists go to the phrases."""

import random

import regex
from pyspark.sql import functions as F

from redactory.functions import text as X
from redactory.operators import lexicon, scan
from redactory.plans import queries as Q
from redactory.plans import rules as R


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_score_is_computed_once_for_all_phases(spark, sf):
    plan = _plan(Q.QUERIES["x17_phase_seconds"](spark, sf))
    assert plan.count("split(") == 1 and plan.count("Contains(lower(") + plan.count("contains(lower(") == 0
    rows = Q.QUERIES["x17_phase_seconds"](spark, sf).where("phase = 'llm_extraction'").select("doc_id", "seconds")
    want = Q.docs(spark, sf).select("doc_id", F.round(F.lit(22.5) + F.lit(22.5) * (X.complexity_score(F.col("text")) - 1.0), 5).alias("seconds"))
    assert rows.exceptAll(want).count() == 0 == want.exceptAll(rows).count()


def test_a_key_is_computed_once(spark):
    df = spark.createDataFrame([("the Boards",)], "text string")
    plan = _plan(df.select(X.singular_keys(X.exclusion_key(F.col("text"))).alias("k")))
    assert plan.count("lower(") == 1


def test_phrases_are_not_shuffled_for_a_short_list(spark):
    literals, _ = lexicon.read_exclusions(spark)
    patterns = spark.createDataFrame([(r"t[a-z]+\.$",), ("loan.*",)], "pattern string")
    df = spark.createDataFrame([("The  Board of\tDirectors' ",), ("tea.",), ("Loans Inc",), ("x" * 9000,)], "text string")
    out = lexicon.excluded_phrases(df, literals, patterns)
    assert {r.text.strip() for r in out.collect()} == {"The  Board of\tDirectors'", "tea.", "Loans Inc"}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 3


def test_only_phrases_too_long_for_a_key_are_passed_over(spark):
    rng = random.Random(6)
    parts = ["the ", "any ", "  ", "\t\n", "board", "of", "ies", "s", "(s)", "’s ", "'", ".", "!?", ";;  ", "xylophones", "İ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    texts += ["neither the " + "\n" * 500 + "  members(s)  ’s  " + "." * 700, "both all parties"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for longest in (1, 4, 12):
        lost = df.where(~lexicon.may_be_key(F.col("text"), longest)).select(F.explode(lexicon.candidate_keys(F.col("text"))).alias("key"))
        assert lost.where(F.length("key") <= longest).count() == 0
    assert df.where(~lexicon.may_be_key(F.col("text"), 4)).count() > 300


def test_marks_in_a_text_do_not_part_it(spark):
    texts = ["a1 bb22 c", f"{scan.MARK}1 x{scan.MARK}{scan.MARK}22", "none", "", None, "7", "É1é2", "\U0001f600 3\U0001f600"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [[tuple(m) for m in r.m] for r in df.select(scan.matches(F.col("text"), "[0-9]+|(?=b)").alias("m")).collect()]
    import re

    want = [[(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+|(?=b)", t or "")] for t in texts]
    assert got == want


def test_county_words_are_read_in_one_way(spark):
    """The led rule finds the same, also within words that are too long."""
    rng = random.Random(5)
    parts = ["County", "Parish", " of ", " ", "  ", "Kent", "x", "A" * 30, "b" * 20, "'", "-", "’", "Borough", "9", ".", "é", "of", "\n", "Countyxx"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(2, 12))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rule = next(r for r in R.RULES if r.pattern == R.COUNTY)
    both = df.select("text", scan.matches(F.col("text"), rule.led or rule.pattern).alias("a"), scan.matches(F.col("text"), R.COUNTY).alias("b")).collect()
    assert [r for r in both if r.a != r.b] == [] and sum(bool(r.b) for r in both) > 500
    assert df.where(F.col("text").rlike(rule.needs) != F.col("text").rlike("(?i)county|parish|borough")).count() == 0
    assert rule.led and rule.led != R.COUNTY


PLAIN_LISTS = (
    ("NAME", rf"(?i)\b(?:{scan.FIRST_NAMES})\b", 0.85),
    ("NAME", rf"(?i)\b(?:{scan.TITLES})\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?", 0.85),
    ("NAME", r"(?i)\b[A-Z][a-z]+\s+(?:[A-Z]\.\s+)?[A-Z][a-z]+\b", 0.85),
    ("ORG", rf"(?i)\b[A-Z][a-zA-Z\s&]+(?:\s+(?:{scan.COMPANY_ENDINGS}))\b", 0.80),
    ("ORG", rf"(?i)\b(?:{scan.KNOWN_COMPANIES})\b", 0.80),
    ("ORG", rf"(?i)\b(?:the\s+)?(?:{scan.BODIES})\b", 0.80),
    ("LOC", rf"(?i)\b(?:{scan._STATES})\b", 0.90),
    ("LOC", rf"(?i)\b(?:{scan.COUNTRIES})\b", 0.90),
    ("LOC", rf"(?i)\b(?:{scan.CITIES})\b", 0.90),
)


def test_gazetteer_reads_a_clause_once_and_finds_the_same(spark):
    """Each list against its plain alternatives, overlaps against the expression of W6."""
    from redactory.operators.merge import remove_overlaps_greedy

    rng = random.Random(9)
    words = [w for _, p, _ in PLAIN_LISTS for w in p.replace(r"\s+", " ").replace(r"\.", ".").replace("?", "").replace("(", "|").replace(")", "|").split("|") if w.isascii() and w.strip()]
    joints = [" ", " ", " ", "  ", ", ", ".", ". ", "\n", "&", " & ", "3", "é", "", "_"]
    texts = ["".join(rng.choice(words if rng.random() < 0.6 else ["x", "the", "Zed", "inc.", "Mr.", "Jane Q.", "The Company", "the firm", "Group"]) + rng.choice(joints) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string").cache()

    def plain(lists):
        def part(label, pattern, confidence):
            body = lambda m: F.lower(m["text"]).isin(*scan.DEFINED_BODIES)
            found = scan.matches(F.col("text"), pattern)
            if label == "ORG":
                found = F.filter(found, lambda m: ~body(m) | m["text"].rlike("^[A-Z]") | m["text"].contains("Company"))
            sure = lambda m: F.when(body(m), 0.75).otherwise(confidence) if label == "ORG" else F.lit(confidence)
            return F.transform(found, lambda m: scan.span(m["start"], m["end"], label, m["text"], sure(m), "gazetteer"))

        spans = remove_overlaps_greedy(F.flatten(F.array(*(part(*x) for x in lists))))
        return df.select("doc_id", F.inline(spans))

    for mine, theirs in [*(([a], [b]) for a, b in zip(scan.GAZETTEER, PLAIN_LISTS)), (scan.GAZETTEER[:9], PLAIN_LISTS)]:
        a, b = scan.scan_gazetteer(df, mine), plain(theirs)
        assert sorted(a.collect()) == sorted(b.collect()), mine[0][:2]
    assert scan.scan_gazetteer(df.limit(0)).count() == 0
    # no clause is read to its end from each of its words
    import time

    long = spark.createDataFrame([(1, "nothing of the kind is said " * 1500)], "doc_id long, text string")
    began = time.perf_counter()
    assert scan.scan_gazetteer(long, [x for x in scan.GAZETTEER if x[0] == "ORG"]).count() == 0
    assert time.perf_counter() - began < 8


def test_every_legal_form_begins_with_a_led_character(spark):
    from redactory.operators import reshape

    forms = "Incorporated|Corporation|Company|Limited|Inc.|Corp|Co.|Ltd.|L.L.C.|LC|General Partnership|P.A.|Federal Savings Bank|National Association|Trust Company|Holdings|Group|Fund|Statutory Trust|REIT|Foundation|Association|Society|Institute|GmbH|AG|S.A.S.|Sp. z o.o.|B.V.|N.V.|plc|p.l.c.|Banks|none".split("|")
    df = spark.createDataFrame([(f"Xyz {f}{end}",) for f in forms for end in ("", " ", " x")], "text string")
    both = df.select(F.col("text").rlike(reshape.ENDING_FORM).alias("a"), F.col("text").rlike(R.ORG_FORM_AT_END).alias("b")).collect()
    assert all(r.a == r.b for r in both) and sum(r.b for r in both) >= 60


def _plain_excluded(lex, text):
    """F4 without a bound: every key, its singular, and every pattern."""

    def bare(text):
        parts = text.strip().split(None, 1)
        return parts[1] if len(parts) == 2 and parts[0].lower() in X.DETERMINERS else text.strip()

    def has(text):
        key = regex.sub(r"['’]s\s*$|['’]\s*$", "", text.strip().lower())
        key = regex.sub(r"\s+", " ", key.rstrip(".,;:!?\"'"))
        one = regex.sub(r"\(s\)\s*$", "", key).strip() if regex.search(r"\(s\)\s*$", key) else key[:-3] + "y" if key.endswith("ies") and len(key) > 3 else key[:-1].rstrip() if key.endswith("s") and len(key) > 1 else ""
        return key in lex.literals or (one != "" and one in lex.literals)

    return has(bare(text)) or has(bare(bare(text))) or any(regex.match(p, bare(text), regex.IGNORECASE) for p in lex.patterns)


def _plain_split_clean(lex, text):
    """X14 as it is stated: segments and what parts them in turn."""
    tokens = regex.split(r"([,:;]\s*|\n)", text)
    out, last = [], None
    for i in range(0, len(tokens), 2):
        if tokens[i].strip() and not _plain_excluded(lex, tokens[i].strip()):
            out += [tokens[i - 1], tokens[i]] if last == i - 2 and i else [tokens[i]]
            last = i
    return "".join(out).strip() or None


def test_no_key_is_made_of_a_segment_too_long_for_one(monkeypatch):
    """The bound loses no excluded phrase, and long segments are left at once."""
    rng = random.Random(11)
    parts = ["the ", "any ", " ", "\t", "\n", "\x1c", "\xa0", "board", "Board of Directors", "of", "company", "ies", "S", "(s)", "(s) ", "’s", "'s ", "'", ".", "!?", ", ", ";;", ":", "party", "part", "İ", "x", "a b"]
    lexica = [lexicon.Lexicon(frozenset(words), patterns) for words in (lexicon.base_terms(), ("", "x", "x y", "party s", "the x", "a b", "x x x x")) for patterns in ((), (r"b[a-z]+\.$", "x.*of"))]
    found = 0
    for lex in lexica:
        for _ in range(4000):
            text = "".join(rng.choice(parts) for _ in range(rng.choice((1, 2, 3, 5, 9, 16))))
            assert lex.excluded(text) == _plain_excluded(lex, text), text
            assert lex.split_clean(text) == _plain_split_clean(lex, text), text
            found += lex.excluded(text)
    assert found > 1000
    asked = []
    has = lexicon.Lexicon.has
    monkeypatch.setattr(lexicon.Lexicon, "has", lambda self, key: asked.append(key) or has(self, key))
    text = "nothing in this segment is as short as a term would be, the Company: nor is anything of what is said behind it"
    assert lexica[0].split_clean(text) == text.replace(", the Company: ", "")
    assert asked == ["company"]


def test_a_line_of_very_many_segments_is_split_in_time():
    import time

    lex = lexicon.Lexicon(frozenset({"x y"}))
    began = time.perf_counter()
    assert len(lex.split_clean("the board, x " * 40_000)) == 519_999
    assert time.perf_counter() - began < 5
