import random
from collections import defaultdict

from pyspark.sql import functions as F

from redactory.llm.queries import op9_quality_rules
from redactory.llm.rules import Rule, judge, plan_cascade, standard_rules
from tests.llm.common import WORD, edge_rows


def brute(text):
    text = text or ""
    w, at = WORD.findall(text), defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_counts_match_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, "".join(rng.choice(["a ", "b ", "c ", "c\n", "#\t", "é ", "longer ", "\n"]) for _ in range(rng.randrange(0, 80)))) for i in range(300)]
    rows += [(i + 1000 if i is not None else 5000, t) for i, t in edge_rows()]
    got = judge(spark.createDataFrame(rows, "doc_id long, text string"))
    want = defaultdict(list)
    for d, t in rows:
        want[d].append(brute(t))
    for r in got.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in want[r.doc_id]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert r.kept == (r.failed_rule is None) and (not r.base_failed or r.failed_rule == "base")


def test_clean_stays_and_junk_goes(spark):
    clean = "Anea of the ring was in the of eran over them and they were under that which is not here. " * 1
    rows = [(1, clean), (2, " ".join(w + "***" for w in clean.split())), (3, clean.upper()), (4, " | ".join(clean.split())), (5, " ".join(f"{w} {w}" for w in clean.split()))]
    kept = {r.doc_id: r.kept for r in judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_order_does_not_change_the_verdict(spark):
    rows = [(i, ("AB " if i % 3 == 0 else "ab ") * (i % 15) + "*" * (i % 7)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rules = standard_rules()
    one = {(r.doc_id, r.kept) for r in judge(df, rules).collect()}
    assert one == {(r.doc_id, r.kept) for r in judge(df, rules[::-1]).collect()}
    assert judge(df.limit(0)).count() == 0
    assert {r.name for r in plan_cascade(judge(df), rules)} == {r.name for r in rules}


def test_slow_rules_run_late_and_strict_ones_early(spark):
    df = spark.createDataFrame([(i, "word " * 20 + str(i)) for i in range(400)], "doc_id long, text string")
    slow = F.aggregate(F.sequence(F.lit(1), F.lit(3000)), F.length("text"), lambda a, x: (a * 31 + x) % 1009) >= 0
    rules = [Rule("slow", slow), Rule("never", F.col("text") == ""), Rule("strict", F.length("text") > 3)]
    assert [r.name for r in plan_cascade(df, rules)] == ["strict", "slow", "never"]


def test_no_python_in_the_plan(spark, sf):
    plan = op9_quality_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
