"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a name and a failing condition over the text. On a random sample
of rows each rule's rejection rate and cost (seconds of a scan that evaluates it,
less those of a scan that evaluates nothing) are measured, and the rules run in
the order of rejection per cost: a row stops at its first failing rule. The
verdict does not depend on the order.

Nulls, ties, repeats: a null text has no words. Rows are judged one by one, so
repeats and ids do not matter; very long texts are judged whole. Rules of equal
rank keep the given order. Columns of the input pass through, except those named
like an output or ``_f``, which are replaced. An empty table keeps the given order.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
SAMPLE_ROWS = 2000


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column


def _bind(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def words_of(text: Column) -> Column:
    """Maximal runs of characters outside ``[\\x20\\x09-\\x0D]``."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeat_words(words: Column, size: int = 5) -> Column:
    """Words inside ``size``-word windows that occur twice or more in the text.

    Only texts with a repeated window pay for sorting: (hash, place) pairs are
    sorted, places of equal neighbours collected, and the union of the intervals
    they cover is summed over the sorted places."""

    def windows(words):
        def over(h):
            return F.transform(F.slice(h, 1, F.size(h) - (size - 1)), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, size))))

        return _bind(F.transform(words, lambda w: F.xxhash64(w)), over)

    def covered(hashes):
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(pairs):
            near = lambda x, j: (F.get(pairs, j - 1)["h"] == x["h"]) | (F.get(pairs, j + 1)["h"] == x["h"])
            first = lambda x, j: F.when(F.when(j == 0, F.get(pairs, j + 1)["h"] == x["h"]).otherwise(near(x, j)), x["i"])
            return F.sort_array(F.filter(F.transform(pairs, first), lambda i: i.isNotNull()))

        def total(places):
            reach = F.transform(places, lambda i, k: F.least(F.lit(size), F.coalesce(F.get(places, k + 1) - i, F.lit(size))))
            return F.aggregate(reach, F.lit(0).cast("long"), lambda a, x: a + x)

        return _bind(_bind(pairs, twice), total)

    some = lambda hashes: F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered(hashes)).otherwise(F.lit(0).cast("long"))
    return F.when(F.size(words) > size, _bind(windows(words), some)).otherwise(F.lit(0).cast("long"))


def features(text: Column) -> Column:
    """struct of the base counts of a text; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def of(words):
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
            (F.length(text) - F.length(F.regexp_replace(text, "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
            _bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeat_words(words).alias("n_repeat_words"),
        )

    return _bind(words_of(text), of)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed() -> Column:
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def standard_rules(text: str = "text") -> list[Rule]:
    """Rules beyond the base: symbols, word length, lines, capitals, letters,
    tables, words said again at once."""
    t = F.coalesce(F.col(text), F.lit(""))
    letters = F.length(t) - F.length(F.regexp_replace(t, "\\p{L}+", ""))
    upper = F.length(t) - F.length(F.regexp_replace(t, "\\p{Lu}+", ""))
    bars = F.length(t) - F.length(F.replace(t, F.lit("|"), F.lit("")))
    echoes = _bind(words_of(t), lambda words: F.size(F.filter(words, lambda w, i: F.when(i > 0, F.get(words, i - 1) == w))))
    return [
        Rule("symbol_share", F.expr("10 * n_symbols > 3 * n_words")),
        Rule("word_length", F.expr("word_chars < 2 * n_words or word_chars > 15 * n_words")),
        Rule("repeated_lines", F.expr("n_dup_lines >= 3 and 10 * n_dup_lines > n_words")),
        Rule("shouting", upper * 2 > letters),
        Rule("few_letters", letters * 2 < F.col("word_chars")),
        Rule("table", bars * 10 > F.col("n_words")),
        Rule("echoes", echoes * 10 > F.col("n_words") * 3),
    ]


def plan_cascade(sample: DataFrame, rules: list[Rule], rounds: int = 4) -> list[Rule]:
    """``rules`` by falling rejection per cost, both measured on ``sample``, a
    bounded table of rows that passed the base rules. Each row is judged
    ``rounds`` times, so that the rule outweighs the start of a job."""
    sample = sample.cache()
    try:
        if (rows := sample.count()) == 0:
            return list(rules)
        many = sample.withColumn("_round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))

        def scan(condition: Column) -> tuple[float, int]:
            taken = []
            for _ in range(2):
                began = time.perf_counter()
                rejected = many.agg(F.count_if(condition)).first()[0]
                taken.append(time.perf_counter() - began)
            return min(taken), rejected // rounds

        nothing, _ = scan(F.col("_round") < 0)
        ranked = []
        for i, rule in enumerate(rules):
            seconds, rejected = scan(rule.fails)
            ranked.append((-(rejected / rows) / max(seconds - nothing, 1e-4), i, rule))
        return [rule for *_, rule in sorted(ranked, key=lambda x: x[:2])]
    finally:
        sample.unpersist()


def _measured(docs: DataFrame) -> DataFrame:
    f = docs.withColumn("_f", features(F.col("text")))
    return f.select(*docs.columns, *(F.col(f"_f.{c}").alias(c) for c in BASE)).withColumn("base_failed", base_failed())


def judge(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``failed_rule`` (the first
    rule of the cascade that rejects, null if none) and ``kept``."""
    own = (*BASE, "base_failed", "failed_rule", "kept")
    docs = docs.drop(*own, "_f")
    rules = standard_rules() if rules is None else rules
    # raw rows are drawn before anything is computed; the limit bounds what is cached
    share = min(1.0, 1.2 * sample_rows / max(1, docs.count()))
    drawn = docs.where(F.rand(29) < share).limit(sample_rows) if share < 1 else docs
    ordered = plan_cascade(_measured(drawn.repartition(4)).where("not base_failed"), rules)
    measured = _measured(docs)
    first = F.when(F.col("base_failed"), F.lit("base"))
    for rule in ordered:
        first = first.when(rule.fails, F.lit(rule.name))
    return measured.withColumn("failed_rule", first).withColumn("kept", F.col("failed_rule").isNull())
