"""Other occurrences of accepted entities, and joins of spans by overlap."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactory.functions.let import let_all
from redactory.functions.text import org_key, org_tokens
from redactory.operators.scan import between, matches, span
from redactory.schemas import SPANS

# fixed values
SAFE_LABELS = ("ORG", "PERSON", "NAME", "EMAIL", "SSN", "PHONE", "ACCOUNT", "CARD", "BRAND")
STOP_WORDS = ("the", "and", "for", "with", "from", "that", "this", "inc", "llc", "corp", "ltd", "company", "mr", "mrs", "ms", "dr", "esq", "dept")
FUZZY_GAP = r"[ \t\r\n\u00A0,.;:'\"/\-]{0,10}"
BUCKET = 256


@dataclass(frozen=True)
class Budget:
    """Bounds on one document's work; 0 lifts a bound. Without any, which is
    the default, every term of a document is looked for."""

    candidates: int = 0
    fuzzy: int = 0
    pattern_chars: int = 0


#: fixed values: the customary bounds of an interactive tool
CUSTOMARY = Budget(1500, 250, 120_000)


def overlap_join(a: DataFrame, b: DataFrame, width: int = BUCKET) -> DataFrame:
    """Pairs of overlapping spans of one document, (doc_id, a.*, b.* as b_*).
    Both sides are bucketed by offset, so a document of very many spans stays an
    equi-join; a pair is reported by the bucket its overlap starts in."""
    right = b.select("doc_id", *(F.col(c).alias(f"b_{c}") for c in b.columns if c != "doc_id"))
    cut = lambda df, s, e: df.withColumn("_bucket", F.explode(F.sequence(F.expr(f"{s} div {width}"), F.expr(f"greatest({s}, {e} - 1) div {width}"))))
    both = cut(a, "start", "end").join(cut(right, "b_start", "b_end"), ["doc_id", "_bucket"])
    both = both.where("start < b_end and end > b_start").where(f"greatest(start, b_start) div {width} = _bucket")
    return both.drop("_bucket")


def _first(items: Column, bound: int) -> Column:
    return F.slice(items, 1, bound) if bound else items


def candidates(spans: Column, budget: Budget = Budget()) -> Column:
    """J4's terms: distinct (label, trimmed text) of safe labels, in span order."""
    terms = F.transform(spans, lambda s: F.struct(s["label"].alias("label"), F.trim(s["text"]).alias("text")))
    good = lambda t: t["label"].isin(*SAFE_LABELS) & (F.length(t["text"]) >= 4) & ~F.lower(t["text"]).isin(*STOP_WORDS) & t["text"].rlike(r"[\p{L}\p{N}]")
    return _first(F.array_distinct(F.filter(terms, good)), budget.candidates)


def quote(c: Column) -> Column:
    """A pattern that matches the text itself."""
    return F.regexp_replace(c, r"([\\.\[\]{}()*+?^$|\-#&~])", r"\\$1")


def _alternation(terms: Column, flags: str, max_chars: int) -> Column:
    """One pattern of all terms, longest first, within the pattern budget."""
    ordered = F.transform(F.sort_array(F.transform(F.array_distinct(terms), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda x: quote(x["t"]))
    begin = F.struct(F.lit(0).alias("used"), F.lit(True).alias("open"), F.array().cast("array<string>").alias("out"))

    def step(acc, p):
        fits = acc["open"] & ((F.size(acc["out"]) == 0) | (acc["used"] + F.length(p) <= max_chars))
        return F.struct((acc["used"] + F.length(p)).alias("used"), fits.alias("open"), F.when(fits, F.concat(acc["out"], F.array(p))).otherwise(acc["out"]).alias("out"))

    bounded = F.aggregate(ordered, begin, step, lambda acc: acc["out"]) if max_chars else ordered
    return F.concat(F.lit(rf"(?{flags})\b(?:"), F.array_join(bounded, "|"), F.lit(r")\b"))


def _same(label: Column, one: Column, two: Column) -> Column:
    clean = lambda c: F.when(label == "ORG", org_key(c)).otherwise(F.lower(F.trim(c)))
    return (clean(one) == clean(two)) & (clean(one) != "")


def _fresh(found: Column, spans: Column) -> Column:
    """Without spans that overlap one of equal label and text, or equal one."""
    clash = lambda f: F.exists(spans, lambda s: (s["label"] == f["label"]) & (f["start"] < s["end"]) & (f["end"] > s["start"]) & (_same(f["label"], f["text"], s["text"]) | ((f["start"] == s["start"]) & (f["end"] == s["end"]))))
    return F.filter(found, lambda f: ~clash(f))


def exact_occurrences(spans: Column, text: Column, terms: Column, budget: Budget = Budget()) -> Column:
    """Other places of accepted terms, case-sensitive, and of organisations
    without case and possessive."""
    none = F.array().cast(SPANS)

    def of(plain, orgs):
        names = F.transform(plain, lambda t: t["text"])
        label_of = lambda m: F.get(F.filter(plain, lambda t: t["text"] == m["text"]), F.lit(0))["label"]
        found = F.transform(matches(text, _alternation(names, "U", budget.pattern_chars)), lambda m: span(m["start"], m["end"], label_of(m), m["text"], 0.95, "consistency_pass"))
        folded = F.flatten(F.transform(orgs, lambda t: F.array(F.lower(t["text"]), F.regexp_replace(F.lower(t["text"]), "['’]s$", ""))))
        also = F.transform(matches(text, _alternation(folded, "iU", budget.pattern_chars)), lambda m: span(m["start"], m["end"], "ORG", m["text"], 0.95, "consistency_pass_ci"))
        return F.concat(F.when(F.size(plain) > 0, _fresh(found, spans)).otherwise(none), F.when(F.size(orgs) > 0, _fresh(also, spans)).otherwise(none)).cast(SPANS)

    return let_all(of, plain=F.filter(terms, lambda t: t["label"] != "ORG"), orgs=F.filter(terms, lambda t: t["label"] == "ORG"))


def fuzzy_occurrences(spans: Column, text: Column, terms: Column, budget: Budget = Budget()) -> Column:
    """Tokens of an organisation's name with up to ten blanks or marks between."""
    orgs = _first(F.filter(terms, lambda t: t["label"] == "ORG"), budget.fuzzy)

    def of(t):
        tokens = org_tokens(t["text"])
        pattern = F.concat(F.lit(r"(?iU)\b"), F.array_join(tokens, FUZZY_GAP), F.lit(r"\b"))
        least = F.greatest(F.lit(4), F.length(F.array_join(tokens, "")) - 1)
        alnum = r"^[\p{L}\p{N}]$"
        good = lambda m: (m["end"] - m["start"] >= least) & ~between(text, m["start"] - 1, m["start"]).rlike(alnum) & ~between(text, m["end"], m["end"] + 1).rlike(alnum)
        found = F.transform(F.filter(matches(text, pattern), good), lambda m: span(m["start"], m["end"], "ORG", m["text"], 0.93, "consistency_pass_fuzzy"))
        return F.when(F.size(tokens) >= 2, found).otherwise(F.array().cast(SPANS))

    made = F.flatten(F.transform(orgs, of))
    return F.when(F.size(orgs) > 0, _fresh(made, spans)).otherwise(F.array().cast(SPANS)).cast(SPANS)


def within_budget(candidates_: DataFrame, max_rows: int = CUSTOMARY.candidates, max_chars: int = CUSTOMARY.pattern_chars) -> DataFrame:
    """J6 on the long form (doc_id, term): the longest terms of a document, up to
    a number of rows and a total of characters; 0 lifts a bound."""
    order = Window.partitionBy("doc_id").orderBy(F.length("term").desc(), "term")
    out = candidates_.withColumn("_n", F.row_number().over(order)).withColumn("_used", F.sum(F.length("term")).over(order))
    keep = F.lit(True) if not max_rows else F.col("_n") <= max_rows
    fits = F.lit(True) if not max_chars else (F.col("_used") <= max_chars) | (F.col("_n") == 1)
    return out.where(keep & fits).drop("_n", "_used")
