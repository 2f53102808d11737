"""The redaction pipelines: detection, reshaping, identity, rewriting.

A document's spans never touch another document's, so the whole chain runs on
the document's own row: no shuffle, and the same in batch and in a stream. Python
sees only the short strings of names (Arrow batches, cached for each worker).
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.functions.let import let, let_all
from redactory.functions.text import fold_quotes, normalize_mode
from redactory.operators.consistency import Budget, candidates, exact_occurrences, fuzzy_occurrences
from redactory.operators.entities import cluster_mentions
from redactory.operators.lexicon import Lexicon
from redactory.operators.merge import merge_spans
from redactory.operators.organisations import OrgCleaner
from redactory.operators.reshape import alias_spans, drop_generic_counties, drop_overlong_orgs, extend_addresses, extend_org_suffix, snap_to_tokens, trim_jurisdiction
from redactory.operators.rewrite import apply_replacements, build_replacements, keep_redactable
from redactory.operators.scan import between, scan_arrays
from redactory.plans import rules as R
from redactory.schemas import SPANS

FLOOR = 0.90
IDENTIFIED = "array<struct<start:int,end:int,label:string,text:string,confidence:double,source:string,entity_id:string>>"


@lru_cache(maxsize=4)
def _cleaner(lexicon: Lexicon) -> OrgCleaner:
    """One for each Python worker and list of terms."""
    return OrgCleaner(lexicon)


_sent: dict[tuple[str, Lexicon], Broadcast] = {}


def _shared(lexicon: Lexicon) -> Broadcast:
    """The list as one broadcast, whose size ``Lexicon.read`` bounds: executors hold
    one copy for all helpers and workers."""
    context = SparkSession.getActiveSession().sparkContext
    key = context.applicationId, lexicon
    if key not in _sent:
        _sent.clear()
        _sent[key] = context.broadcast(lexicon)
    return _sent[key]


class NameHelpers:
    """Column functions over arrays of names, backed by Python helpers that are
    asked once for each distinct string of a batch."""

    def __init__(self, lexicon: Lexicon):
        self.settled = self._udf(lexicon, "array<struct<shift:int,name:string>>", lambda c, t: dict(zip(("shift", "name"), c.settle_scanned(t) or (None, None), strict=True)))
        self.excluded = self._udf(lexicon, "array<boolean>", lambda c, t: c.lexicon.excluded(t))
        self.combination = self._udf(lexicon, "array<boolean>", lambda c, t: c.lexicon.combination(t))
        self.specific = self._udf(lexicon, "array<boolean>", lambda c, t: c.specific(t))
        self.tail_dropped = self._udf(lexicon, "array<string>", lambda c, t: c.drop_tail(t))

    @staticmethod
    def _udf(lexicon: Lexicon, kind: str, answer):
        shared = _shared(lexicon)

        @F.pandas_udf(kind)
        def run(texts: pd.Series) -> pd.Series:
            made = _cleaner(shared.value)
            known = {t: answer(made, t) for t in {t for row in texts if row is not None for t in row}}
            return pd.Series([None if row is None else [known[t] for t in row] for row in texts], dtype=object)

        return run.asNondeterministic()  # else the optimizer may move it into a lambda, where it cannot run


def _clustered(mentions: Column) -> Column:
    """W4 for a document's array of mentions: (id, joined) for each."""

    @F.pandas_udf("array<struct<id:string,joined:boolean>>")
    def run(rows: pd.Series) -> pd.Series:
        made = (cluster_mentions([m["label"] for m in row], [m["text"] for m in row]) for row in rows)
        return pd.Series([[{"id": i, "joined": j} for i, j in row] for row in made], dtype=object)

    return run.asNondeterministic()(mentions)


def _texts(spans: Column) -> Column:
    return F.transform(spans, lambda s: s["text"])


def _only(spans: Column, *labels: str) -> Column:
    return F.filter(spans, lambda s: s["label"].isin(*labels))


def _but(spans: Column, *labels: str) -> Column:
    return F.filter(spans, lambda s: ~s["label"].isin(*labels))


def detect(docs: DataFrame, lexicon: Lexicon, labels: Iterable[str] | None = None, rules=R.RULES, floor: float = FLOOR) -> DataFrame:
    """R22 in array form with names tidied: ``docs`` with column ``spans``."""
    helpers = NameHelpers(lexicon)
    df = docs.withColumn("_raw", scan_arrays(F.col("text"), labels, rules))
    df = df.withColumn("_orgs", _only(F.col("_raw"), "ORG")).withColumn("_locs", _only(F.col("_raw"), "LOC"))
    df = df.withColumn("_names", helpers.settled(_texts(F.col("_orgs")))).withColumn("_out", helpers.excluded(_texts(F.col("_locs"))))

    def moved(s, i):
        fix = F.get(F.col("_names"), i)
        start = s["start"] + fix["shift"]
        return F.when(fix["name"].isNotNull(), s.withField("start", start).withField("end", start + F.length(fix["name"])).withField("text", fix["name"]))

    orgs = F.filter(F.transform(F.col("_orgs"), moved), lambda s: s.isNotNull())
    locs = F.filter(F.transform(F.col("_locs"), lambda s, i: F.when(~F.get(F.col("_out"), i), s)), lambda s: s.isNotNull())
    spans = F.concat(_but(F.col("_raw"), "ORG", "LOC"), orgs.cast(SPANS), locs.cast(SPANS)).cast(SPANS)
    raised = F.transform(spans, lambda s: s.withField("confidence", F.greatest(s["confidence"], F.lit(floor))))
    return df.withColumn("spans", raised).drop("_raw", "_orgs", "_locs", "_names", "_out")


def drop_combinations(df: DataFrame, helpers: NameHelpers) -> DataFrame:
    """F5 on arrays; what goes is added to ``suppressed``."""
    named = ("ORG", "NAME", "LOC")
    df = df.withColumn("_named", _only(F.col("spans"), *named))
    df = df.withColumn("_combo", helpers.combination(_texts(F.col("_named")))).withColumn("_specific", helpers.specific(_texts(F.col("_named"))))
    bad = lambda s, i: F.get(F.col("_combo"), i) & ~((s["label"] == "ORG") & F.get(F.col("_specific"), i))
    df = df.withColumn("_gone", F.filter(F.transform(F.col("_named"), lambda s, i: F.when(bad(s, i), s)), lambda s: s.isNotNull()))
    kept = F.filter(F.transform(F.col("_named"), lambda s, i: F.when(~bad(s, i), s)), lambda s: s.isNotNull())
    df = df.withColumn("spans", F.concat(_but(F.col("spans"), *named), kept).cast(SPANS))
    gone = F.transform(F.col("_gone"), lambda s: _suppressed(F.lit("excluded_combo"), s))
    return df.withColumn("suppressed", F.concat(F.col("suppressed"), gone)).drop("_named", "_combo", "_specific", "_gone")


SUPPRESSED = "array<struct<reason:string,label:string,text:string,start:int,end:int,confidence:double,source:string>>"


def _suppressed(reason: Column, s: Column) -> Column:
    return F.struct(reason.alias("reason"), s["label"].alias("label"), F.substring(s["text"], 1, 120).alias("text"), s["start"].alias("start"), s["end"].alias("end"), s["confidence"].alias("confidence"), s["source"].alias("source"))


def invalid_reason(text: Column, s: Column) -> Column:
    """why a span cannot be applied; null if it can."""
    n = F.length(text)
    return (
        F.when(s["start"].isNull() | s["end"].isNull(), "non_integer_offsets")
        .when(~((s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= n)), "bounds_out_of_range")
        .when(s["text"].isNull(), "missing_text")
        .when(fold_quotes(between(text, s["start"], s["end"])) != fold_quotes(s["text"]), "text_mismatch")
    )


def post_process(df: DataFrame, lexicon: Lexicon, guarded: bool = True, budget: Budget = Budget()) -> DataFrame:
    """E1, E4, E5, E7, J4, J5, E3, E6, F6, F9, W1, F6 and F10, in this order, on
    columns ``text``, ``spans`` and ``suppressed``."""
    helpers, text, spans = NameHelpers(lexicon), F.col("text"), F.col("spans")
    on = lambda step: let_all(step, spans=spans, text=text).cast(SPANS)
    df = df.withColumn("spans", on(snap_to_tokens))
    df = df.withColumn("_orgs", _only(spans, "ORG")).withColumn("_cut", helpers.tail_dropped(_texts(F.col("_orgs"))))

    def cut(s, i):
        name = F.get(F.col("_cut"), i)
        return F.when(name != "", s.withField("text", name).withField("end", s["start"] + F.length(name))).otherwise(s)

    df = df.withColumn("spans", F.concat(_but(spans, "ORG"), F.transform(F.col("_orgs"), cut)).cast(SPANS)).drop("_orgs", "_cut")
    df = df.withColumn("spans", on(extend_org_suffix))
    df = df.withColumn("_more", on(alias_spans)).withColumn("_bad", helpers.excluded(_texts(F.col("_more"))))
    fine = F.filter(F.transform(F.col("_more"), lambda s, i: F.when((s["label"] == "ORG") | ~F.get(F.col("_bad"), i), s)), lambda s: s.isNotNull())
    df = df.withColumn("spans", F.concat(spans, fine).cast(SPANS)).drop("_more", "_bad")
    df = df.withColumn("_terms", let(spans, lambda s: candidates(s, budget)))
    if guarded:
        names = F.transform(F.col("_terms"), lambda t: t["text"])
        df = df.withColumn("_combo", helpers.combination(names)).withColumn("_spec", helpers.specific(names))
        good = lambda t, i: ~F.get(F.col("_combo"), i) | ((t["label"] == "ORG") & F.get(F.col("_spec"), i))
        df = df.withColumn("_terms", F.filter(F.transform(F.col("_terms"), lambda t, i: F.when(good(t, i), t)), lambda t: t.isNotNull())).drop("_combo", "_spec")
    again = lambda spans, text, terms: F.concat(spans, exact_occurrences(spans, text, terms, budget), fuzzy_occurrences(spans, text, terms, budget))
    df = df.withColumn("spans", let_all(again, spans=spans, text=text, terms=F.col("_terms")).cast(SPANS)).drop("_terms")
    df = df.withColumn("spans", let(spans, trim_jurisdiction).cast(SPANS))
    df = df.withColumn("spans", on(extend_addresses))
    df = df.withColumn("spans", drop_generic_counties(drop_overlong_orgs(spans)))
    df = df.withColumn("spans", on(merge_spans))
    df = df.withColumn("spans", drop_overlong_orgs(spans))
    judged = let_all(lambda spans, text: F.transform(spans, lambda s: F.struct(invalid_reason(text, s).alias("reason"), s.alias("span"))), spans=spans, text=text)
    df = df.withColumn("_judged", judged)
    gone = F.transform(F.filter("_judged", lambda j: j["reason"].isNotNull()), lambda j: _suppressed(F.concat(F.lit("invalid_span_"), j["reason"]), j["span"]))
    df = df.withColumn("suppressed", F.concat("suppressed", gone).cast(SUPPRESSED))
    return df.withColumn("spans", F.transform(F.filter("_judged", lambda j: j["reason"].isNull()), lambda j: j["span"])).drop("_judged")


def identify(df: DataFrame) -> DataFrame:
    """W3 and W4 on arrays: ``spans`` gain ``entity_id``."""
    from redactory.operators.entities import CLUSTERED

    spans = F.col("spans")
    df = df.withColumn("_named", _only(spans, *CLUSTERED)).withColumn("_rest", _but(spans, *CLUSTERED))
    df = df.withColumn("_ids", _clustered(F.transform("_named", lambda s: F.struct(s["label"].alias("label"), s["text"].alias("text")))))
    named = F.transform("_named", lambda s, i: _identified(s, F.get(F.col("_ids"), i)["id"], F.when(F.get(F.col("_ids"), i)["joined"], F.least(F.lit(1.0), s["confidence"] + 0.07)).otherwise(s["confidence"])))

    def numbered(rest):
        keys = F.array_distinct(F.transform(rest, lambda s: F.struct(s["label"].alias("label"), F.trim(s["text"]).alias("text"))))

        def number(s, keys):
            same = F.filter(keys, lambda k: k["label"] == s["label"])
            place = F.array_position(F.transform(same, lambda k: k["text"]), F.trim(s["text"]))
            return _identified(s, F.concat_ws("_", s["label"], place.cast("string")), s["confidence"])

        return let(keys, lambda keys: F.transform(rest, lambda s: number(s, keys)))

    both = F.concat(named.cast(IDENTIFIED), let(F.col("_rest"), numbered).cast(IDENTIFIED))
    return df.withColumn("spans", F.sort_array(both)).drop("_named", "_rest", "_ids")


def _identified(s: Column, entity_id: Column, confidence: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), s["text"].alias("text"), confidence.alias("confidence"), s["source"].alias("source"), entity_id.alias("entity_id"))


def rewrite(df: DataFrame) -> DataFrame:
    """Adds ``replacements``, ``redacted_text`` and the counts."""
    df = df.withColumn("replacements", let_all(build_replacements, text=F.col("text"), spans=F.col("spans")))
    n_ids = F.size(F.array_distinct(F.transform("spans", lambda s: s["entity_id"])))
    return df.withColumns({"redacted_text": let_all(apply_replacements, text=F.col("text"), replacements=F.col("replacements")), "n_redactions": F.size("replacements"), "n_entities": n_ids})


def redact(docs: DataFrame, mode: str = "rules", labels: Iterable[str] | None = None, exclusions: str | None = None, model_spans: DataFrame | None = None, decisions: DataFrame | None = None, rules=R.RULES, budget: Budget = Budget(), extractor=None, validator=None, store=None, **model):
    """Q1 to Q3: ``docs`` (doc_id, text, ...) with ``spans``, ``suppressed``,
    ``replacements``, ``redacted_text``, ``n_redactions`` and ``n_entities``.

    ``rules``: patterns alone, no shuffle. ``rules_override``: with ``model_spans``
    (doc_id, start, end, label, text, confidence, source) joined by document.
    ``constrained_overrides`` and ``llm_overrides`` first let ``decisions``
    (doc_id, start, end, label, keep) drop rule spans of ORG, NAME and LOC, or of
    any label. Model spans whose ``needs_redaction`` is false are left out (F16).
    ``budget`` bounds the search for further occurrences; by default it is whole.
    A null text counts as empty.

    With an ``extractor`` (and a ``validator`` and a ``DecisionStore`` as ``store``)
    the model side is run as well, and a ``model_chain.Redaction`` is returned: the
    redacted documents, the quarantined ones, warnings and new decisions."""
    if extractor is not None:
        from redactory.plans.model_chain import redact_with_model

        return redact_with_model(docs, "rules_override" if mode == "rules" else mode, extractor, validator, store, exclusions, labels=labels, rules=rules, budget=budget, **model)
    mode = normalize_mode(mode)
    if mode not in ("rules", "rules_override", "constrained_overrides", "llm_overrides"):
        raise ValueError(f"unknown mode {mode!r}")
    lexicon = Lexicon.read(docs.sparkSession, exclusions)
    guarded = mode != "llm_overrides"
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    df = detect(docs, lexicon, labels, rules).withColumn("suppressed", F.array().cast(SUPPRESSED))
    if mode != "rules":
        df = _with_model(df, model_spans, decisions, mode)
    if guarded:
        df = drop_combinations(df, NameHelpers(lexicon))
    return rewrite(identify(post_process(df, lexicon, guarded, budget)))


def _with_model(df: DataFrame, model_spans: DataFrame | None, decisions: DataFrame | None, mode: str) -> DataFrame:
    spans = F.col("spans")
    if mode != "rules_override" and decisions is not None:
        skip = decisions.where("not keep").groupBy("doc_id").agg(F.collect_set(F.struct("start", "end", "label")).alias("_skip"))
        df = df.join(skip, "doc_id", "left")
        listed = lambda s: F.coalesce(F.exists("_skip", lambda k: (k["start"] == s["start"]) & (k["end"] == s["end"]) & (k["label"] == s["label"])), F.lit(False))
        open_to = lambda s: F.lit(True) if mode == "llm_overrides" else s["label"].isin("ORG", "NAME", "LOC")
        formed = lambda s: (s["label"] == "ORG") & s["text"].rlike(R.ORG_FORM_ANYWHERE)
        drop = lambda s: listed(s) & open_to(s) & ~formed(s)
        df = df.withColumn("suppressed", F.concat("suppressed", F.transform(F.filter(spans, drop), lambda s: _suppressed(F.lit("llm_override_skip"), s))))
        df = df.withColumn("spans", F.filter(spans, lambda s: ~drop(s))).drop("_skip")
    if model_spans is not None:
        packed = keep_redactable(model_spans).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "label", "text", "confidence", "source"))).cast(SPANS).alias("_model"))
        df = df.join(packed, "doc_id", "left").withColumn("spans", F.concat(spans, F.coalesce("_model", F.array().cast(SPANS)))).drop("_model")
    return df
