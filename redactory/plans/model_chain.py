"""Q2 in one call: a model reads chunks, a validator judges what is in doubt, and
documents that were not read whole are set aside.

Order: chunks (E9), responses (V3, S5), places of the entities in their chunks (R21),
titles and generic terms out (F11), document offsets (E8), kept decisions (J7), doubts
(F13) and the validator's answers (V4, F14), documents not read whole (J8), invalid
spans (F10), doubles of overlapping chunks (W2). The rest is ``pipeline.redact``.

Extractor and validator are plain functions of pandas batches. A chunk or a batch of
keys that fails is tried again alone; what fails then is reported: a chunk puts its
document into quarantine, a key stays undecided, and undecided mentions are redacted.
What they return is written once, so no answer is asked for twice in a run; with a
``DecisionStore`` not in a later one either.

Documents are told apart by id: those without one, and those that share one, cannot
be matched with what the model says of them and go to quarantine as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.operators import lexicon as lexicons
from redactory.operators.merge import dedupe_chunk_overlaps
from redactory.operators.model import apply_decisions, attach_cached_decisions, decision_key, drop_titles_and_generics, needs_validation, parse_model_responses
from redactory.operators.report import invalid_spans
from redactory.operators.reshape import make_chunks, rebase_chunk_spans
from redactory.operators.scan import scan_terms
from redactory.sources.commits import kept
from redactory.sources.decisions import DECISION, DecisionStore
from redactory.sources.tables import failure_rows

Batch = Callable[[pd.DataFrame], pd.DataFrame]
#: The validator's batches, and the surety a SKIP needs; fixed values.
KEYS_AT_ONCE, SKIP_CONFIDENCE = 20, 0.95
ATTEMPTS = 2


class ModelSpans(NamedTuple):
    spans: DataFrame  # doc_id, start, end, label, text, confidence, source, validated, validation_result
    suppressed: DataFrame  # reason, doc_id, label, text, start, end, confidence, source
    complete: DataFrame  # the documents that were read whole
    quarantine: DataFrame  # doc_id, code, message, details, ranges
    warnings: DataFrame  # doc_id, code, message, details, start, end
    decisions: DataFrame  # key, classification, decision_confidence: the new ones


class Redaction(NamedTuple):
    redacted: DataFrame
    quarantine: DataFrame
    warnings: DataFrame
    decisions: DataFrame


def _tried(fn: Batch, rows: pd.DataFrame, answer: list[str], key: list[str]) -> pd.DataFrame:
    """``fn`` of a batch, row by row where that fails: key, answer and error columns."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        got = fn(part)[key + answer].drop_duplicates(key)
        return part[key].merge(got, on=key, how="left").assign(error=None)

    try:
        return one(rows)
    except Exception as whole:
        error: Exception = whole
    out = []
    for i in range(len(rows)):
        part = rows.iloc[i : i + 1]
        for _ in range(ATTEMPTS if len(rows) > 1 else ATTEMPTS - 1):
            try:
                out.append(one(part))
                break
            except Exception as e:
                error = e
        else:
            out.append(part[key].assign(**dict.fromkeys(answer), error=f"{type(error).__name__}: {error}"))
    return pd.concat(out, ignore_index=True)


def ask_extractor(chunks: DataFrame, extractor: Batch, chunks_at_once: int = 16) -> DataFrame:
    """V3: (doc_id, chunk_no, response, error), one row for each chunk."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), chunks_at_once):
                yield _tried(extractor, batch.iloc[at : at + chunks_at_once].reset_index(drop=True), ["response"], ["doc_id", "chunk_no"])

    kind = chunks.schema["doc_id"].dataType.simpleString()
    return kept(chunks.select("doc_id", "chunk_no", "text").mapInPandas(run, f"doc_id {kind}, chunk_no int, response string, error string"))


def ask_validator(mentions: DataFrame, validator: Batch, keys_at_once: int = KEYS_AT_ONCE) -> DataFrame:
    """V4: (key, classification, decision_confidence, error) of the distinct keys of
    ``mentions`` (text, label), at most ``keys_at_once`` in a call."""
    keys = mentions.groupBy(decision_key(F.col("text"), F.col("label")).alias("key")).agg(F.min(F.trim("text")).alias("text"), F.first("label").alias("label"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), keys_at_once):
                yield _tried(validator, batch.iloc[at : at + keys_at_once].reset_index(drop=True), ["classification", "decision_confidence"], ["key"])

    return kept(keys.mapInPandas(run, DECISION + ", error string"))


def decide(mentions: DataFrame, asked: DataFrame, validator: Batch | None, store: DecisionStore | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mentions with classification and decision_confidence, new decisions, failed
    keys): kept decisions first, the validator for ``asked`` mentions without one."""
    spark = mentions.sparkSession
    known = kept(store.read()) if store else spark.createDataFrame([], DECISION)
    if validator is None:
        none = spark.createDataFrame([], DECISION + ", error string")
        return attach_cached_decisions(mentions, known), none.drop("error"), none.select("key", "error")
    open_ = attach_cached_decisions(asked, known).where("classification is null").select("text", "label")
    answers = ask_validator(open_, validator)
    fresh = answers.where("error is null and classification is not null").drop("error")
    if store:
        store.append(fresh)
    failed = answers.where("error is not null").select("key", "error")
    return attach_cached_decisions(mentions, known.unionByName(fresh)), fresh, failed


def _split_ids(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents whose id is theirs alone, quarantined others)."""
    shared = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", F.lit("DOCUMENT_ID_REPEATED").alias("code"), F.col("n").cast("string").alias("details"))
    missing = docs.where("doc_id is null").groupBy("doc_id").agg(F.count(F.lit(1)).cast("string").alias("details")).select("doc_id", F.lit("DOCUMENT_ID_MISSING").alias("code"), "details")
    bad = shared.unionByName(missing)
    good = docs.where("doc_id is not null").join(shared.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    return good, bad.select("doc_id", "code", F.lit("not matched with its model results").alias("message"), F.concat("details", F.lit(" documents")).alias("details"))


RANGES = "array<struct<start:int,end:int>>"


def model_spans(docs: DataFrame, extractor: Batch, validator: Batch | None = None, store: DecisionStore | None = None, exclusions: str | None = None, max_chars: int = 2500, overlap: int = 200, threshold: int = 4000, skip_confidence: float = SKIP_CONFIDENCE) -> ModelSpans:
    """The model side of Q2 for ``docs`` (doc_id, text, ...)."""
    docs, odd = _split_ids(docs)
    chunks = make_chunks(docs, max_chars, overlap, threshold)
    answers = ask_extractor(chunks, extractor)
    found, bad = parse_model_responses(answers.where("error is null and response is not null").select("doc_id", "chunk_no", "response"))
    found, bad = kept(found), kept(bad)
    why = F.coalesce("error", F.when(F.col("response").isNull(), "NO_RESPONSE"), "code")
    failed = answers.join(bad.select("doc_id", "chunk_no", "code"), ["doc_id", "chunk_no"], "left").withColumn("why", why).where("why is not null")
    failed = kept(failed.select("doc_id", "chunk_no", "why").join(chunks.select("doc_id", "chunk_no", "start", "end"), ["doc_id", "chunk_no"]))
    totals = answers.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    said = F.concat(F.lit("chars "), "start", F.lit("-"), "end", F.lit(" (chunk "), F.col("chunk_no") + 1, F.lit("/"), "n", F.lit("): "), "why")
    ranges = F.transform(F.sort_array(F.collect_list(F.struct("start", "end", said.alias("said")))), lambda r: r)
    closed = failed.join(totals, "doc_id").groupBy("doc_id").agg(ranges.alias("r"))
    closed = closed.select("doc_id", F.lit("AI_CHUNK_EXTRACTION_INCOMPLETE").alias("code"), F.lit("the document was not read whole").alias("message"), F.concat_ws("; ", F.col("r.said")).alias("details"), F.transform("r", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).cast(RANGES).alias("ranges"))
    quarantine = closed.unionByName(odd.withColumn("ranges", F.array().cast(RANGES)))
    clean = failure_rows(quarantine).select("doc_id", "code", "message", "details")
    quarantine = kept(quarantine.drop("details", "message").join(clean, ["doc_id", "code"]).unionByName(quarantine.where("doc_id is null")).select("doc_id", "code", "message", "details", "ranges"))
    complete = docs.join(closed.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)

    # places in the chunk, then in the document
    at = F.struct("doc_id", "chunk_no").alias("doc_id")
    places = scan_terms(chunks.select(at, "text"), found.select(at, F.col("text").alias("term"), "label"))
    placed = places.select("doc_id.doc_id", "doc_id.chunk_no", "start", "end", "label", "text").distinct()
    literals, patterns = lexicons.read_exclusions(docs.sparkSession, exclusions)
    placed = kept(rebase_chunk_spans(placed, chunks).join(complete.select("doc_id"), "doc_id", "left_semi"))
    sound, gone = drop_titles_and_generics(placed, literals, patterns)
    sound = kept(sound)
    doubtful = needs_validation(sound, literals, patterns).where("needs_validation")
    decided, fresh, undecided = decide(sound, doubtful, validator, store)
    judged = apply_decisions(decided, skip_confidence).withColumn("source", F.lit("llm")).drop("key", "decision_confidence")
    valid, invalid, warned = invalid_spans(judged, complete)
    best = dedupe_chunk_overlaps(valid.drop("chunk_no")).where("needs_redaction")
    result = F.when(F.col("validated"), F.col("validation_result"))
    spans = best.select("doc_id", "start", "end", "label", "text", "confidence", "source", "validated", result.alias("validation_result")).distinct()
    gone = gone.select("doc_id", "reason", "label", "text", "start", "end", "confidence", F.lit("llm_extract").alias("source")).distinct()
    none = lambda kind: F.lit(None).cast(kind)
    warnings = [
        failed.select("doc_id", F.lit("LLM_CHUNK_FAILED").alias("code"), F.concat(F.lit("chunk "), F.col("chunk_no") + 1, F.lit(" was not read")).alias("message"), F.col("why").alias("details"), "start", "end"),
        warned.select("doc_id", "code", "message", "details", none("int").alias("start"), none("int").alias("end")),
        sound.select("doc_id", decision_key(F.col("text"), F.col("label")).alias("key"), "start", "end").join(undecided, "key").select("doc_id", F.lit("VALIDATION_FAILED").alias("code"), F.lit("redacted without a decision").alias("message"), F.col("error").alias("details"), "start", "end"),
    ]
    told = warnings[0].unionByName(warnings[1]).unionByName(warnings[2])
    return ModelSpans(kept(spans), gone.unionByName(invalid.select(*gone.columns)), complete, quarantine, told, fresh)


def rule_overrides(docs: DataFrame, validator: Batch, store: DecisionStore | None, labels: tuple[str, ...] | None, exclusions: str | None = None, skip_confidence: float = SKIP_CONFIDENCE) -> DataFrame:
    """F15's decisions on rule spans of ``labels`` (None: all), in the form that
    ``redact`` takes: (doc_id, start, end, label, keep)."""
    from redactory.operators.scan import scan_rules

    spans = kept(scan_rules(docs, exclusions=exclusions))
    open_ = spans if labels is None else spans.where(F.col("label").isin(*labels))
    decided, _, _ = decide(open_, open_, validator, store)
    return apply_decisions(decided, skip_confidence).select("doc_id", "start", "end", "label", F.col("needs_redaction").alias("keep"))


def redact_with_model(docs: DataFrame, mode: str, extractor: Batch, validator: Batch | None = None, store: DecisionStore | None = None, exclusions: str | None = None, skip_confidence: float = SKIP_CONFIDENCE, **how) -> Redaction:
    """Q2 and Q3: (redacted, quarantine, warnings, new decisions)."""
    from redactory.functions.text import normalize_mode
    from redactory.plans.pipeline import SUPPRESSED, redact

    mode = normalize_mode(mode)
    docs = docs.withColumn("text", F.coalesce("text", F.lit("")))
    model = model_spans(docs, extractor, validator, store, exclusions, skip_confidence=skip_confidence)
    decisions = None
    if mode in ("constrained_overrides", "llm_overrides") and validator is not None:
        decisions = rule_overrides(model.complete, validator, store, ("ORG", "NAME", "LOC") if mode == "constrained_overrides" else None, exclusions, skip_confidence)
    said = F.struct("reason", "label", F.substring("text", 1, 120).alias("text"), "start", "end", "confidence", "source")
    gone = model.suppressed.groupBy("doc_id").agg(F.sort_array(F.collect_list(said)).cast(SUPPRESSED).alias("_gone"))
    checked = model.spans.where("validation_result is not null").groupBy("doc_id").agg(F.collect_set(F.struct(decision_key(F.col("text"), F.col("label")).alias("key"), F.col("validation_result").alias("value"))).alias("_checked"))
    out = redact(model.complete, mode, exclusions=exclusions, model_spans=model.spans, decisions=decisions, **how)
    out = out.join(gone, "doc_id", "left").join(checked, "doc_id", "left")
    out = out.withColumn("suppressed", F.concat("suppressed", F.coalesce("_gone", F.array().cast(SUPPRESSED))))
    out = out.withColumn("validations", F.map_from_entries(F.coalesce("_checked", F.array().cast("array<struct<key:string,value:string>>")))).drop("_gone", "_checked")
    return Redaction(out, model.quarantine, model.warnings, model.decisions)
