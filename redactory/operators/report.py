"""Audit records and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactory.functions.text import confidence_band, content_hash
from redactory.operators.model import decision_key
from redactory.sources.commits import kept, write_run

MODEL_SOURCES = ("llm", "model", "llm_enhanced")
#: fixed values: how much of a report's lists a page shows; records hold all unless told otherwise
SPAN_LIMIT, SUPPRESSED_LIMIT, WARNING_LIMIT, TEXT_LIMIT = 100, 200, 50, 120
WARNING = "struct<code:string,message:string,details:string,start:int,end:int>"


def audit_summary(spans: DataFrame) -> DataFrame:
    """A1: spans, rule spans, model spans and labels of each document."""
    model = F.col("source").isin(*MODEL_SOURCES)
    return spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_spans"), F.count_if(~model).alias("n_rule"), F.count_if(model).alias("n_model"), F.countDistinct("label").alias("n_labels"))


def label_counts(spans: DataFrame) -> DataFrame:
    """A2: spans of each label with their confidence bands."""
    band = confidence_band(F.col("confidence"))
    return spans.groupBy("label").agg(F.count(F.lit(1)).alias("n_spans"), *(F.count_if(band == b).alias(b) for b in ("high", "medium", "low"))).orderBy(F.desc("n_spans"), "label")


def suppression_summary(suppressed: DataFrame) -> DataFrame:
    """A3: suppressed spans by reason and label, with totals."""
    return suppressed.rollup("reason", "label").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("reason", F.lit("ALL")).alias("reason"), F.coalesce("label", F.lit("ALL")).alias("label"), "n")


def top_n_per_label(spans: DataFrame, n: int = SPAN_LIMIT, *by: str) -> DataFrame:
    """The first ``n`` spans of each label (of each document, if ``by`` says so)."""
    order = Window.partitionBy(*by, "label").orderBy("doc_id", "start", "end")
    return spans.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def compare_runs(rules_spans: DataFrame, model_spans: DataFrame) -> DataFrame:
    """Entities each pathway found in a document, and how they differ."""
    a = rules_spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rules"))
    b = model_spans.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_model"))
    both = a.join(b, "doc_id", "full_outer").select("doc_id", F.coalesce("n_rules", F.lit(0)).alias("n_rules"), F.coalesce("n_model", F.lit(0)).alias("n_model"))
    diff = F.col("n_model") - F.col("n_rules")
    return both.withColumn("difference", diff).withColumn("status", F.when(diff > 0, "model_found_more").when(diff < 0, "rules_found_more").otherwise("equal"))


def eta(samples: DataFrame, remaining: DataFrame, *by: str) -> DataFrame:
    """A10: seconds left: remaining size over the rate of the samples; null with
    fewer than two samples or no rate, 0 if nothing is left."""
    pos = lambda c: F.greatest(F.col(c).cast("double"), F.lit(0.0))
    done = samples.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(pos("seconds")).alias("secs"), F.sum(pos("size")).alias("done"))
    left = remaining.groupBy(*by).agg(F.sum(pos("size")).alias("left"))
    both = done.join(left, list(by), "left") if by else done.join(F.broadcast(left))
    rate = F.when((F.col("n") >= 2) & (F.col("secs") > 0) & (F.col("done") > 0), F.col("done") / F.col("secs"))
    gone = F.coalesce("left", F.lit(0.0))
    return both.select(*by, F.when(gone <= 0, 0.0).otherwise(gone / rate).alias("eta_seconds"))


def phase_breakdown(runs: DataFrame) -> DataFrame:
    """Seconds of each phase of a run, its share, and whether it is the longest."""
    sums = runs.groupBy("run_id", "phase").agg(F.sum("seconds").alias("seconds"))
    over = Window.partitionBy("run_id")
    share = F.when(F.sum("seconds").over(over) > 0, 100 * F.col("seconds") / F.sum("seconds").over(over)).otherwise(0.0)
    first = F.row_number().over(over.orderBy(F.desc("seconds"), "phase")) == 1
    return sums.withColumns({"percent": share, "bottleneck": first})


def model_benchmark(runs: DataFrame, baseline: str) -> DataFrame:
    """Mean, least and most seconds of each model, and the speed-up over one."""
    stats = runs.groupBy("model").agg(F.avg("seconds").alias("avg_seconds"), F.min("seconds").alias("min_seconds"), F.max("seconds").alias("max_seconds"))
    base = stats.where(F.col("model") == baseline).select(F.col("avg_seconds").alias("_base"))
    return stats.join(F.broadcast(base.limit(1)), how="left").withColumn("speedup", F.col("_base") / F.col("avg_seconds")).drop("_base")


def rank_findings(findings: DataFrame) -> DataFrame:
    """High, medium, low, info; stable by position."""
    rank = F.coalesce(F.create_map(*(F.lit(x) for p in (("high", 0), ("medium", 1), ("low", 2), ("info", 3)) for x in p))[F.col("severity")], F.lit(99))
    return findings.withColumn("rank", rank).orderBy("doc_id", "rank", "position")


def order_spans(spans: DataFrame) -> DataFrame:
    """Spans in output order within each partition of documents."""
    return spans.repartition("doc_id").sortWithinPartitions("doc_id", "start", "end", "label", "text")


def audit_records(redacted: DataFrame, settings: dict[str, str] | None = None, created_at: str = "1970-01-01T00:00:00Z", model: str = "rules", warnings: DataFrame | None = None, suppressed_limit: int | None = None, warning_limit: int | None = None) -> DataFrame:
    """One nested record a document from the pipeline's output columns.

    Spans carry ``validated`` and ``validation_result`` where the column
    ``validations`` (decision key to result) of the model chain is there. ``warnings``
    (doc_id, code, message, details and perhaps start, end) are listed with their
    document. Texts are cut to 120 characters; lists are whole, or cut to the limits
    given, always with their full counts."""
    checked = "validations" in redacted.columns

    def short(s):
        result = F.col("validations")[decision_key(s["text"], s["label"])] if checked else F.lit(None).cast("string")
        validated = F.when(result.isNotNull(), F.lit(True)) if checked else F.lit(None).cast("boolean")
        kept = (s[c].alias(c) for c in ("start", "end", "label", "entity_id", "confidence", "source"))
        return F.struct(*kept, F.substring(s["text"], 1, TEXT_LIMIT).alias("text"), validated.alias("validated"), result.alias("validation_result"))

    cut = lambda c, n: F.col(c) if n is None else F.slice(c, 1, n)
    options = F.create_map(*(F.lit(x) for kv in (settings or {"rules": "default"}).items() for x in kv))
    told = redacted
    if warnings is not None:
        place = [F.col(c) if c in warnings.columns else F.lit(None).cast("int").alias(c) for c in ("start", "end")]
        listed = warnings.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("code", "message", "details", *place))).cast(f"array<{WARNING}>").alias("warnings"))
        told = redacted.join(listed, "doc_id", "left")
    none = F.array().cast(f"array<{WARNING}>")
    told = told.withColumn("warnings", F.coalesce("warnings", none) if warnings is not None else none)
    return told.select(
        "doc_id", F.lit(created_at).alias("created_at"), content_hash(F.col("text")).alias("input_sha256"), F.lit(model).alias("model"), F.transform("spans", short).alias("spans"),
        cut("suppressed", suppressed_limit).alias("suppressed"), F.size("suppressed").alias("n_suppressed"), cut("warnings", warning_limit).alias("warnings"), F.size("warnings").alias("n_warnings"), options.alias("settings"),
    )


def write_audit(redacted: DataFrame, path: str, **how) -> None:
    """The records as JSON lines."""
    audit_records(redacted, **how).write.mode("errorifexists").json(path)


def write_redaction(redacted: DataFrame, path: str, run_id: str, quarantine: DataFrame | None = None, warnings: DataFrame | None = None, settings: dict[str, str] | None = None, **how) -> dict:
    """One run's redacted texts, audit records, failures and warnings, all or
    none; the manifest is returned. Documents in ``quarantine`` are failures and
    have no redacted text."""
    spark, full = redacted.sparkSession, kept(redacted)
    failures = quarantine if quarantine is not None else spark.createDataFrame([], f"doc_id {redacted.schema['doc_id'].dataType.simpleString()}, code string, message string, details string")
    told = warnings if warnings is not None else failures.select("doc_id", "code", "message", "details").limit(0)
    shown = full.drop("text", "spans", "suppressed", "replacements", "validations")
    tables = {"redacted": shown, "audit": audit_records(full, settings, warnings=warnings, **how), "failures": failures, "warnings": told}
    return write_run(spark, path, run_id, tables, settings)


def invalid_spans(spans: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """F10 on the long form: (valid, suppressed, warnings)."""
    from redactory.plans.pipeline import invalid_reason

    s = F.struct("start", "end", F.col("_s.text").alias("text"))
    joined = spans.withColumn("_s", F.struct("text")).drop("text").join(docs.select("doc_id", F.col("text").alias("_text")), "doc_id")
    judged = joined.withColumn("reason", invalid_reason(F.col("_text"), s)).withColumn("text", F.col("_s.text")).drop("_s", "_text")
    valid = judged.where("reason is null").select(*spans.columns)
    bad = judged.where("reason is not null")
    suppressed = bad.select("doc_id", F.concat(F.lit("invalid_span_"), "reason").alias("reason"), "label", F.substring("text", 1, TEXT_LIMIT).alias("text"), "start", "end", "confidence", "source")
    warnings = bad.select("doc_id", F.lit("INVALID_SPAN_DROPPED").alias("code"), F.lit("span dropped before redaction").alias("message"), F.concat_ws(" ", F.concat(F.lit("label="), "label"), F.concat(F.lit("reason="), "reason")).alias("details"))
    return valid, suppressed, warnings
