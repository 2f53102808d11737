"""Replacements and their application: tags, rewritten text, review segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redactory.functions.text import is_low_confidence
from redactory.operators.scan import between

REPLACEMENT = "struct<start:int,end:int,replacement:string,low_confidence:boolean,label:string>"
SEGMENT = "struct<kind:string,text:string>"


def replacement(text: Column, s: Column) -> Column:
    """E10 for one span: ``[entity_id]`` (else ``[label]``); a possessive is taken
    in and written again; within brackets the tag loses its first and last character."""
    tag = F.concat(F.lit("["), F.coalesce(F.when(s["entity_id"] != "", s["entity_id"]), s["label"]), F.lit("]"))
    owns = between(text, s["end"], s["end"] + 2) == "'s"
    end = F.when(owns, s["end"] + 2).otherwise(s["end"])
    tag = F.when(owns, F.concat(tag, F.lit("'s"))).otherwise(tag)
    inside = (s["start"] > 0) & (between(text, s["start"] - 1, s["start"]) == "[") & (between(text, end, end + 1) == "]")
    tag = F.when(inside, F.substring(tag, F.lit(2), F.length(tag) - 2)).otherwise(tag)
    low = is_low_confidence(F.coalesce(s["confidence"], F.lit(0.7)))
    return F.struct(s["start"].cast("int").alias("start"), end.cast("int").alias("end"), tag.alias("replacement"), low.alias("low_confidence"), s["label"].alias("label"))


def build_replacements(text: Column, spans: Column) -> Column:
    """Replacements of spans, all of which are to be redacted (see F16)."""
    return F.transform(spans, lambda s: replacement(text, s)).cast(f"array<{REPLACEMENT}>")


def apply_replacements(text: Column, replacements: Column) -> Column:
    """One pass over the replacements in order, gap by gap. A replacement
    that starts inside its predecessor (after a possessive was taken in) gives way."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, r):
        fits = r["start"] >= acc["at"]
        out = F.concat(acc["out"], between(text, acc["at"], r["start"]), r["replacement"])
        return F.struct(F.when(fits, r["end"]).otherwise(acc["at"]).alias("at"), F.when(fits, out).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], between(text, acc["at"], F.length(text)))
    return F.when(F.size(replacements) == 0, text).otherwise(F.aggregate(F.sort_array(replacements), begin, step, rest))


def edit_segments(text: Column, replacements: Column) -> Column:
    """Keep, delete and insert segments in order. Without inserts they give
    the original; without deletes, the rewritten text."""
    one = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("text"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SEGMENT}>").alias("out"))

    def step(acc, r):
        fits = r["start"] >= acc["at"]
        more = F.array(one("keep", between(text, acc["at"], r["start"])), one("delete", between(text, r["start"], r["end"])), one("insert", r["replacement"]))
        return F.struct(F.when(fits, r["end"]).otherwise(acc["at"]).alias("at"), F.when(fits, F.concat(acc["out"], more)).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.array(one("keep", between(text, acc["at"], F.length(text)))))
    return F.filter(F.aggregate(F.sort_array(replacements), begin, step, rest), lambda s: s["text"] != "")


def accept_edits(segments: Column) -> Column:
    """Deletions go, insertions stay. A deletion that holds white space and
    would glue two words leaves one blank; runs of blanks are squeezed."""

    def step(acc, s):
        glue = acc["cut"] & acc["out"].rlike(r"\w$") & s["text"].rlike(r"^\w")
        out = F.concat(acc["out"], F.when(glue, " ").otherwise(""), s["text"])
        gone = s["kind"] == "delete"
        return F.struct(F.when(gone, acc["out"]).otherwise(out).alias("out"), F.when(gone, s["text"].rlike(r"\s")).otherwise(F.lit(False)).alias("cut"))

    begin = F.struct(F.lit("").alias("out"), F.lit(False).alias("cut"))
    return F.regexp_replace(F.aggregate(segments, begin, step, lambda acc: acc["out"]), " {2,}", " ")


def reject_edits(segments: Column) -> Column:
    """The original text."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["kind"] != "insert"), lambda s: s["text"]), "")


def keep_redactable(spans: DataFrame) -> DataFrame:
    """F16: spans that no decision has released; without a word on it they stay."""
    return spans.where("coalesce(needs_redaction, true)") if "needs_redaction" in spans.columns else spans


def redact_text(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """E10 and E11 on the long form: (doc_id, redacted_text, n_redactions, n_entities)."""
    columns = [c for c in ("start", "end", "label", "confidence", "entity_id") if c in spans.columns]
    extra = [F.lit(None).cast("string").alias("entity_id")] if "entity_id" not in columns else []
    packed = keep_redactable(spans).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*columns, *extra))).alias("spans"))
    text, found = F.col("text"), F.col("spans")
    out = docs.select("doc_id", "text").join(packed, "doc_id", "left")
    done = F.when(found.isNull(), text).otherwise(apply_replacements(text, build_replacements(text, found)))
    n_ids = F.size(F.array_distinct(F.transform(found, lambda s: F.coalesce(s["entity_id"], s["label"]))))
    return out.select("doc_id", done.alias("redacted_text"), F.coalesce(F.when(found.isNotNull(), F.size(found)), F.lit(0)).alias("n_redactions"), F.coalesce(F.when(found.isNotNull(), n_ids), F.lit(0)).alias("n_entities"))
