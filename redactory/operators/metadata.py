"""Metadata tables: policies, snapshots, differences, findings and link targets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- V5: policies -------------------------------------------------------------
FIELDS = ("author", "last_modified_by", "title", "subject", "keywords", "company", "manager", "revision", "totaltime", "created", "modified", "last_printed", "application", "appversion", "template", "comments", "track_changes", "hyperlinks", "custom_properties", "thumbnail")
PRESETS = {"maximum": dict.fromkeys(FIELDS, True), "none": dict.fromkeys(FIELDS, False), "balanced": {f: f not in ("title", "created", "modified", "application") for f in FIELDS}}


def _plain(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def build_policy(spark: SparkSession, preset: str = "maximum", overrides: dict[str, bool] | None = None, flags: dict[str, bool] | None = None) -> DataFrame:
    """V5: policy(field, action): the preset, then a map, then flags; later wins.
    Names match without case and punctuation; unknown names are an error."""
    actions = dict(PRESETS[preset])
    known = {_plain(f): f for f in actions}
    for layer in (overrides or {}, flags or {}):
        for name, value in layer.items():
            if _plain(name) not in known:
                raise ValueError(f"unknown metadata field {name!r}")
            actions[known[_plain(name)]] = bool(value)
    return spark.createDataFrame(sorted(actions.items()), "field string, action boolean")


# --- J9, A12, Q4, Q5 --------------------------------------------------------------
def diff_snapshots(before: DataFrame, after: DataFrame, policy: DataFrame) -> DataFrame:
    """(doc_id, field, before, after, status): cleaned or unchanged where the
    policy acts, preserved or observed elsewhere."""
    b = before.select("doc_id", "field", F.col("value").alias("before"))
    a = after.select("doc_id", "field", F.col("value").alias("after"))
    both = b.join(a, ["doc_id", "field"], "full_outer").join(policy, "field", "left")
    same = F.coalesce("before", F.lit("")) == F.coalesce("after", F.lit(""))
    acts = F.coalesce("action", F.lit(False))
    status = F.when(acts & ~same, "cleaned").when(acts, "unchanged").when(same, "preserved").otherwise("observed")
    return both.select("doc_id", "field", "before", "after", status.alias("status"))


STATUSES = ("cleaned", "preserved", "unchanged", "observed")


def diff_summary(diff: DataFrame, *by: str) -> DataFrame:
    """How many fields of each status, per document."""
    return diff.groupBy("doc_id", *by).agg(*(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))


def scrub_columns(snapshot: DataFrame, policy: DataFrame) -> DataFrame:
    """Q4: the snapshot after the policy: fields it acts on are emptied."""
    return snapshot.join(policy, "field", "left").select("doc_id", "field", F.when(F.coalesce("action", F.lit(False)), "").otherwise(F.col("value")).alias("value"))


def metadata_report(snapshot: DataFrame) -> DataFrame:
    """Q5: every field as observed."""
    return snapshot.select("doc_id", "field", F.col("value").alias("before"), F.col("value").alias("after"), F.lit("observed").alias("status"))


# --- A13 -----------------------------------------------------------------------
WIDE = ("author", "last_modified_by", "revision", "totaltime", "created", "modified", "last_printed", "application", "appversion")
GENERATORS = ("apache poi", "aspose", "libreoffice", "openxmlsdk")


def first_authors(events: DataFrame) -> DataFrame:
    """(doc_id, content_author) from authored events (doc_id, kind, author, date):
    the earliest dated author of the changes, else of the comments."""
    when = F.try_to_timestamp("date")
    named = events.where("coalesce(trim(author), '') != ''").withColumn("_when", when)
    order = F.struct(F.col("_when").isNull(), F.coalesce("_when", F.timestamp_seconds(F.lit(0))), F.trim("author"))
    kinds = named.groupBy("doc_id", "kind").agg(F.min_by(F.trim("author"), order).alias("a"))
    return kinds.groupBy("doc_id").agg(F.min_by("a", F.when(F.col("kind") == "change", 0).otherwise(1)).alias("content_author"))


def metadata_findings(snapshot: DataFrame, now: str, events: DataFrame | None = None) -> DataFrame:
    """(doc_id, position, severity, title, detail) of inconsistent metadata;
    ``now`` is a timestamp text, so results do not depend on the clock."""
    wide = snapshot.groupBy("doc_id").pivot("field", list(WIDE)).agg(F.first("value"))
    if events is not None:
        wide = wide.join(first_authors(events), "doc_id", "left")
    else:
        wide = wide.withColumn("content_author", F.lit(None).cast("string"))
    number = lambda c: F.trim(F.col(c)).try_cast("int")
    at = lambda c: F.try_to_timestamp(F.col(c))
    rev, minutes = number("revision"), number("totaltime")
    author, last, content = (F.trim(F.coalesce(F.col(c), F.lit(""))) for c in ("author", "last_modified_by", "content_author"))
    differs = lambda a, b: (a != "") & (b != "") & (F.lower(a) != F.lower(b))
    app, version = F.lower(F.coalesce("application", F.lit(""))), F.trim(F.coalesce("appversion", F.lit("")))
    made = app.rlike("|".join(GENERATORS))
    limit = F.to_timestamp(F.lit(now)) + F.expr("interval 1 day")
    checks = [
        ("high", "Possible revision/edit time mismatch", (rev >= 20) & ((minutes <= 1) | (minutes / F.greatest(rev, F.lit(1)) < 0.1) | ((rev >= 50) & (minutes < 5))), F.concat_ws(" ", F.lit("revision"), "revision", F.lit("minutes"), "totaltime")),
        ("medium", "Author mismatch", differs(author, content), F.concat_ws(" / ", author, content)),
        ("medium", "Last Modified By mismatch", differs(last, content) & ~differs(author, content), F.concat_ws(" / ", last, content)),
        ("medium", "Timestamp anomaly", at("modified") < at("created"), F.concat_ws(" < ", "modified", "created")),
        ("info", "Print before modification", at("last_printed") < at("modified") - F.expr("interval 5 minutes"), F.concat_ws(" < ", "last_printed", "modified")),
        *(("high", "Future timestamp detected", at(c) > limit, F.concat_ws(" ", F.lit(c), c)) for c in ("created", "modified", "last_printed")),
        ("info", "Automated authoring software", (app != "") & made, F.col("application")),
        ("low", "Suspicious application version", app.contains("microsoft") & ~made & version.startswith("1."), F.concat_ws(" ", "application", "appversion")),
    ]
    found = F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(i).alias("position"), F.lit(sev).alias("severity"), F.lit(title).alias("title"), detail.alias("detail"))) for i, (sev, title, test, detail) in enumerate(checks)))
    return wide.select("doc_id", F.inline(F.array_compact(found)))


# --- X18 -------------------------------------------------------------------------
REDACTED_URN = "urn:redactory:redacted"


def is_unc(t: Column) -> Column:
    return t.startswith("\\\\") | t.startswith("//")


def is_user_path(t: Column) -> Column:
    return t.rlike(r"[\\](Users|home)[\\]|/(Users|home)/") | t.contains("%USERPROFILE%")


def is_file_path(t: Column) -> Column:
    return t.startswith("file:") | t.rlike(r"^[A-Za-z]:[\\/]") | t.startswith("/") | t.startswith("./") | t.startswith("../")


def is_internal(t: Column) -> Column:
    host = F.regexp_extract(t, "^https?://([^/]*)", 1)
    return t.rlike("^https?://") & (host.rlike(r"^(127\.|10\.|192\.168\.|169\.254\.)|\.local$|\.lan$") | ~host.contains("."))


def target_class(t: Column) -> Column:
    """X18"""
    return F.when(is_unc(t), "unc_path").when(is_user_path(t), "user_path").when(is_internal(t), "internal_url").when(is_file_path(t), "file_path").otherwise("external")


def sanitize_target(t: Column, kind: Column | None = None, ole: bool = True, unc: bool = True, user: bool = True, internal: bool = True, file: bool = True) -> Column:
    """A link target, or a URN where the policy hides it."""
    kind = F.lit("") if kind is None else kind
    tests = [(ole, kind.contains("oleObject")), (unc, is_unc(t)), (user, is_user_path(t)), (internal, is_internal(t)), (file, is_file_path(t))]
    out = F.when(F.lit(False), t)
    for on, test in tests:
        if on:
            out = out.when(test, REDACTED_URN)
    return out.otherwise(t)
