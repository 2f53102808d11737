"""Reading documents, parts and gold lists; writing results and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactory.sources.commits import read_run, write_run

PART_RANKS = {"header": 0, "footer": 1, "footnote": 2, "endnote": 3, "body": 4}


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", fmt: str = "parquet") -> DataFrame:
    """(doc_id, text, other columns); a null text is empty."""
    df = spark.read.option("wholetext", True).text(path) if fmt == "text" else spark.read.format(fmt).load(path)
    if fmt == "text":
        df = df.select(F.xxhash64("value").alias("doc_id"), F.col("value").alias("text"))
        id_col, text_col = "doc_id", "text"
    rest = [c for c in df.columns if c not in (id_col, text_col)]
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *rest)


def stitch_parts(parts: DataFrame, key: str = "doc_id", rank: str = "part_rank", seq: str = "seq", text: str = "text") -> DataFrame:
    """(key, text): parts in (rank, seq) order, a newline after each."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(seq).alias("s"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    return parts.groupBy(key).agg(F.array_join(F.transform(ordered, lambda p: F.concat(p["t"], F.lit("\n"))), "").alias("text"))


def part_offsets(parts: DataFrame, key: str = "doc_id", rank: str = "part_rank", seq: str = "seq", text: str = "text") -> DataFrame:
    """Parts with ``lo`` and ``hi``: their place in the stitched text."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    before = Window.partitionBy(key).orderBy(rank, seq).rowsBetween(Window.unboundedPreceding, -1)
    lo = F.coalesce(F.sum(n + 1).over(before), F.lit(0)).cast("int")
    return parts.withColumn("lo", lo).withColumn("hi", (F.col("lo") + n).cast("int"))


def map_spans_to_parts(spans: DataFrame, parts: DataFrame, key: str = "doc_id", rank: str = "part_rank", seq: str = "seq", text: str = "text") -> DataFrame:
    """Spans of the stitched text with the part they start in and their
    offsets inside it; a span that runs past its part is cut at its end."""
    placed = part_offsets(parts, key, rank, seq, text).select(F.col(key).alias("doc_id"), F.col(rank).alias("part_rank"), F.col(seq).alias("seq"), "lo", "hi")
    joined = spans.join(placed, "doc_id").where("start >= lo and start <= hi")
    return joined.select(*spans.columns, "part_rank", "seq", (F.col("start") - F.col("lo")).alias("part_start"), (F.least("end", "hi") - F.col("lo")).alias("part_end"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(doc, label, text, start, end) from JSON lists of entities."""
    kind = "array<struct<label:string,text:string,start:int,end:int>>"
    raw = spark.read.schema(f"entities {kind}, expected_entities {kind}").json(path, multiLine=True).withColumn("doc", F.input_file_name())
    return raw.select("doc", F.inline(F.coalesce("entities", "expected_entities")))


def write_redacted(redacted: DataFrame, path: str, run_id: str) -> dict:
    """S7 for one table: seen once its manifest is there (see ``sources.commits``;
    ``report.write_redaction`` writes all tables of a run)."""
    return write_run(redacted.sparkSession, path, run_id, {"redacted": redacted})


def read_redacted(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """A run's redacted texts, only if it was committed as a whole."""
    return read_run(spark, path, run_id)["redacted"]


def failure_rows(errors: DataFrame) -> DataFrame:
    """(doc_id, code, message, details): paths and user names taken out."""
    clean = F.coalesce(F.col("details"), F.lit(""))
    for pattern, with_ in ((r"(?i)file://\S+", "<path>"), (r"[A-Za-z]:\\[^\s\"']+", "<path>"), (r"(?<![\w/])/(?:[\w.\-]+/)+[\w.\-]*", "<path>"), (r"(?i)\b(user(?:name)?\s*[=:]\s*)\S+", "$1<user>")):
        clean = F.regexp_replace(clean, pattern, with_)
    return errors.select("doc_id", F.coalesce("code", F.lit("UNEXPECTED")).alias("code"), F.coalesce("message", F.lit("")).alias("message"), clean.alias("details"))
