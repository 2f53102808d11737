"""The fixed schemas that operators pass to each other."""

from __future__ import annotations

from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,label:string,text:string,confidence:double,source:string>"
SPANS = f"array<{SPAN}>"
SPAN_COLUMNS = ("start", "end", "label", "text", "confidence", "source")
SPAN_TABLE = "doc_id bigint, start int, end int, label string, text string, confidence double, source string"


def pack_spans(spans, columns=SPAN_COLUMNS):
    """Long form to one row a document: ``doc_id``, ``spans`` in (start, end) order."""
    return spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("spans"))


def explode_spans(docs, *keep):
    """One row a span from documents with a ``spans`` array."""
    return docs.select("doc_id", *keep, F.explode("spans").alias("_s")).select("doc_id", *keep, "_s.*")
