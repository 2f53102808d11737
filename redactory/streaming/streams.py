"""The same operators over streams of documents.

A document is complete in one record and shares no state with others, so a
micro-batch gives what the batch run gives on the same documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from redactory.operators.model import decision_key
from redactory.operators.scan import scan_arrays
from redactory.plans.pipeline import redact


def redact_stream(stream: DataFrame, checkpoint: str, out: str, **how) -> StreamingQuery:
    """The batch pipeline on every micro-batch. A batch that is run again
    overwrites its own folder, so results are there once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        redact(batch, **how).select("doc_id", "redacted_text", "n_redactions", "n_entities").write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scan_stream(stream: DataFrame, labels=None) -> DataFrame:
    """Detection alone, stateless: (doc_id, spans)."""
    return stream.select("doc_id", scan_arrays(F.col("text"), labels).alias("spans"))


def new_keys_stream(spans: DataFrame, delay: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Each (text, label) decision key once within the watermark's delay."""
    keyed = spans.withColumn("key", decision_key(F.col("text"), F.col("label")))
    return keyed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["key"]).select("key", "text", "label", time)
