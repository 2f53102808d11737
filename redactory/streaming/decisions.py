"""Decision keys over streams, with a state of their own.

A stream of mentions (text, label) becomes a stream of events by key: ``ask`` the
first time a key is met, ``answer`` for a mention of a key that is decided. Decisions
come back on a second stream and may change later; each change is an ``update``. The
state of a key ends ``ttl`` after it was last asked for or decided, so a key that is
met again much later is asked again. Rows late by any time are answered from the
state, as no watermark drops them; state is kept by the checkpoint over restarts.

Nulls, ties, repeats: mentions without text or label, and decisions without key, are
passed over. A key that is waiting for its decision is not asked again. Of decisions
that meet, the later ``at`` counts, an equal one replaces nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from redactory.operators.model import decision_key

SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
EVENT = "key string, event string, text string, label string, classification string, decision_confidence double, at timestamp"
STATE = "classification string, decision_confidence double, at timestamp"


class Decided(StatefulProcessor):
    """One value a key: its decision, or empty while it is asked for."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("decision", STATE, self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = self.held.get()
        best, mentions = None, []
        for part in rows:
            for r in part.itertuples(index=False):
                if r.classification is None:
                    mentions.append(r)
                elif best is None or r.at > best.at:
                    best = r
        out = []
        if best is not None and (held is None or held[0] is None or best.at > held[2]):
            new = (best.classification, None if pd.isna(best.decision_confidence) else float(best.decision_confidence), best.at)
            out.append((key[0], "update", None, None, *new))
            held = new
            self.held.update(held)
        if mentions:
            if held is None:
                first = min(mentions, key=lambda r: (r.at is pd.NaT, r.at))
                out.append((key[0], "ask", first.text, first.label, None, None, first.at))
                held = (None, None, None)
            elif held[0] is not None:
                out += [(key[0], "answer", r.text, r.label, held[0], held[1], r.at) for r in mentions]
            self.held.update(held)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in EVENT.split(", ")])

    def close(self) -> None:
        pass


def decision_events(mentions: DataFrame, decisions: DataFrame, ttl_seconds: int = 30 * 86400) -> DataFrame:
    """Events (key, event, text, label, classification, decision_confidence, at)
    of the streams ``mentions`` (text, label, ts) and ``decisions`` (key,
    classification, decision_confidence, ts).

    The session needs ``SETTINGS``: the state store that keeps values by key, and no
    batches without data, of which a state that ends by time asks for one after
    another, so that a query with ``availableNow`` would not end."""
    none = lambda kind: F.lit(None).cast(kind)
    asked = mentions.where("text is not null and label is not null").select(
        decision_key(F.col("text"), F.col("label")).alias("key"), "text", "label", none("string").alias("classification"), none("double").alias("decision_confidence"), F.col("ts").alias("at")
    )
    told = decisions.where("key is not null and classification is not null").select("key", none("string").alias("text"), none("string").alias("label"), "classification", F.col("decision_confidence").cast("double").alias("decision_confidence"), F.col("ts").alias("at"))
    return asked.unionByName(told).groupBy("key").transformWithStateInPandas(statefulProcessor=Decided(1000 * ttl_seconds), outputStructType=EVENT, outputMode="Append", timeMode="ProcessingTime")
