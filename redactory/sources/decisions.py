"""The kept decisions of validators: a keyed table that outlives a run.

A decision belongs to a key (text and label of a mention). Appends write their rows
to a new folder and then one numbered log entry; the entry of a number can be created
once, so writers that meet take the next number. Readers take the rows of all entries
and, for each key, the decision of the highest entry: the newest wins, whatever the
order in which rows are read. ``compact`` replaces all entries by one.

Nulls, ties, repeats: rows with a null key are not kept; of several decisions for one
key in one append the surest is taken, then the alphabetically first. An empty store
reads as an empty table.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from redactory.sources.commits import Files

DECISION = "key string, classification string, decision_confidence double"


class DecisionStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    def entries(self) -> list[tuple[int, str]]:
        """(number, batch) of the log entries that count: the last compaction and
        what came after it."""
        log = [(int(n.removesuffix(".json")), json.loads(self.files.read(f"_log/{n}"))) for n in self.files.names("_log") if n.endswith(".json")]
        whole = max((i for i, (_, e) in enumerate(log) if e["replaces"]), default=0)
        return [(number, e["batch"]) for number, e in log[whole:]]

    def read(self) -> DataFrame:
        """(key, classification, decision_confidence): the newest decision of each key."""
        entries = self.entries()
        if not entries:
            return self.spark.createDataFrame([], DECISION)
        numbers = self.spark.createDataFrame(entries, "number long, batch string")  # one row for each append
        rows = self.spark.read.schema(DECISION + ", batch string").option("basePath", f"{self.path}/data").parquet(*(f"{self.path}/data/batch={b}" for _, b in entries))
        return _first(rows.join(F.broadcast(numbers), "batch"), -F.col("number"))

    def append(self, decisions: DataFrame) -> int | None:
        """Keep ``decisions``; the number of the entry, or None if there were none."""
        rows = decisions.where("key is not null").select("key", F.col("classification").cast("string").alias("classification"), F.col("decision_confidence").cast("double").alias("decision_confidence"))
        return self._commit(_first(rows), None)

    def compact(self) -> int | None:
        """One entry in place of all so far. If a decision is appended meanwhile the
        compaction is given up and None returned."""
        entries = self.entries()
        return self._commit(self.read(), entries[-1][0]) if len(entries) > 1 else None

    def _commit(self, rows: DataFrame, replaces: int | None) -> int | None:
        batch, seen = uuid.uuid4().hex, Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/data/batch={batch}")
        while seen.get["n"]:
            number = replaces + 1 if replaces is not None else max((n for n, _ in self.entries()), default=-1) + 1
            if self.files.create(f"_log/{number:012d}.json", json.dumps({"batch": batch, "replaces": replaces is not None})):
                return number
            if replaces is not None:
                break
        self.files.delete(f"data/batch={batch}")
        return None


def _first(rows: DataFrame, *order: Column) -> DataFrame:
    """One decision for each key: by ``order``, then the surest, then by name."""
    kept = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), (-F.coalesce("decision_confidence", F.lit(-1.0))).alias("unsure"), "classification", "decision_confidence")
    return rows.groupBy("key").agg(F.min(kept).alias("d")).select("key", "d.classification", "d.decision_confidence")
