"""Runs that appear whole or not at all, and decisions that outlive a run."""

import json
import subprocess
import sys
import threading

import pytest
from pyspark.sql import functions as F

from redactory.sources import commits
from redactory.sources.commits import Files, RunExists, committed_runs, read_manifest, read_run, sweep_attempts, write_run
from redactory.sources.decisions import DecisionStore


def failing(spark):
    return spark.range(4).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).alias("id"))


def test_a_run_is_whole_or_absent(spark, tmp_path):
    path = str(tmp_path / "out")
    a, b = spark.range(5), spark.createDataFrame([(1, None), (2, "x")], "doc_id int, text string")
    with pytest.raises(Exception, match="lost"):
        write_run(spark, path, "r1", {"a": a, "bad": failing(spark), "b": b})
    assert committed_runs(spark, path) == [] and sweep_attempts(spark, path) == []
    with pytest.raises(FileNotFoundError):
        read_run(spark, path, "r1")
    manifest = write_run(spark, path, "r1", {"a": a, "b": b, "none": b.limit(0)}, {"mode": "rules"})
    assert {n: t["rows"] for n, t in manifest["tables"].items()} == {"a": 5, "b": 2, "none": 0}
    got = read_run(spark, path, "r1")
    assert sorted(map(tuple, got["b"].collect())) == [(1, None), (2, "x")] and got["a"].count() == 5 and got["none"].schema == b.schema
    assert read_manifest(spark, path, "r1")["facts"] == {"mode": "rules"}
    with pytest.raises(RunExists):
        write_run(spark, path, "r1", {"a": spark.range(9)})
    assert read_run(spark, path, "r1")["a"].count() == 5


KILLED = """
import os, sys
from pyspark.sql import SparkSession
from redactory.sources import commits
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
create = commits.Files.create
commits.Files.create = lambda *a: os._exit(7) if sys.argv[2] == "before" else (create(*a), os._exit(7))
commits.write_run(spark, sys.argv[1], "r", {"a": spark.range(3), "b": spark.range(4)})
"""


@pytest.mark.parametrize("moment, seen", [("before", []), ("after", ["r"])])
def test_a_writer_that_dies(spark, tmp_path, moment, seen):
    """The process ends right before or right after the manifest is there."""
    path = str(tmp_path / "out")
    assert subprocess.run([sys.executable, "-c", KILLED, path, moment], capture_output=True, timeout=120, cwd=sys.path[0] or ".").returncode == 7
    assert committed_runs(spark, path) == seen
    assert len(sweep_attempts(spark, path)) == 1 - len(seen)
    if not seen:
        write_run(spark, path, "r", {"a": spark.range(3), "b": spark.range(4)})
    assert {n: df.count() for n, df in read_run(spark, path, "r").items()} == {"a": 3, "b": 4}


def test_writers_of_one_run_meet(spark, tmp_path, monkeypatch):
    path, create = str(tmp_path / "out"), Files.create

    def late(self, name, text):
        create(self, name, json.dumps({"run_id": "r", "tables": {}, "facts": {}}))  # another writer was first
        return create(self, name, text)

    monkeypatch.setattr(commits.Files, "create", late)
    with pytest.raises(RunExists):
        write_run(spark, path, "r", {"a": spark.range(3)})
    assert read_run(spark, path, "r") == {}


def decisions(spark, *rows):
    return spark.createDataFrame(rows, "key string, classification string, decision_confidence double")


def held(store):
    return {r.key: (r.classification, r.decision_confidence) for r in store.read().collect()}


def test_newest_decision_wins(spark, tmp_path):
    store = DecisionStore(spark, str(tmp_path / "store"))
    assert held(store) == {} and store.append(decisions(spark).limit(0)) is None
    assert store.append(decisions(spark, ("a", "SKIP", 0.9), ("a", "REDACT", 0.99), ("b", "SKIP", None), (None, "SKIP", 1.0), ("c", "X", 0.5), ("c", "K", 0.5))) == 0
    assert held(store) == {"a": ("REDACT", 0.99), "b": ("SKIP", None), "c": ("K", 0.5)}
    assert store.append(decisions(spark, ("a", "SKIP", 0.2))) == 1
    again = DecisionStore(spark, str(tmp_path / "store"))
    assert held(again)["a"] == ("SKIP", 0.2) and held(again)["b"] == ("SKIP", None)
    before = held(again)
    assert again.compact() == 2 and held(store) == before and len(store.entries()) == 1 and again.compact() is None
    assert store.append(decisions(spark, ("b", "REDACT", 0.7))) == 3 and held(again)["b"] == ("REDACT", 0.7)


def test_a_failed_append_is_not_seen(spark, tmp_path):
    store = DecisionStore(spark, str(tmp_path / "store"))
    store.append(decisions(spark, ("a", "SKIP", 0.9)))
    bad = failing(spark).select(F.col("id").cast("string").alias("key"), F.lit("SKIP").alias("classification"), F.lit(1.0).alias("decision_confidence"))
    with pytest.raises(Exception, match="lost"):
        store.append(bad)
    assert held(store) == {"a": ("SKIP", 0.9)}


def test_appends_at_the_same_time(spark, tmp_path):
    path = str(tmp_path / "store")
    made = []
    jobs = [threading.Thread(target=lambda i=i: made.append(DecisionStore(spark, path).append(decisions(spark, (f"k{i}", "SKIP", 0.9))))) for i in range(5)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    assert sorted(made) == [0, 1, 2, 3, 4] and set(held(DecisionStore(spark, path))) == {f"k{i}" for i in range(5)}


def test_a_compaction_that_is_overtaken(spark, tmp_path):
    store = DecisionStore(spark, str(tmp_path / "store"))
    for i in range(3):
        store.append(decisions(spark, (f"k{i}", "SKIP", 0.9)))
    entries = store.entries()
    late = DecisionStore(spark, store.path)
    late.entries = lambda: entries  # it saw three entries, then a fourth came
    store.append(decisions(spark, ("k0", "REDACT", 0.9)))
    assert late.compact() is None and held(store)["k0"] == ("REDACT", 0.9) and len(held(store)) == 3
