"""Tables of a run that appear together: data first, one manifest last.

Every table goes to a folder of its own; then a manifest that names the folders is
written under a temporary name and renamed, which is one step in the file system.
Readers follow manifests only, so a run that ended early shows nothing, and a second
attempt starts afresh. All paths are Hadoop paths and reach any shared store.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Files:
    """Small files of a folder that Spark's own file system reaches."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self._path, self._charset = jvm.org.apache.hadoop.fs.Path, jvm.java.nio.charset.StandardCharsets.UTF_8
        self._io, self.root = jvm.org.apache.commons.io.IOUtils, root.rstrip("/")
        self.fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self._path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str = "") -> list[str]:
        path = self.at(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self._io.toString(stream, self._charset)
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a whole file in one step; False if it is there already."""
        target, draft = self.at(name), self.at(f".{uuid.uuid4().hex}.tmp")
        if self.fs.exists(target):
            return False
        stream = self.fs.create(draft, False)
        try:
            self._io.write(text, stream, self._charset)
        finally:
            stream.close()
        self.fs.mkdirs(target.getParent())
        # a rename that meets a target written meanwhile moves nothing
        done = not self.fs.exists(target) and self.fs.rename(draft, target)
        if not done:
            self.fs.delete(draft, False)
        return done

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the folder that all executors share
    (``spark.checkpoint.dir``); what reads it does not compute it again."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if root is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="redactory-"))
    return df.checkpoint(eager=True)


class RunExists(ValueError):
    pass


def write_run(spark: SparkSession, path: str, run_id: str, tables: Mapping[str, DataFrame], facts: Mapping[str, str] | None = None) -> dict:
    """Write all ``tables`` of a run, then its manifest, which is returned.

    A run that was not committed is written again from the start; a committed one is
    never touched. If anything fails no table of this attempt can be read."""
    files, attempt = Files(spark, path), uuid.uuid4().hex
    if f"{run_id}.json" in files.names("_runs"):
        raise RunExists(run_id)
    entries = {}
    try:
        for name, df in tables.items():
            seen, folder = Observation(), f"run_id={run_id}/attempt={attempt}/{name}"
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").parquet(f"{files.root}/{folder}")
            entries[name] = {"folder": folder, "rows": seen.get["n"], "schema": df.schema.jsonValue()}
        manifest = {"run_id": run_id, "tables": entries, "facts": dict(facts or {})}
        if not files.create(f"_runs/{run_id}.json", json.dumps(manifest)):
            raise RunExists(run_id)
    except BaseException:
        files.delete(f"run_id={run_id}/attempt={attempt}")
        raise
    return manifest


def committed_runs(spark: SparkSession, path: str) -> list[str]:
    """The runs that readers see, by name."""
    return [n.removesuffix(".json") for n in Files(spark, path).names("_runs") if n.endswith(".json")]


def read_manifest(spark: SparkSession, path: str, run_id: str) -> dict:
    if run_id not in committed_runs(spark, path):
        raise FileNotFoundError(f"run {run_id} is not committed")
    return json.loads(Files(spark, path).read(f"_runs/{run_id}.json"))


def read_run(spark: SparkSession, path: str, run_id: str) -> dict[str, DataFrame]:
    """The tables of a committed run by name."""
    from pyspark.sql.types import StructType

    manifest = read_manifest(spark, path, run_id)
    return {name: spark.read.schema(StructType.fromJson(t["schema"])).parquet(f"{path.rstrip('/')}/{t['folder']}") for name, t in manifest["tables"].items()}


def sweep_attempts(spark: SparkSession, path: str) -> list[str]:
    """Delete what no manifest names: leftovers of runs that ended early. To be
    called while no run is being written; returns the folders deleted."""
    files, gone = Files(spark, path), []
    named = {t["folder"].rsplit("/", 1)[0] for run in committed_runs(spark, path) for t in read_manifest(spark, path, run)["tables"].values()}
    for run in (n for n in files.names() if n.startswith("run_id=")):
        for attempt in files.names(run):
            if f"{run}/{attempt}" not in named:
                files.delete(f"{run}/{attempt}")
                gone.append(f"{run}/{attempt}")
    return gone
