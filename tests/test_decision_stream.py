"""Keys are asked once and answered from the state, over late rows and restarts."""

import time
from datetime import datetime

import pytest

from redactory.streaming.decisions import SETTINGS, decision_events

MENTION, DECISION = "text string, label string, ts timestamp", "key string, classification string, decision_confidence double, ts timestamp"


@pytest.fixture
def streams(spark, tmp_path):
    before = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    paths = [str(tmp_path / n) for n in ("mentions", "decisions")]
    seen = [0]

    def at(minute):
        return datetime(2024, 1, 1, 0, minute)

    def step(mentions=(), decisions=(), ttl=3600):
        """Add rows, run the stream to its end and return the new events: each call
        starts the query anew from its checkpoint."""
        for path, rows, schema in zip(paths, (mentions, decisions), (MENTION, DECISION)):
            spark.createDataFrame([(*r[:-1], at(r[-1])) for r in rows], schema).coalesce(1).write.mode("append").parquet(path)
        sources = [spark.readStream.schema(s).parquet(p) for p, s in zip(paths, (MENTION, DECISION))]
        events = decision_events(*sources, ttl_seconds=ttl)
        out = str(tmp_path / "out")
        events.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        rows = sorted((r.event, r.key.replace("\x1f", "/"), r.classification, r.at.minute) for r in spark.read.parquet(out).collect())
        new = list(rows)
        for old in seen[1:]:
            new.remove(old)
        seen[1:] = rows
        return new

    yield step
    for k, v in before.items():
        spark.conf.set(k, v)


def test_keys_are_asked_once_and_answered(streams):
    assert streams([("Ann Lee", "NAME", 5), ("ann lee ", "NAME", 3), ("Bo Ray", "NAME", 6), (None, "NAME", 1), ("x", None, 1)]) == [("ask", "ann lee/NAME", None, 3), ("ask", "bo ray/NAME", None, 6)]
    # still waiting: not asked again, also not after a restart
    assert streams([("Ann Lee", "NAME", 9)]) == []
    assert streams(decisions=[("ann lee\x1fNAME", "SKIP", 0.9, 10), (None, "SKIP", 0.9, 1)]) == [("update", "ann lee/NAME", "SKIP", 10)]
    # a row that is very late is answered from the state
    assert streams([("Ann LEE", "NAME", 0), ("Ann Lee", "NAME", 59)]) == [("answer", "ann lee/NAME", "SKIP", 0), ("answer", "ann lee/NAME", "SKIP", 59)]
    # the answer changes; an older decision that comes later does not count
    assert streams([("Ann Lee", "NAME", 30)], [("ann lee\x1fNAME", "REDACT", None, 20), ("ann lee\x1fNAME", "KEEP", 0.5, 15)]) == [("answer", "ann lee/NAME", "REDACT", 30), ("update", "ann lee/NAME", "REDACT", 20)]
    assert streams([("Ann Lee", "NAME", 31)], [("ann lee\x1fNAME", "SKIP", 0.9, 12)]) == [("answer", "ann lee/NAME", "REDACT", 31)]
    # decided before it was met
    assert streams(decisions=[("cy fox\x1fNAME", "SKIP", 0.9, 1)]) == [("update", "cy fox/NAME", "SKIP", 1)]
    assert streams([("Cy Fox", "NAME", 2)]) == [("answer", "cy fox/NAME", "SKIP", 2)]


def test_state_ends(streams):
    assert streams([("Ann Lee", "NAME", 1)], ttl=1) == [("ask", "ann lee/NAME", None, 1)]
    time.sleep(1.5)
    assert streams([("Ann Lee", "NAME", 2)], ttl=1) == [("ask", "ann lee/NAME", None, 2)]
