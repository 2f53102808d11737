"""The pipeline on the gold corpus, its properties, and streams."""

import pytest
from pyspark.sql import functions as F

from redactory.operators import scan, score
from redactory.plans.pipeline import redact
from redactory.streaming.streams import new_keys_stream, redact_stream, scan_stream

CORPUS = [
    (1, "Name:   Jordan Casey\nHeader contact: jordan.casey@example.com\n"),
    (2, "Name:   Taylor Brooks\n"),
    (3, "Please write to Jane Doe at jane.doe@example.com or call (415) 555-0182.\n"),
    (4, "The SSN on record is 123-45-6789, card 4111-1111-1111-1111.\n"),
    (5, "A retainer of $12,500.00 is due by January 15, 2024.\n"),
    (6, "This letter is between Acme Redwood Corp. and the client.\n"),
    (7, "The property is at 742 Evergreen Terrace, Springfield, IL 62704.\n"),
    (8, "Name:   Sam Jacobs\n"),
    (9, "Vertex Analytics Group LLC\n"),
    (10, None),
    (11, ""),
]
GOLD = [
    (1, "NAME", "Jordan Casey"), (1, "EMAIL", "jordan.casey@example.com"), (2, "NAME", "Taylor Brooks"), (3, "EMAIL", "jane.doe@example.com"), (3, "PHONE", "415) 555-0182"),
    (4, "SSN", "123-45-6789"), (4, "CARD", "4111-1111-1111-1111"), (5, "MONEY", "12,500.00"), (5, "DATE", "January 15, 2024"), (6, "ORG", "Acme Redwood Corp."),
    (7, "LOC", "742 Evergreen Terrace, Springfield, IL 62704"), (8, "NAME", "Sam Jacobs"), (9, "ORG", "Vertex Analytics Group LLC"),
]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, "doc_id long, text string")


@pytest.fixture(scope="module")
def redacted(corpus):
    return redact(corpus).cache()


def test_gold_corpus(spark, redacted):
    pred = redacted.select("doc_id", F.inline("spans")).withColumn("at", F.col("start"))
    gold = spark.createDataFrame([(*g, i) for i, g in enumerate(GOLD)], "doc_id long, label string, text string, at int")
    out = {r.label: r for r in score.evaluate(gold, pred).collect()}
    assert all(r.passed for r in out.values()), out


def test_spans_are_valid_and_do_not_leak(redacted):
    for r in redacted.collect():
        at = 0
        for s in sorted(r.spans, key=lambda s: s.start):
            assert s.start >= at and r.text[s.start : s.end] == s.text
            at = s.end
        assert all(s.text not in r.redacted_text for s in r.spans if s.label in ("EMAIL", "SSN", "CARD", "NAME"))
    assert {r.doc_id: r.redacted_text for r in redacted.collect()}[10] == ""


def test_partitions_do_not_matter(corpus, redacted):
    want = {(r.doc_id, r.redacted_text) for r in redacted.collect()}
    assert want == {(r.doc_id, r.redacted_text) for r in redact(corpus.repartition(5)).collect()}


def test_streams_equal_the_batch(spark, corpus, redacted, tmp_path):
    corpus.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(corpus.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    redact_stream(stream(), str(tmp_path / "cp"), str(tmp_path / "out")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.redacted_text) for r in got.collect()} == {(r.doc_id, r.redacted_text) for r in redacted.collect()}
    scan_stream(stream(), ["EMAIL"]).writeStream.format("parquet").option("path", str(tmp_path / "scan")).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    emails = spark.read.parquet(str(tmp_path / "scan")).select("doc_id", F.inline("spans"))
    assert emails.count() == scan.scan_rules(corpus, ["EMAIL"]).count()
    spans = spark.createDataFrame([("A", "NAME", "2024-01-01 00:00:00"), ("a ", "NAME", "2024-01-01 00:01:00"), ("b", "NAME", "2024-01-01 00:02:00")], "text string, label string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    spans.coalesce(1).write.parquet(str(tmp_path / "spans"))
    keys = new_keys_stream(spark.readStream.schema(spans.schema).parquet(str(tmp_path / "spans")))
    keys.writeStream.format("parquet").option("path", str(tmp_path / "keys")).option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "keys")).count() == 2


def test_model_spans_and_decisions(spark, corpus):
    model = spark.createDataFrame([(3, 16, 24, "NAME", "Jane Doe", 0.9, "llm"), (3, 5, 9, "NAME", "wrong", 0.9, "llm")], "doc_id long, start int, end int, label string, text string, confidence double, source string")
    out = {r.doc_id: r for r in redact(corpus, "enhanced", model_spans=model).collect()}
    assert "Jane Doe" not in out[3].redacted_text and out[2].redacted_text == "Name:   [NAME_1]\n"
    with pytest.raises(ValueError):
        redact(corpus, "other")
