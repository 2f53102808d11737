"""Q2 in one call: extractor, validator, kept decisions, quarantine, and the run's tables."""

import json
import os
import re
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from redactory.operators import model, report
from redactory.plans.model_chain import ask_extractor, ask_validator, model_spans, redact_with_model
from redactory.plans.pipeline import redact
from redactory.sources.commits import committed_runs, read_run
from redactory.sources.decisions import DecisionStore

FILLER = "and so it went on from one day to the next without any word of it. "
DOCS = [
    (1, "We met Maria Stone and Peter Gray. Maria Stone left."),
    (2, "The board heard Peter Gray, who spoke with Walter Pine."),
    (3, "Nothing here for BOOM at all, says Maria Stone."),
    (4, FILLER * 60 + "At last Walter Pine came. " + FILLER * 20 + "BOOM. " + FILLER * 10),
    (5, None),
    (6, FILLER * 70 + "Then Anna Ray wrote to anna.ray@example.com. " + FILLER * 30),
    (7, "garbled Olga Wood"),
    (None, "no id, Maria Stone"),
    (8, "first Maria Stone"),
    (8, "second Peter Gray"),
]


def log(folder, what):
    with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
        json.dump(what, f)


def logged(folder):
    return [x for n in sorted(os.listdir(folder)) for x in json.load(open(os.path.join(folder, n)))]


def extractor(folder):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        if batch["text"].str.contains("BOOM").any():
            raise RuntimeError("no answer, see /home/u/log.txt")
        log(folder, [int(d) for d in batch["doc_id"]])
        found = [[{"text": m, "type": "PERSON"} for m in re.findall(r"\b[A-Z][a-z]+ (?:Stone|Gray|Pine|Ray|Wood)\b", t)] for t in batch["text"]]
        replies = ["{]" if "garbled" in t else json.dumps({"entities": f}) for f, t in zip(found, batch["text"])]
        return batch[["doc_id", "chunk_no"]].assign(response=replies)

    return run


def validator(folder):
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["text"] == "Walter Pine").any():
            raise RuntimeError("validator is down")
        log(folder, list(batch["key"]))
        assert len(batch) <= 20
        return batch[["key"]].assign(classification=["SKIP" if "Peter" in t or "Anna" in t else "REDACT" for t in batch["text"]], decision_confidence=[0.5 if "Anna" in t else 0.99 for t in batch["text"]])

    return run


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)


@pytest.fixture
def logs(tmp_path):
    made = [str(tmp_path / n) for n in ("asked_texts", "asked_keys")]
    for m in made:
        os.mkdir(m)
    return made


def test_one_call(spark, corpus, logs, tmp_path):
    store = DecisionStore(spark, str(tmp_path / "decisions"))
    out = redact(corpus, extractor=extractor(logs[0]), validator=validator(logs[1]), store=store)
    rows = {r.doc_id: r for r in out.redacted.collect()}
    bad = {r.doc_id: r for r in out.quarantine.collect()}
    # every document is in one of the two
    assert set(rows) == {1, 2, 5, 6} and set(bad) == {3, 4, 7, 8, None}
    assert rows[1].redacted_text == "We met [NAME_1] and Peter Gray. [NAME_1] left."
    # a key without an answer is redacted, as is a SKIP that is not sure
    assert rows[2].redacted_text == "The board heard Peter Gray, who spoke with [NAME_1]."
    assert "Anna Ray" not in rows[6].redacted_text and "anna.ray" not in rows[6].redacted_text and rows[5].redacted_text == ""
    assert bad[3].code == "AI_CHUNK_EXTRACTION_INCOMPLETE" and [tuple(r) for r in bad[3].ranges] == [(0, len(DOCS[2][1]))]
    assert "RuntimeError" in bad[3].details and "/home" not in bad[3].details and "chunk 1/1" in bad[3].details
    at = DOCS[3][1].index("BOOM")
    assert bad[4].ranges and all(a <= at < b for a, b in bad[4].ranges) and len(bad[4].ranges) < 4
    assert "UNPARSEABLE_RESPONSE" in bad[7].details and bad[8].code == "DOCUMENT_ID_REPEATED" and bad[None].code == "DOCUMENT_ID_MISSING"
    codes = {(r.doc_id, r.code) for r in out.warnings.collect()}
    assert {(3, "LLM_CHUNK_FAILED"), (4, "LLM_CHUNK_FAILED"), (7, "LLM_CHUNK_FAILED"), (2, "VALIDATION_FAILED")} == codes
    keys = logged(logs[1])
    assert sorted(keys) == sorted(set(keys)) and len(keys) == 3  # each once, though mentioned more often
    held = {r.key.split("\x1f")[0]: r.classification for r in store.read().collect()}
    assert held == {"maria stone": "REDACT", "peter gray": "SKIP", "anna ray": "SKIP"}

    # a second run asks for nothing that is known, and finds the same
    def found():
        again = model_spans(corpus.withColumn("text", F.coalesce("text", F.lit(""))), extractor(logs[0]), validator(logs[1]), DecisionStore(spark, store.path))
        assert logged(logs[1]) == keys and again.decisions.count() == 0
        return sorted((r.doc_id, r.text) for r in again.spans.collect())

    same = [(1, "Maria Stone"), (1, "Maria Stone"), (2, "Walter Pine"), (6, "Anna Ray")]
    assert found() == same
    # what is decided anew is what counts
    store.append(spark.createDataFrame([("peter gray\x1fNAME", "REDACT", 0.9)], "key string, classification string, decision_confidence double"))
    assert found() == sorted([*same, (1, "Peter Gray"), (2, "Peter Gray")])

    manifest = report.write_redaction(out.redacted, str(tmp_path / "runs"), "one", out.quarantine, out.warnings, {"mode": "rules_override"})
    assert {n: t["rows"] for n, t in manifest["tables"].items()} == {"redacted": 4, "audit": 4, "failures": 5, "warnings": out.warnings.count()}
    tables = read_run(spark, str(tmp_path / "runs"), "one")
    audit = {r.doc_id: r for r in tables["audit"].collect()}
    (stone, _) = audit[1].spans
    assert (stone.text, stone.validated, stone.validation_result) == ("Maria Stone", True, "keep")
    assert audit[1].settings == {"mode": "rules_override"} and audit[2].n_warnings == 1 and audit[2].warnings[0].code == "VALIDATION_FAILED"
    assert "text" not in tables["redacted"].columns and tables["failures"].count() == 5
    assert committed_runs(spark, str(tmp_path / "runs")) == ["one"]


def test_overrides_ask_about_rule_spans(spark, logs):
    docs = spark.createDataFrame([(1, "Name:   Peter Gray\nsees Maria Stone at 742 Evergreen Terrace, Springfield, IL 62704.\n")], "doc_id long, text string")
    plain = redact(docs).first().redacted_text
    out = redact_with_model(docs, "constrained_overrides", extractor(logs[0]), validator(logs[1]))
    (row,) = out.redacted.collect()
    assert "Peter Gray" not in plain and "Peter Gray" in row.redacted_text and "Maria Stone" not in row.redacted_text
    assert [s.text for s in row.suppressed if s.reason == "llm_override_skip"] == ["Peter Gray"]


def test_ids_of_any_type(spark, logs):
    docs = spark.createDataFrame([("a", "We met Maria Stone.")], "doc_id string, text string")

    def reads(batch):
        return batch[["doc_id", "chunk_no"]].assign(response='{"entities": [{"text": "Maria Stone", "type": "PERSON"}]}')

    out = redact(docs, extractor=reads)
    assert out.redacted.first().redacted_text == "We met [NAME_1]." and out.quarantine.count() == 0
    empty = redact(docs.limit(0), extractor=reads)
    assert empty.redacted.count() == empty.quarantine.count() == empty.warnings.count() == 0


def test_only_what_fails_is_asked_again(spark, tmp_path):
    folder = str(tmp_path)
    chunks = spark.createDataFrame([(i, 0, f"t{i}") for i in range(40)], "doc_id long, chunk_no int, text string").coalesce(1)

    def flaky(batch):
        log(folder, [int(i) for i in batch["doc_id"]])
        if 5 in set(batch["doc_id"]) or (len(batch) > 1 and 30 in set(batch["doc_id"])):
            raise ValueError("bad")
        return batch[["doc_id", "chunk_no"]].assign(response="{}")[batch["doc_id"] != 7]

    got = {r.doc_id: r for r in ask_extractor(chunks, flaky, 10).collect()}
    assert len(got) == 40 and got[5].error == "ValueError: bad" and got[30].response == "{}" and got[7].response is None and got[7].error is None
    asked = logged(folder)
    assert asked.count(5) == 3 and asked.count(30) == 2 and asked.count(15) == 1
    mentions = spark.createDataFrame([("A b", "NAME"), ("a B ", "NAME"), ("A b", "ORG")], "text string, label string")
    keys = ask_validator(mentions, lambda b: b[["key"]].assign(classification="SKIP", decision_confidence=1.0)).collect()
    assert sorted(r.key for r in keys) == ["a b\x1fNAME", "a b\x1fORG"]


def test_thresholds_see_the_chunks_so_far(spark):
    """The same entities in another order of chunks: another decision."""
    literals, patterns = spark.createDataFrame([], "key string"), spark.createDataFrame([], "pattern string")

    def asked(confidences):
        rows = [(1, chunk, i, i + 5, "LOC", f"Place {i}", c) for chunk, part in enumerate(confidences) for i, c in enumerate(part, 100 * chunk)]
        df = spark.createDataFrame(rows, "doc_id long, chunk_no int, start int, end int, label string, text string, confidence double")
        return [(r.chunk_no, r.confidence, r.needs_validation, round(r.threshold, 4)) for r in model.needs_validation(df, literals, patterns).join(model.running_threshold(df).select("start", "threshold"), "start").orderBy("start").collect()]

    high, low = [0.95, 0.96, 0.97, 0.98, 0.99], [0.91, 0.91, 0.91, 0.91, 0.91]
    first = asked([low, high])
    # five of 0.91: the quartile is 0.91, none is below; then the quartile stays below the high ones
    assert [x[2] for x in first] == [False] * 10 and first[0][3] == 0.91 and first[9][3] == 0.91
    second = asked([high, low])
    # five high ones first: the quartile is 0.96, and 0.95 is below; with the low ones it falls to 0.91
    assert [x[2] for x in second] == [True] + [False] * 9 and second[0][3] == 0.96 and second[9][3] == 0.91
    few = asked([[0.95] * 4, [0.99]])
    assert few[0][3] == 0.7 and few[4][3] == 0.95
    whole = model.confidence_threshold(spark.createDataFrame([(1, "LOC", c) for c in high + low], "doc_id long, label string, confidence double")).first().threshold
    assert round(whole, 4) == 0.91


def test_audit_records_hold_everything(spark):
    df = redact(spark.createDataFrame([(1, "To jane@example.com")], "doc_id long, text string"))
    many = F.transform(F.sequence(F.lit(1), F.lit(500)), lambda i: F.struct(F.lit("r").alias("reason"), F.lit("ORG").alias("label"), i.cast("string").alias("text"), i.alias("start"), (i + 1).alias("end"), F.lit(0.5).alias("confidence"), F.lit("rule").alias("source")))
    df = df.withColumn("suppressed", many)
    whole, cut = report.audit_records(df).first(), report.audit_records(df, suppressed_limit=200).first()
    assert len(whole.suppressed) == whole.n_suppressed == cut.n_suppressed == 500 and len(cut.suppressed) == 200
    assert whole.warnings == [] and whole.spans[0].validated is None
