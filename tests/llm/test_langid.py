import random
from collections import Counter

from pyspark.sql import functions as F

from redactory.llm import langid
from tests.llm.common import edge_rows


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = langid.train(docs, ~held, train_rows=500)
    out = langid.identify(docs, model).where(held)
    right = out.where("lang_pred = lang").count()
    assert right / out.count() > 0.97 and out.where("rejected").count() <= 0.01 * out.count() + 2


def test_junk_is_rejected(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(4)
    junk = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(3000)]
    texts = [" ".join(rng.sample(junk, 40)) for _ in range(20)] + [" ".join(rng.choices("xzqwkj", k=80)) for _ in range(20)] + ["слово и дело " * 9, "漢字仮名 " * 20]
    out = langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), langid.train(docs, train_rows=800)).collect()
    assert sum(r.rejected for r in out) >= 0.9 * len(texts)


def test_a_rare_language_is_sampled(spark):
    rows = [(i, f"aaa bbb ccc {i}", "x") for i in range(2000)] + [(5000 + i, f"ddd eee fff {i}", "y") for i in range(12)] + [(1, "same", "z")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = Counter(r.lang for r in langid.labelled_sample(df, F.lit(True), 100, 3).collect())
    assert got["y"] == 12 and got["x"] <= 88 and got["z"] <= 1 and sum(got.values()) <= 100
    assert langid.shares({"a": 3, "b": 50, "c": 60}, 33) == {"a": 3, "b": 15, "c": 15}


def test_slices_keep_the_ngrams(monkeypatch):
    texts = [None, "", "Ein Wort, dann é noch eins " * 40, "lang" * 100 + " 12 ok", "x"]

    def grams():
        found = Counter()
        for pieces, at in langid.slices(texts):
            for rows, owner in langid.ngram_rows(pieces, 1 << 16):
                found.update(zip(at[owner].tolist(), rows.tolist(), strict=True))
        return found

    whole = grams()
    monkeypatch.setattr(langid, "SLICE_CHARS", 37)
    assert grams() == whole and len(list(langid.slices(texts))) > 10


def test_edges(spark):
    rows = [(*r, lang) for r, lang in zip(edge_rows(), ["en", "fr"] * 5, strict=True)] + [(50, "12 34 !!", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df, train_rows=10, n_rows=256)
    out = langid.identify(df.withColumn("score", F.lit("clash")), model).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows) and by[1].lang_pred == by[2].lang_pred == by[3].lang_pred == by[50].lang_pred == "und"
    assert by[1].rejected and by[1].score == 0.0 and by[8].lang_pred in ("en", "fr") and 0 <= by[8].score <= 1
    none = langid.train(df.limit(0))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}
    assert langid.identify(df.limit(0), model).count() == 0


def test_many_languages_keep_the_table_narrow(spark):
    df = spark.createDataFrame([(i, chr(97 + i % 26) * 9, f"l{i % 26:02}") for i in range(260)], "doc_id long, text string, lang string")
    model = langid.train(df, n_rows=1024, epochs=8)
    assert model.table.shape == (1024, 16) and model.head.shape == (16, 26)
    out = langid.identify(df, model)
    assert out.where("lang_pred = lang").count() / 260 > 0.9
