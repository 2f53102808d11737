from redactory.llm import quality
from tests.llm.common import edge_rows


def test_labels_are_learned(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    odd = labels.where("doc_id % 2 = 1")
    out = quality.score(docs, quality.co_train(docs, odd, train_rows=400, pool_rows=300)).join(labels.where("doc_id % 2 = 0"), "doc_id").collect()
    right = sum(r.kept == (r.quality == 1) for r in out) / len(out)
    assert right > 0.9 and all(0 <= r.quality_score <= 1 for r in out)
    good = [r.quality_score for r in out if r.quality == 1]
    bad = [r.quality_score for r in out if r.quality == 0]
    assert sum(good) / len(good) > sum(bad) / len(bad) + 0.5


def test_edges(spark):
    df = spark.createDataFrame([(*r, None, "s", "x") for r in edge_rows()], "doc_id long, text string, lang string, source string, kept string")
    labels = spark.createDataFrame([(1, 0), (5, 1), (6, 1), (4, 1), (2, 0), (99, 1), (7, None)], "doc_id long, quality int")
    model = quality.co_train(df, labels)
    assert quality.score(df, model).count() == len(edge_rows())
    none = quality.score(df, quality.co_train(df, labels.limit(0))).collect()
    assert {r.quality_score for r in none} == {0.5}
    assert quality.score(df.limit(0), model).count() == 0


def test_toxic_documents_of_good_quality_go(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    odd = labels.where("doc_id % 2 = 1")
    model, toxic = (quality.co_train(docs, odd, label) for label in ("quality", "toxic"))
    out = quality.score(docs, model, toxic=toxic).join(labels.where("doc_id % 2 = 0"), "doc_id").collect()
    found = [r.toxic_score >= 0.3 for r in out if r.toxic == 1 and r.quality == 1]
    alarms = [r.toxic_score >= 0.3 for r in out if r.toxic == 0]
    assert sum(found) > 0.7 * len(found) and sum(alarms) < 0.03 * len(alarms)
    assert not any(r.kept and r.toxic_score >= 0.3 for r in out)


def test_pool_has_no_labelled_rows(spark, monkeypatch):
    seen = []
    sample = quality._sample
    monkeypatch.setattr(quality, "_sample", lambda rows, *a: seen.append({r.text for r in rows.select("text").collect()}) or sample(rows, *a))
    df = spark.createDataFrame([(i, f"text {i}") for i in range(12)], "doc_id long, text string")
    quality.co_train(df, spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int"))
    assert seen == [{f"text {i}" for i in range(8)}, {f"text {i}" for i in range(8, 12)}]
