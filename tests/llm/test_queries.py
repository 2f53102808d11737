import corpus_pipeline
from redactory.llm import queries

COLUMNS = {
    "op1_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op3_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op7_minhash_neardup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op11_periodic_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op12_ngram_join": ["doc_id", "n_shingles", "component_id"],
    "op9_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
}


def test_one_query_for_each_operator(spark, sf):
    found = queries.queries()
    assert [sum(n.startswith(f"op{i}_") for n in found) for i in range(1, 14)] == [1] * 13
    for name, first in COLUMNS.items():
        df = found[name](spark, sf)
        assert df.columns[: len(first)] == first and df.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "lines", "near_duplicates", "benchmark", "tokens"]
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        if i < 4:
            assert docs.columns == columns
    assert 0 < docs.count() <= 200


def test_pipeline_stages_take_odd_rows(spark, sf):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    clean = "Anea of the ring was in the of eran over them and they were under that which is not here."
    rows = [(1, None, "en", None, None), (2, "", None, "s", 0), (None, clean, "en", "s", 90), (5, clean, "en", "s", 90), (5, clean, "en", "s", 90), (6, clean, None, None, 90)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, columns)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        left = [r.doc_id for r in docs.collect()]
        assert sorted(x for x in left if x) == ([5] if given else []) and left.count(None) == (1 if given else 0)


def test_pipeline_keeps_columns_of_clashing_names(spark):
    clean = "Anea of the ring was in the of eran over them and they were under that which is not here."
    extra = {"rejected": "r", "score": 1.5, "lang_pred": "x", "n_removed": -1, "keys": "k", "h": 2, "node": 3, "row": "w"}
    kinds = "rejected string, score double, lang_pred string, n_removed int, keys string, h long, node long, `row` string"
    docs = spark.createDataFrame([(5, clean, "en", "s", 90, *extra.values())], "doc_id long, text string, lang string, source string, n_chars long, " + kinds)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    (row,) = docs.collect()
    assert {k: row[k] for k in extra} == extra and row.text == clean
