"""A corpus-cleaning pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again as the next stage's ``docs``; all but the last keep the columns
of documents.

Nulls, long texts, ties, repeats and empty tables are as the stages' operators
define them: a null or letterless text goes in ``language`` (it is ``und``); rows
without an id pass ``lines`` and ``near_duplicates`` unchanged and are judged by their
own text in ``benchmark``; of rows equal in id and text one stays after
``near_duplicates``; an empty table stays empty through all stages. Other columns, of
whatever name, pass with their values through all stages but ``tokens``, which
returns ids, language, source and what it makes of the text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redactory.llm import langid
from redactory.llm.bpe import encode_documents
from redactory.llm.common import materialise, read_documents
from redactory.llm.decontam import decontaminate
from redactory.llm.linededup import dedup_lines
from redactory.llm.neardup import drop_near_duplicates


OWN = ("doc_id", "text", "lang", "source", "n_chars")


def apart(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``operator`` (docs), with the columns of docs. Columns that are not those of
    documents have other names meanwhile, lest an output takes one's place."""
    names = {c: c if c in OWN else f"own_{i}" for i, c in enumerate(docs.columns)}
    out = operator(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items())))
    return out.select(*(F.col(n).alias(c) for c, n in names.items()))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; rejected ones go."""
    model = langid.train(docs)
    return apart(docs, lambda d: langid.identify(d, model).where("not rejected"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without chunks of lines that stand elsewhere before."""
    return apart(docs, dedup_lines)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests of ids and decoded text."""
    out = encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "lang", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("tokens", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    docs = read_documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
