import hashlib
import random
import time

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from redactory.llm.bpe import PRE_TOKEN, encode_documents, load
from redactory.llm.common import Splitter
from redactory.llm.queries import op5_bpe
from redactory.llm.tokencount import PATTERN
from tests.llm.common import edge_rows

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.lists(st.one_of(st.text(max_size=8), st.sampled_from(["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "Σ", "İ", "ﬁ", " ", "\x85", "\x1c"]))).map("".join))
def test_equals_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    got, tokens = load(PATH).encode(text)
    assert got == " ".join(map(str, ids)) and tokens == LIBRARY.decode(ids, skip_special_tokens=False) == load(PATH).decode(ids)


@pytest.mark.parametrize("pattern", [PRE_TOKEN, PATTERN])
def test_latin_classes_are_the_unicode_ones(pattern):
    split, rng = Splitter(pattern), random.Random(1)
    every = "".join(c + a + c for c in map(chr, [*range(0x180), 0x307]) for a in " a1")
    texts = [every, *("".join(rng.choices([*map(chr, range(0x180)), *" \n'slt" * 20], k=40)) for _ in range(2000))]
    assert all(split.latin.findall(t) == split.any.findall(t) for t in texts)
    assert split.of("ſ") is split.latin and split.of("\u0180") is split.any


def test_query_equals_the_library(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op5_bpe(spark, sf).collect():
        ids = LIBRARY.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_forced_boundaries_never_cut_a_token():
    bpe = load(PATH)
    for token in list(bpe.ids)[:20000]:
        parts = bpe.split_token(token)
        assert all(p in bpe.inside for p in zip(parts, parts[1:], strict=False))


def test_documents(spark):
    df = spark.createDataFrame([(*r, "c") for r in edge_rows()], "doc_id long, text string, decoded string")
    out = encode_documents(df, PATH).collect()
    assert len(out) == len(edge_rows())
    for r in out:
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert encode_documents(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("unit", ["a", "an", "the", "xq", "é", "0", "-"])
def test_long_words_take_no_quadratic_time(unit):
    rng = random.Random(3)
    bpe = load(PATH)
    for word in (unit * (300_000 // len(unit)), "".join(rng.choice("etaoin") for _ in range(100_000))):
        began = time.perf_counter()
        got, _ = bpe.encode(word)
        assert time.perf_counter() - began < 20
        assert got == " ".join(map(str, LIBRARY.encode(word, add_special_tokens=False).ids))


@settings(max_examples=200, deadline=None, derandomize=True)
@given(st.text("aeinorst'", min_size=1, max_size=60))
def test_both_merges_agree(word):
    bpe = load(PATH)
    symbols = [bpe.symbol[b] for b in word.encode()]
    symbols[-1] += bpe.end
    assert bpe.merge(list(symbols)) == bpe.merge_long(list(symbols))
