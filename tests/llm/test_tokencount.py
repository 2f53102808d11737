import random
import time
import re

import public_tokenizers
import pytest

from redactory.llm.queries import EDIT, op10_token_counts
from redactory.llm.tokencount import PATTERN, EditPattern, TokenTree, apply_edits, attach_edits, count_tokens, load
from tests.llm.common import edge_rows

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("seed", range(3))
def test_edits_equal_a_full_count(seed):
    assert PATTERN == public_tokenizers.PATTERN
    rng, counter = random.Random(seed), load(PATH)
    letters = [*"ab1 '\n\t#", "  ", "'s", "'ll", "é", "漢", "😀", "   ", "foo", "12"]
    make = lambda n: "".join(rng.choices(letters, k=n))
    for _ in range(300):
        text = make(rng.choice([0, 1, 5, 40, 600]))
        edits = [(s, min(len(text), s + rng.choice([0, 1, 3, 30])), make(rng.randrange(5))) for s in (rng.randint(0, len(text)) for _ in range(rng.randrange(6)))]
        tree = TokenTree(text, counter)
        assert tree.total == len(counter.encoding.encode_ordinary(text))
        apply_edits(tree, edits, len(text))
        at, want = 0, []
        for s, e, r in sorted(edits):
            if s >= at:
                want.append((s, e, r))
                at = max(s, e)
        for s, e, r in reversed(want):
            text = text[:s] + r + text[e:]
        assert tree.text() == text and tree.total == len(counter.encoding.encode_ordinary(text)) and tree.chars[1] == len(text)


def test_only_touched_regions_are_encoded_again():
    tree = TokenTree("some plain words here " * 5000, load(PATH))
    tree.edit(50_000, 50_004, "new")
    assert tree.reencoded < 40


def test_documents(spark):
    df = spark.createDataFrame([(*r, 5) for r in edge_rows()], "doc_id long, text string, n_edits int")
    edits = spark.createDataFrame([(5, 0, 2, "X"), (5, 1, 9, "overlaps"), (5, 4, 6, None), (4, 0, 10**9, ""), (1, 0, 5, "new")], "doc_id long, start int, stop int, replacement string")
    out = count_tokens(attach_edits(df, edits), PATH).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(edge_rows()) and by[4].n_tokens_edited == 0 and by[5].n_edits == 2 and by[1].edited_text == "new"
    assert by[6].n_tokens == by[6].n_tokens_edited and by[None].n_edits == 0
    enc = load(PATH).encoding
    assert all(r.n_tokens_edited == len(enc.encode_ordinary(r.edited_text)) for r in out)
    found = count_tokens(df, PATH, texts=False, find=EditPattern([("w", "w1")]))
    assert found.count() == len(edge_rows()) and count_tokens(df.limit(0), PATH, find=EditPattern([("", "a")])).count() == 0


def test_edits_by_alternatives_equal_the_whole_pattern():
    rng, whole = random.Random(3), re.compile("|".join(p for _, p in EDIT))
    for _ in range(2000):
        text = "".join(rng.choices(["a", "b.c", "@", "12", "3456", "-", " ", "***", "%%", "%", "$$$", "#", "é", "\n"], k=rng.randrange(30)))
        assert [e[:2] for e in EditPattern(EDIT).edits(text)] == [m.span() for m in whole.finditer(text)]


def test_query_equals_a_full_count(spark, sf):
    enc, whole = load(PATH).encoding, re.compile("|".join(p for _, p in EDIT))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op10_token_counts(spark, sf).collect():
        text = texts[r.doc_id]
        assert r.n_tokens == len(enc.encode_ordinary(text)) and r.n_edits == len(whole.findall(text))
        assert r.n_tokens_edited == len(enc.encode_ordinary(whole.sub("", text)))


def test_edits_of_long_words_take_no_quadratic_time():
    found = EditPattern(EDIT)
    for text in ("@ " + "a" * 1_000_000, "a." * 300_000 + "@", "1" * 300_000 + "@", "a@" * 200_000, "x@b.org " * 50_000):
        began = time.perf_counter()
        edits = found.edits(text)
        assert time.perf_counter() - began < 10
    assert len(edits) == 50_000 and edits[0] == (0, 7, "")
