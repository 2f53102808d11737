import math
import random
from collections import Counter

import numpy as np
import pytest

from redactory.llm import queries
from redactory.llm.lmscore import pack, pack_sorted, score_documents, unpack, unpack_sorted
from tests.llm.common import edge_rows, sentence, words


def brute(rows, order, alpha=0.4):
    grams = [Counter() for _ in range(order + 1)]
    docs = [words(t) for _, t in rows]
    own = []
    for w in docs:
        mine = [Counter() for _ in range(order + 1)]
        for n in range(1, order + 1):
            mine[n].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            grams[n].update(mine[n])
        own.append(mine)
    total = sum(grams[1].values())
    out = []
    for w, mine in zip(docs, own, strict=True):
        seen = lambda g: grams[len(g)][g] - mine[len(g)][g]  # noqa: B023, E731
        score = 0.0
        for i in range(len(w)):
            s, lowered = None, 0
            for n in range(min(order, i + 1), 1, -1):
                g = tuple(w[i - n + 1 : i + 1])
                if seen(g) > 0:
                    s = math.log(seen(g) / seen(g[:-1]))
                    break
                lowered += 1
            if s is None:
                s = math.log(max(seen((w[i],)), 0.5) / total)
            score += s + lowered * math.log(alpha)
        out.append((len(w), score if w else None))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_matches_brute_force(spark, order):
    rng = random.Random(order)
    rows = [(i, sentence(rng, rng.randrange(0, 60), 30)) for i in range(80)]
    got = {r.doc_id: r for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string"), order, block_bytes=1500, part_bytes=900).collect()}
    for (d, _), (n, s) in zip(rows, brute(rows, order), strict=True):
        assert got[d].n_words == n and (got[d].log_score is None) == (s is None)
        if s is not None:
            assert math.isclose(got[d].log_score, s, rel_tol=1e-9, abs_tol=1e-9)


def test_edges(spark):
    df = spark.createDataFrame([(*r, 1) for r in edge_rows()], "doc_id long, text string, n_words int")
    out = score_documents(df).collect()
    assert len(out) == len(edge_rows()) and sum(r.log_score is None for r in out) == 3
    assert score_documents(df.limit(0)).count() == 0


def test_query_tells_scrambled_text_apart(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["x a b", "y a c"] * 6 + ["x a c"])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.log_score for r in queries.op8_lm_score(spark, str(tmp_path)).collect()}
    assert got[12] < got[1] - 0.5 and math.isclose(got[12], brute(rows, 3)[12][1])


def test_packing_gives_the_numbers_back():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        keys, counts = np.unique(rng.integers(0, 2**64 - 1, n, np.uint64, endpoint=True)), rng.integers(0, 70_000, n)
        assert (unpack_sorted(pack_sorted(keys)) == keys).all() and (unpack(pack(counts)) == counts).all()
