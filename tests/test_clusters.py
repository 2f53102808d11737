"""W4 by indexes equals every mention against every alias."""

import random
import time

from redactory.operators.entities import LINK_AT, cluster_form, cluster_mentions, token_set_ratio


def brute(labels, texts):
    clusters, out = {}, []
    for label, text in zip(labels, texts, strict=True):
        form, groups = cluster_form(text.strip()), clusters.setdefault(label, [])
        scores = [1.0 if form and form in g else max(token_set_ratio(form, a) for a in g) for g in groups]
        best = max(range(len(groups)), key=lambda i: (scores[i], -i), default=-1)
        joined = best >= 0 and scores[best] >= LINK_AT and scores[best] > 0
        if not joined:
            groups.append(set())
            best = len(groups) - 1
        groups[best].add(form)
        out.append((f"{label}_{best + 1}", joined))
    return out


def mention(rng, firsts, lasts):
    words = [rng.choice(firsts) for _ in range(rng.randrange(1, 3))] + [rng.choice(lasts) for _ in range(rng.randrange(0, 3))]
    text = " ".join(words)
    if rng.random() < 0.3 and len(text) > 3:  # a slip of the pen
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(["", "x", text[i] * 2]) + text[i + 1 :]
    return rng.choice([text, text.upper(), text + " Inc.", f" {text} & Co"])


def test_equal_to_all_pairs():
    for seed in range(40):
        rng = random.Random(seed)
        word = lambda n: "".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, n)))
        firsts, lasts = [word(6) for _ in range(5)], [word(10) for _ in range(12)]
        texts = [mention(rng, firsts, lasts) for _ in range(120)] + ["", "  ", "&", "é à", "É À"]
        rng.shuffle(texts)
        labels = [rng.choice(["NAME", "ORG"]) for _ in texts]
        assert cluster_mentions(labels, texts) == brute(labels, texts)


def test_many_mentions():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwyz") for _ in range(rng.randrange(4, 11)))
    firsts, lasts = [word() for _ in range(400)], [word() for _ in range(4000)]
    texts = [f"{rng.choice(firsts)} {rng.choice(lasts)}" for _ in range(8000)]
    took = []
    for n in (2000, 8000):
        began = time.perf_counter()
        assert len(cluster_mentions(["NAME"] * n, texts[:n])) == n
        took.append(time.perf_counter() - began)
    assert took[1] < 30 and took[1] < 14 * took[0]  # four times the mentions; all pairs would be sixteen
    again = texts[:1000] * 10
    began = time.perf_counter()
    cluster_mentions(["NAME"] * len(again), again)
    assert time.perf_counter() - began < 20


def test_many_groups_reach_the_helper_at_once(spark):
    from redactory.operators.entities import cluster_entities, cluster_mentions

    rows = [(d, at, at + 3, label, text, None if at % 2 else 0.98, "rule") for d in range(30) for at, (label, text) in enumerate([("ORG", "Acme Inc"), ("ORG", "Acme"), ("NAME", "Ann Lee"), ("DATE", "May 1"), ("ORG", f"Zeta {d}"), ("NAME", "Lee Ann")])]
    out = cluster_entities(spark.createDataFrame(rows, "doc_id long, start int, end int, label string, text string, confidence double, source string"))
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.columns[:7] == ["doc_id", "start", "end", "label", "text", "confidence", "source"]
    got = {(r.doc_id, r.start): (r.entity_id, round(r.confidence, 6)) for r in out.collect()}
    for d in range(30):
        for label in ("ORG", "NAME"):
            mine = [r for r in rows if r[0] == d and r[3] == label]
            for r, (entity, joined) in zip(mine, cluster_mentions([label] * len(mine), [r[4] for r in mine]), strict=True):
                assert got.pop((d, r[1])) == (entity, round(min(1.0, (0.7 if r[5] is None else r[5]) + (0.07 if joined else 0)), 6))
    assert not got
