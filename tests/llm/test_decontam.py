import random

from redactory.llm.decontam import bands_for, decontaminate, find_contamination
from redactory.llm.queries import op6_decontamination
from tests.llm.common import edge_rows, sentence, shingles


def test_matches_brute_force(spark):
    rng = random.Random(9)
    items = [(i, sentence(rng, rng.choice([5, 8, 15, 30, 70, 150]), 9000)) for i in range(40)] + [(90, None), (91, ""), (92, "one two")]
    docs = []
    for i in range(60):
        body = sentence(rng, rng.choice([20, 300, 4000]), 9000).split()
        item = rng.choice(items[:40])[1].split()
        if i % 3 == 0:
            cut = list(item)
            for _ in range(len(cut) // 40):
                cut[rng.randrange(len(cut))] = "changed"
            at = rng.randrange(len(body))
            body[at:at] = cut
        docs.append((i, " ".join(body)))
    docs += [(100, "one two"), (101, None), (102, ""), (103, "say One Two three"), (104, "one, two two one")]
    want = {(d, 92) for d in (100, 103)} | {(d, i) for d, t in docs for i, s in items if (x := shingles(s, 5)) and len(x & shingles(t, 5)) >= 0.8 * len(x) - 1e-9}
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in find_contamination(a, b).collect()}
    assert got == want and len(want) > 15 and (100, 92) in want
    assert {(r.doc_id, r.item_id) for r in find_contamination(a, b, block_items=7).collect()} == want
    left = {r.doc_id for r in decontaminate(a, b).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}


def test_edges(spark):
    docs = spark.createDataFrame([(*r, "x") for r in edge_rows()], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, edge_rows()[4][1])], "item_id long, text string")
    assert sorted(r.doc_id for r in find_contamination(docs, items).collect()) == [5, 5, 6, 8]
    assert find_contamination(docs, items.limit(0)).count() == 0 and find_contamination(docs.limit(0), items).count() == 0
    assert None in {r.doc_id for r in decontaminate(docs, items).collect()}


def test_bands_follow_the_miss_probability():
    assert bands_for(0.8, 1e-4) < bands_for(0.8, 1e-8) and bands_for(0.8, 1e-4) < bands_for(0.5, 1e-4)


def test_query_equals_brute_force(spark, sf):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    sets = [(i, x) for i, t in items if (x := shingles(t, 5))]
    want = {(d, i, len(x & y), len(x)) for d, t in docs for y in [shingles(t, 5)] for i, x in sets if len(x & y) >= 0.8 * len(x) - 1e-9}
    assert {(r.doc_id, r.item_id, r.shared, r.item_shingles) for r in op6_decontamination(spark, sf).collect()} == want and want


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("d", "a b c d e f g")], "doc_id string, text string")
    items = spark.createDataFrame([("i", "b c d e f")], "item_id string, text string")
    assert [tuple(r) for r in find_contamination(docs, items).collect()] == [("d", "i", 1, 1)]


def test_rows_are_judged_by_their_own_text(spark):
    """Repeated ids with different texts, rows without an id, equal rows."""
    rng = random.Random(6)
    item, clean = sentence(rng, 40), sentence(rng, 60)
    bad = f"{clean} {item} {clean}"
    rows = [(1, bad), (1, clean), (None, bad), (None, clean), (2, bad), (2, bad), (3, clean), (3, clean), (4, None), (None, None)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, row int")
    left = decontaminate(docs, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert sorted(r.row for r in left.collect()) == [i for i, r in enumerate(rows) if r[1] != bad] and left.columns == docs.columns
