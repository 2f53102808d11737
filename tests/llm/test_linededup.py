import random

from pyspark.sql import functions as F

from redactory.llm.linededup import chunk_column, dedup_lines
from tests.llm.common import edge_rows, sentence


def test_chunks_give_the_text_back(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(sentence(rng, rng.randrange(0, 70)) for _ in range(rng.randrange(1, 15)))) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = df.select("text", F.array_join(F.transform(chunk_column(F.col("text")), lambda c: c["body"]), "\n").alias("back"))
    assert whole.where("text != back").count() == 0


def test_repeated_passages_go_but_for_the_first(spark):
    rng = random.Random(3)
    passage = "\n".join(sentence(rng, 20) for _ in range(12))
    single = sentence(rng, 60)
    own = {i: [sentence(rng, 18) for _ in range(6)] for i in range(8)}
    rows = [(i, "\n".join([*own[i][:3], passage, single, *own[i][3:]])) for i in range(8)]
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].text == rows[0][1] and got[0].n_removed == 0
    for i in range(1, 8):
        kept = got[i].text.split("\n")
        assert set(own[i]) <= set(kept) and single not in kept
        assert sum(line in kept for line in passage.split("\n")) <= 5
    alone = spark.createDataFrame([(1, "\n".join(own[1])), (2, "\n".join(own[2]))], "doc_id long, text string")
    assert dedup_lines(alone).where("n_removed > 0").count() == 0


def test_edges(spark):
    rows = [(*r, 1) for r in edge_rows()] + [(20, "a\nb\nc\n\nd", 8), (21, "a\nb\nc\n\nd", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = dedup_lines(df)
    by = {r.doc_id: r for r in out.collect()}
    assert out.count() == len(rows) and by[1].text is None and by[2].text == "" and by[20].text == "a\nb\nc\n\nd"
    assert by[21].n_chars == len(by[21].text) and by[None].text == "no id here"
    assert dedup_lines(df.limit(0)).count() == 0
    assert "MapInArrow" not in out._jdf.queryExecution().toString() and "Python" not in out._jdf.queryExecution().toString()


def test_short_passages_go_whole(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for kind, (n, size, blank) in enumerate([(2, 30, False), (2, 40, False), (3, 20, False), (4, 15, False), (6, 12, False), (2, 30, True), (4, 15, True)]):
        for k in range(40):
            passage = ("\n\n" if blank else "\n").join(sentence(rng, size, 5000) for _ in range(n))
            at = 1000 * kind + 2 * k
            for i in (at, at + 1):
                own = [sentence(rng, 14, 5000) for _ in range(4)]
                rows.append((i, "\n".join([*own[:2], passage, *own[2:]])))
                want[i] = rows[-1][1] if i == at else "\n".join(own)
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in want if got[i] != want[i]] == []


def test_lines_common_alone_are_no_passage(spark):
    rng = random.Random(5)
    rows = []
    for i in range(0, 120, 3):
        one, two, *own = (sentence(rng, 9, 5000) for _ in range(14))
        rows += [(i, "\n".join([*own[:2], one, *own[2:4]])), (i + 1, "\n".join([*own[4:6], two, *own[6:8]])), (i + 2, "\n".join([*own[8:10], one, two, *own[10:12]]))]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").count()
    assert got == 0


def law(rows):
    """What is left of each text: a line of 50 words, or two neighbouring lines with
    words, that stand at an earlier place go, with the wordless lines between."""
    seen, left = set(), {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        with_words = [k for k, x in enumerate(lines) if x.strip()]
        gone = set()
        for k, n in zip(with_words, [*with_words[1:], None]):
            keys = [((lines[k],), k)] if len(lines[k].split()) >= 50 else []
            keys += [((lines[k], lines[n]), n)] if n is not None else []
            for key, end in keys:
                gone |= set(range(k, end + 1)) if key in seen else set()
                seen.add(key)
        left[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return left


def test_brute_force_with_a_line_and_a_passage_in_most_documents(spark):
    rng = random.Random(6)
    pool = [sentence(rng, rng.choice([3, 8, 20, 55]), 5000) for _ in range(60)] + ["", " "]
    hot, passage = sentence(rng, 12, 5000), [sentence(rng, 7, 5000) for _ in range(3)]
    rows = []
    for i in range(400):
        lines = [rng.choice(pool) if rng.random() < 0.4 else sentence(rng, 9, 5000) for _ in range(rng.randrange(1, 9))]
        for _ in range(rng.randrange(0, 3)):
            lines.insert(rng.randrange(0, len(lines) + 1), hot)
        if i % 3 == 0:
            at = rng.randrange(0, len(lines) + 1)
            lines[at:at] = passage
        rows.append((i, "\n".join(lines)))
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = law(rows)
    assert [i for i in want if got[i] != want[i]] == []
