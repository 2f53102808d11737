"""Line dedup over content-defined chunks, in DataFrame functions only.

Lines are hashed; a rolling hash over ``window`` neighbouring line hashes decides
where the text is cut: after a line in ``cuts_in_four`` of four cases. By default
every line is a chunk, so that no cut depends on what stands around a passage:
chunks of several lines leave most short passages whole (figures in the README).
A line of ``long_words`` words or more always gets a cut on both sides.
Chunks that occur more than once in the table are compared byte by byte with
their first place (smallest doc_id, then text hash and position). A passage is
two neighbouring chunks, or one of two lines or ``long_words`` words; lines
without words between neighbours do not part them. A passage that stands at an
earlier place is removed, with the wordless lines inside it; a longer one
is made up of such pairs and goes whole. The first place of each line stays.

Nulls, ties, repeats: a null text or id takes no part and passes unchanged; a
text whose chunks all go becomes empty. Rows equal in id and text are one
document and get the same result; of equal places the smallest id, text hash and
position is the first. A very long text is one array of lines in its task. An empty
table stays empty. Columns other than ``text`` pass through (``n_removed`` is
replaced, ``_dedup_*`` are the operator's own); ``n_chars``, if there, follows the
new text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactory.llm.common import each_salt, materialise, salt, salts


def chunk_column(text, cuts_in_four: int = 4, window: int = 1, long_words: int = 50):
    """array<struct(hash, body, lines, words)>: the chunks of a text in order;
    joined by newlines the bodies give the text back."""
    lines = F.split(text, "\n")
    words = lambda x: F.when(F.trim(x) == "", 0).otherwise(F.size(F.split(F.trim(x), "[ \\t]+")))
    facts = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), words(x).alias("n")))

    def cut_after(facts):
        def one(fact, i):
            back = [F.when(i >= k, F.get(facts, i - k)["h"]).otherwise(F.lit(0)) for k in range(1, window)]
            rolled = F.pmod(F.xxhash64(fact["h"], *back), F.lit(4)) < cuts_in_four
            ahead = F.coalesce(F.get(facts, i + 1)["n"] >= long_words, F.lit(True))
            return F.when(rolled | (fact["n"] >= long_words) | ahead, i + 1)

        return F.filter(F.transform(facts, one), lambda x: x.isNotNull())

    def build(lines, facts, cuts):
        def one(end, k):
            start = F.when(k == 0, F.lit(0)).otherwise(F.get(cuts, k - 1))
            part = F.slice(lines, start + 1, end - start)
            body = F.array_join(part, "\n")
            n = F.aggregate(F.slice(facts, start + 1, end - start), F.lit(0), lambda a, f: a + f["n"])
            return F.struct(F.xxhash64(body, F.lit(0)).alias("hash"), body.alias("body"), (end - start).alias("lines"), n.alias("words"))

        return F.transform(cuts, one)

    # let-bindings by one-element arrays: each part is computed once for a row
    whole = F.transform(F.array(F.struct(lines.alias("lines"), facts.alias("facts"))), lambda x: F.struct(x["lines"].alias("lines"), x["facts"].alias("facts"), cut_after(x["facts"]).alias("cuts")))
    return F.element_at(F.transform(whole, lambda x: build(x["lines"], x["facts"], x["cuts"])), 1)


def repeated_chunks(docs: DataFrame, cuts_in_four: int = 4, window: int = 1, long_words: int = 50) -> DataFrame:
    """(doc_id, text_hash, place): chunks to remove, each in a passage
    byte-equal to one at an earlier place, or wordless inside such a passage."""
    parts = F.transform(chunk_column(F.col("text"), cuts_in_four, window, long_words), lambda c, i: F.struct(i.alias("place"), c["hash"].alias("hash"), c["body"].alias("body"), ((c["lines"] >= 2) | (c["words"] >= long_words)).alias("alone"), c["words"].alias("words")))
    # rank counts the chunks with words, so neighbours have ranks that differ by one
    known = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.filter(parts, lambda c: c["words"] > 0)).alias("rank", "chunk"))
    chunks = known.select(F.struct("doc_id", "text_hash", "rank").alias("at"), F.col("chunk.place").alias("place"), F.col("chunk.hash").alias("hash"), F.col("chunk.body").alias("body"), F.col("chunk.alone").alias("alone")).withColumn("salt", salt("at"))
    # first place by plain minima, which are combined before the shuffle
    owners = chunks.groupBy("hash").agg(F.min("at").alias("owner"), F.count(F.lit(1)).alias("n"), salts()).where("n > 1").select("hash", "owner", "salts", each_salt())
    rows = materialise(chunks.join(owners, ["hash", "salt"]), "repeated")
    text = rows.where("at = owner").groupBy("hash", "salts").agg(F.first("body").alias("original")).select("hash", "original", each_salt())
    same = rows.join(text, ["hash", "salt"]).where("body = original").select("at.*", "place", "hash", "alone", (F.col("at") != F.col("owner")).alias("later")).distinct()
    # a hash stands for one text from here on, so two of them for one pair of texts
    own = Window.partitionBy("doc_id", "text_hash").orderBy("rank")
    ahead = F.lead(F.struct("rank", "place", "hash")).over(own)
    marked = materialise(same.withColumn("next", ahead).withColumn("next", F.when(F.col("next.rank") == F.col("rank") + 1, F.col("next"))), "marked")
    alone = marked.where("alone and later").select("doc_id", "text_hash", "place")
    pairs = marked.where("next is not null").select(F.struct("doc_id", "text_hash", "rank").alias("at"), "place", F.col("next.place").alias("end"), "hash", F.col("next.hash").alias("next")).withColumn("salt", salt("at"))
    first = pairs.groupBy("hash", "next").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), salts()).where("n > 1").select("hash", "next", "first", each_salt())
    again = pairs.join(first, ["hash", "next", "salt"]).where("at != first").select("at.doc_id", "at.text_hash", F.explode(F.sequence("place", "end")).alias("place"))
    return alone.union(again).distinct()


def dedup_lines(docs: DataFrame, cuts_in_four: int = 4, window: int = 1, long_words: int = 50) -> DataFrame:
    """``docs`` with repeated chunks removed, plus ``n_removed`` int."""
    how = (cuts_in_four, window, long_words)
    gone = repeated_chunks(docs, *how).groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list("place")).alias("_dedup_places"))
    joined = docs.withColumn("_dedup_h", F.xxhash64("text")).join(gone.select(F.col("doc_id").alias("_dedup_d"), F.col("text_hash").alias("_dedup_t"), "_dedup_places"), (F.col("doc_id") == F.col("_dedup_d")) & (F.col("_dedup_h") == F.col("_dedup_t")), "left")

    def keep(chunks, places):
        # places are sorted: cut the chunk list at each and glue what is between
        ends = F.concat(places, F.array(F.size(chunks)))
        runs = F.transform(ends, lambda end, k: F.slice(chunks, F.when(k == 0, F.lit(0)).otherwise(F.get(places, k - 1) + 1) + 1, end - F.when(k == 0, F.lit(0)).otherwise(F.get(places, k - 1) + 1)))
        return F.array_join(F.transform(F.flatten(runs), lambda x: x["body"]), "\n")

    chunks = chunk_column(F.col("text"), *how)
    text = F.when(F.col("_dedup_places").isNull(), F.col("text")).otherwise(F.element_at(F.transform(F.array(chunks), lambda c: keep(c, F.col("_dedup_places"))), 1))
    out = joined.withColumns({"text": text, "n_removed": F.coalesce(F.size("_dedup_places"), F.lit(0))})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(c for c in docs.columns if c != "n_removed"), "n_removed")
