"""Overlap resolution: islands of spans, duplicates of chunks, greedy removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redactory.functions.let import fold_last
from redactory.functions.text import label_rank
from redactory.schemas import SPAN, SPANS


def _last(out: Column) -> Column:
    return F.get(out, F.size(out) - 1)


def _replace_last(out: Column, item: Column) -> Column:
    return F.concat(F.slice(out, 1, F.size(out) - 1), F.array(item))


def merge_spans(spans: Column, text: Column) -> Column:
    """W1 on one document: a fold over spans sorted by start, rank, length and
    confidence. Overlapping spans (touching ones do not overlap) become their
    union; the union is named by a span of higher rank, else of higher confidence,
    else longer than the union so far. Empty, unlabelled and inverted spans go."""
    from redactory.operators.scan import between

    valid = F.filter(spans, lambda s: (s["start"] < s["end"]) & s["label"].isNotNull() & (s["label"] != ""))
    keyed = F.transform(
        valid,
        lambda s: F.struct(s["start"].alias("a"), (-label_rank(s["label"])).alias("b"), (s["start"] - s["end"]).alias("c"), (-F.coalesce(s["confidence"], F.lit(0.0))).alias("d"), s["source"].alias("e"), s["text"].alias("f"), s["label"].alias("g"), s.alias("span")),
    )
    ordered = F.transform(F.sort_array(keyed), lambda k: k["span"])

    def step(out, s):
        last = _last(out)
        rank, best = label_rank(s["label"]), label_rank(last["label"])
        sure, held = F.coalesce(s["confidence"], F.lit(0.0)), F.coalesce(last["confidence"], F.lit(0.0))
        longer = (s["end"] - s["start"]) > (last["end"] - last["start"])
        better = (rank > best) | ((rank == best) & ((sure > held) | ((sure == held) & longer)))
        pick = lambda c: F.when(better, s[c]).otherwise(last[c]).alias(c)
        union = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), pick("label"), last["text"].alias("text"), pick("confidence"), pick("source"))
        return F.when((F.size(out) > 0) & (s["start"] < last["end"]), _replace_last(out, union)).otherwise(F.concat(out, F.array(s)))

    merged = fold_last(ordered, SPAN, step)
    return F.transform(merged, lambda s: s.withField("text", between(text, s["start"], s["end"])))


def merge_overlaps(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """W1 on the long form."""
    packed = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "label", "text", "confidence", "source")).cast(SPANS).alias("spans"))
    return packed.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", F.inline(merge_spans(F.col("spans"), F.col("text"))))


def islands(spans: DataFrame, *by: str) -> DataFrame:
    """``spans`` with ``island``: the running number of its overlap group within
    ``by``, from the furthest end before each span."""
    before = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True)).cast("int")
    return spans.withColumn("_fresh", fresh).withColumn("island", F.sum("_fresh").over(upto).cast("int")).drop("_fresh")


def island_bounds(spans: DataFrame) -> DataFrame:
    """The bounds of W1's unions: (doc_id, start, end, n_spans)."""
    valid = spans.where("start < end and label is not null and label != ''")
    return islands(valid, "doc_id").groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_spans")).drop("island")


def dedupe_chunk_overlaps(entities: DataFrame) -> DataFrame:
    """Of overlapping entities of one label, the best original: to be redacted,
    longest, surest, first."""
    kept = F.max_by(F.struct(*entities.columns), F.struct(F.coalesce(F.col("needs_redaction"), F.lit(True)), F.col("end") - F.col("start"), F.coalesce(F.col("confidence"), F.lit(0.0)), -F.col("start"), -F.col("end")))
    return islands(entities, "doc_id", "label").groupBy("doc_id", "label", "island").agg(kept.alias("kept")).select("kept.*")


def remove_overlaps_greedy(spans: Column) -> Column:
    """In (start, -length) order a span that overlaps the last kept one
    replaces it if it is surer or longer, else goes."""
    keyed = F.transform(spans, lambda s, i: F.struct(s["start"].alias("a"), (s["start"] - s["end"]).alias("b"), i.alias("i"), s.alias("span")))
    ordered = F.transform(F.sort_array(keyed), lambda k: k["span"])

    def step(out, s):
        last = _last(out)
        clash = (F.size(out) > 0) & (s["start"] < last["end"]) & (s["end"] > last["start"])
        better = (s["confidence"] > last["confidence"]) | ((s["end"] - s["start"]) > (last["end"] - last["start"]))
        return F.when(~clash, F.concat(out, F.array(s))).when(better, _replace_last(out, s)).otherwise(out)

    return fold_last(ordered, SPAN, step)
