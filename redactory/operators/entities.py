"""Entity identity within a document: numbering and greedy clustering."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterable

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redactory.functions.text import AGREEMENT_BONUS, LEGAL_SUFFIXES

CLUSTERED = ("NAME", "ORG", "BRAND")
LINK_AT = 0.82


def number_entities(spans: DataFrame) -> DataFrame:
    """``LABEL_k`` by first appearance of the trimmed text in the document."""
    first = F.min("start").over(Window.partitionBy("doc_id", "label", F.trim("text")))
    rank = F.dense_rank().over(Window.partitionBy("doc_id", "label").orderBy("_first", F.trim("text")))
    return spans.withColumn("_first", first).withColumn("entity_id", F.concat_ws("_", "label", rank.cast("string"))).drop("_first")


def cluster_form(text: str) -> str:
    """X6 for one string."""
    text = text.lower().replace("&", "and")
    for suffix in LEGAL_SUFFIXES:
        text = text.removesuffix(" " + suffix)
    return regex.sub(" {2,}", " ", "".join(c for c in text if c.isalnum() or c.isspace()).strip())


def indel_ratio(a: str, b: str) -> float:
    """1 - (insertions + deletions) / total length: twice the longest common
    subsequence over the total length, by bit-parallel rows."""
    if not a and not b:
        return 1.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """The best indel ratio among the common tokens, and those with each side's rest."""
    one, two = set(a.split()), set(b.split())
    if not one or not two:
        return 0.0
    common = " ".join(sorted(one & two))
    if common and (one <= two or two <= one):
        return 1.0
    left, right = (" ".join(filter(None, (common, " ".join(sorted(x))))) for x in (one - two, two - one))
    best = indel_ratio(left, right)
    return max(best, indel_ratio(common, left), indel_ratio(common, right)) if common else best


#: Columns of letter counts; letters that share one only loosen the bound.
COUNTS = 32


class Clusters:
    """The clusters of one label, each a set of aliases, with indexes over all aliases.

    Only aliases that can reach LINK_AT are compared: those that share a token, by an
    inverted index, and those whose letters and length are near enough, by counts of
    letters in blocks of equal length. A form that comes again is compared with the
    aliases added since; so the work follows what is new."""

    def __init__(self) -> None:
        self.n = 0
        self.forms: list[str] = []  # one entry for each alias of a cluster
        self.of: list[int] = []
        self.by_token: dict[str, list[int]] = {}
        self.by_length: dict[int, tuple[np.ndarray, list[int]]] = {}
        self.aliases: set[tuple[str, int]] = set()
        self.known: dict[str, tuple[float, int, int]] = {}  # form -> best score, its cluster, entries seen

    @staticmethod
    def bag(form: str) -> tuple[int, np.ndarray]:
        """Length and letter counts of the form's distinct tokens, joined by blanks."""
        text = " ".join(set(form.split()))
        return len(text), np.bincount([ord(c) % COUNTS for c in text], minlength=COUNTS).astype(np.int32)

    def near(self, form: str, seen: int) -> set[int]:
        """Entries from ``seen`` on that may reach LINK_AT."""
        found: set[int] = set()
        for token in set(form.split()):
            entries = self.by_token.get(token, [])
            found.update(entries[bisect_left(entries, seen) :])
        n, counts = self.bag(form)
        for length in range(math.floor(n * LINK_AT / (2 - LINK_AT)), math.ceil(n * (2 - LINK_AT) / LINK_AT) + 1):
            if length in self.by_length:
                table, entries = self.by_length[length]
                first = bisect_left(entries, seen)
                if first < len(entries):
                    common = np.minimum(table[first : len(entries)], counts).sum(axis=1)
                    found.update(entries[first + int(i)] for i in np.flatnonzero(2 * common >= LINK_AT * (n + length) - 1e-6))
        return found

    def add(self, form: str, cluster: int) -> None:
        entry = len(self.forms)
        self.forms.append(form)
        self.of.append(cluster)
        for token in set(form.split()):
            self.by_token.setdefault(token, []).append(entry)
        if form:
            length, counts = self.bag(form)
            table, entries = self.by_length.setdefault(length, (np.zeros((4, COUNTS), np.int32), []))
            if len(entries) == len(table):
                table = np.concatenate([table, np.zeros_like(table)])
                self.by_length[length] = table, entries
            table[len(entries)] = counts
            entries.append(entry)

    def link(self, form: str) -> tuple[int, bool]:
        """(cluster, joined): the first cluster of the highest score, or a new one."""
        score, best, seen = self.known.get(form, (0.0, -1, 0))
        for entry in self.near(form, seen):
            near = 1.0 if form == self.forms[entry] else token_set_ratio(form, self.forms[entry])
            if near > score or (near == score and near > 0 and self.of[entry] < best):
                score, best = near, self.of[entry]
        seen, joined = len(self.forms), best >= 0 and score >= LINK_AT
        if not joined:
            self.n, best = self.n + 1, self.n
        if (form, best) not in self.aliases:
            self.aliases.add((form, best))
            self.add(form, best)
            seen = len(self.forms) - 1
        self.known[form] = (score, best, seen) if joined else (0.0, -1, seen)
        return best, joined


def cluster_mentions(labels: Iterable[str], texts: Iterable[str]) -> list[tuple[str, bool]]:
    """(entity id, joined an open cluster) for one document's mentions in order.

    A mention joins the cluster with the most similar alias if that reaches
    LINK_AT, and becomes an alias of it; else it opens a cluster of its own."""
    clusters: dict[str, Clusters] = {}
    out = []
    for label, text in zip(labels, texts, strict=True):
        at, joined = clusters.setdefault(label, Clusters()).link(cluster_form(text.strip()))
        out.append((f"{label}_{at + 1}", joined))
    return out


def cluster_entities(spans: DataFrame) -> DataFrame:
    """W4 on the long form: entity ids of NAME, ORG and BRAND; a mention that joins
    a cluster gains confidence. The mentions of one document's one label are one row,
    and many such rows reach the helper at once."""
    named = spans.where(F.col("label").isin(*CLUSTERED)).drop("entity_id")
    mention = F.struct("start", "end", "text", F.struct(*(F.col(c) for c in named.columns)).alias("row"))
    packed = named.groupBy("doc_id", "label").agg(F.sort_array(F.collect_list(mention)).alias("mentions"))

    @F.pandas_udf("array<struct<entity_id:string,joined:boolean>>")
    def identities(labels: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([[{"entity_id": i, "joined": joined} for i, joined in cluster_mentions([label] * len(ts), ts)] for label, ts in zip(labels, texts, strict=True)], dtype=object)

    made = packed.withColumn("made", identities("label", F.col("mentions.text"))).select(F.inline(F.arrays_zip(F.col("mentions.row").alias("row"), F.col("made").alias("made"))))
    gain = F.when(F.col("made.joined"), AGREEMENT_BONUS).otherwise(0.0)
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("row.confidence", F.lit(0.7)) + gain))
    fields = (sure.cast(named.schema["confidence"].dataType).alias(c) if c == "confidence" else F.col(f"row.`{c}`") for c in named.columns)
    return made.select(*fields, F.col("made.entity_id").alias("entity_id"))


def identify_entities(spans: DataFrame) -> DataFrame:
    """W3 and W4 together."""
    rest = number_entities(spans.drop("entity_id").where(~F.col("label").isin(*CLUSTERED)))
    named = cluster_entities(spans.drop("entity_id"))
    return rest.unionByName(named)
