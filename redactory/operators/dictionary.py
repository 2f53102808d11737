"""Terms found in texts by one automaton: linear in text, terms and matches.

An Aho-Corasick automaton of all terms, folded for case character by character, goes
over the folded text once. What it finds is sorted out by term: exact at word
boundaries, folded at word boundaries, exact anywhere.

Terms of a document come with their document in one join. Terms for all documents are
sent to every task as long as they keep within a bound; beyond it, each term is joined
by its rarest run of three characters to the documents that hold that run, so no
document meets a term it cannot hold and no step compares all with all.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms for all documents beyond this number or these characters are joined.
SENT_TERMS, SENT_CHARS = 200_000, 8_000_000
RUN = 3
PLAIN = regex.compile(r"[A-Za-z0-9][A-Za-z0-9 '&.,\-]*[A-Za-z0-9]")
TOKEN = regex.compile("[A-Za-z0-9]+")
_WORD_KINDS = {"Lu", "Ll", "Lt", "Lm", "Lo", "Nl", "Nd", "Mn", "Mc", "Me", "Pc"}


@lru_cache(maxsize=1 << 16)
def is_word(c: str) -> bool:
    return unicodedata.category(c) in _WORD_KINDS or c in "‌‍"


@lru_cache(maxsize=1 << 16)
def _folded(c: str) -> str:
    up = c.upper()
    up = up if len(up) == 1 else c
    low = up.lower()
    return low if len(low) == 1 else low[0] if up == "İ" else up


def fold(text: str) -> str:
    """Case folded, with as many characters as before."""
    return text.lower() if text.isascii() else "".join(map(_folded, text))


def is_loose(term: str, label: str, stops: frozenset[str]) -> bool:
    """Names that may also stand in other case."""
    tokens = TOKEN.findall(term)
    if label not in ("NAME", "ORG", "BRAND") or not tokens:
        return False
    return len(tokens) >= 2 or (len(tokens[0]) >= 5 and tokens[0].lower() not in stops and term.upper() == term)


class Dictionary:
    """(term, label) pairs as an automaton."""

    def __init__(self, terms: list[tuple[str, str]], stops: frozenset[str]):
        import ahocorasick

        self.terms = terms
        self.kinds = [(PLAIN.fullmatch(t) is not None, is_loose(t, label, stops)) for t, label in terms]
        by_form: dict[str, list[int]] = {}
        for i, (term, _) in enumerate(terms):
            by_form.setdefault(fold(term), []).append(i)
        self.automaton = ahocorasick.Automaton()
        for form, numbers in by_form.items():
            self.automaton.add_word(form, (len(form), numbers))
        if by_form:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, label) of every match, term by term."""
        if not self.terms or not text:
            return []
        ends: dict[int, list[int]] = {}  # where the last match of each kind ended
        found: dict[int, tuple[list, list, list]] = {}
        for last, (length, numbers) in self.automaton.iter(fold(text)):
            start, end = last + 1 - length, last + 1
            edge = None
            for i in numbers:
                term = self.terms[i][0]
                same = text.startswith(term, start)
                plain, loose = self.kinds[i]
                if not same and not (plain and loose):
                    continue
                if plain and edge is None:
                    edge = (start == 0 or is_word(text[start - 1]) != is_word(text[start])) and (end == len(text) or is_word(text[end - 1]) != is_word(text[end]))
                kinds, until = found.setdefault(i, ([], [], [])), ends.setdefault(i, [0, 0, 0])
                for k, fits in enumerate((plain and same and edge, plain and edge, same)):
                    if fits and start >= until[k]:
                        kinds[k].append((start, end))
                        until[k] = end
        out = []
        for i, (exact, folded, raw) in sorted(found.items()):
            plain, loose = self.kinds[i]
            chosen = exact if plain and exact else folded if plain and loose else raw
            out += [(s, e, self.terms[i][1]) for s, e in chosen]
        return out


Find = Callable[[pa.RecordBatch], Iterator[tuple[int, Dictionary]]]


def _spans(df: DataFrame, dictionaries: Find) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = [], batch.column("text")
            for i, d in dictionaries(batch):
                text = texts[i].as_py() or ""
                rows += [(i, s, e, label, text[s:e]) for s, e, label in d.find(text)]
            at, starts, ends, labels, found = zip(*rows, strict=True) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(labels, pa.string()), pa.array(found, pa.string())],
                names=["doc_id", "start", "end", "label", "text"],
            )

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, start int, end int, label string, text string")


def find_own_terms(docs: DataFrame, terms: DataFrame, stops: frozenset[str]) -> DataFrame:
    """Terms (doc_id, term, label) in the documents of their id."""
    listed = terms.groupBy("doc_id").agg(F.collect_list(F.struct("term", "label")).alias("terms"))
    return _own(docs.select("doc_id", "text").join(listed, "doc_id"), stops)


def _own(df: DataFrame, stops: frozenset[str]) -> DataFrame:
    def dictionaries(batch: pa.RecordBatch) -> Iterator[tuple[int, Dictionary]]:
        for i, terms in enumerate(batch.column("terms")):
            yield i, Dictionary([(t["term"], t["label"]) for t in terms.as_py()], stops)

    return _spans(df.select("doc_id", "text", "terms"), dictionaries)


def find_terms(docs: DataFrame, terms: DataFrame, stops: frozenset[str], sent_terms: int = SENT_TERMS, sent_chars: int = SENT_CHARS) -> DataFrame:
    """Terms (term, label) in all documents."""
    size = terms.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("term")).alias("chars")).first()
    if size["n"] <= sent_terms and (size["chars"] or 0) <= sent_chars:
        listed = sorted((r["term"], r["label"]) for r in terms.select("term", "label").collect())
        sent = docs.sparkSession.sparkContext.broadcast(listed)
        made: list[Dictionary] = []

        def dictionaries(batch: pa.RecordBatch) -> Iterator[tuple[int, Dictionary]]:
            if not made:
                made.append(Dictionary(sent.value, stops))
            for i in range(len(batch)):
                yield i, made[0]

        return _spans(docs.select("doc_id", "text"), dictionaries)
    return _own(candidate_terms(docs, terms), stops)


def _runs(c: Column, width: int) -> Column:
    """The distinct runs of ``width`` characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - width + 1), lambda i: F.substring(c, i, F.lit(width))))


def _loose_form(c: Column) -> Column:
    """Equal for texts that fold alike: in upper case by way of lower case, so that
    forms of one letter meet, without the dot that a dotted capital I leaves."""
    return F.replace(F.upper(F.lower(F.upper(c))), F.lit("\u0307"), F.lit(""))


def candidate_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, text, terms): for each row the terms whose rarest run of characters,
    of three or the term's own length if shorter, its text holds."""
    low = _loose_form(F.col("term"))
    keys = terms.select("term", "label", F.explode(F.when(F.length(low) >= RUN, _runs(low, RUN)).otherwise(F.array(low))).alias("run"))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    text = F.col("low")
    grams = F.flatten(F.array(*(F.when(F.length(text) >= n, _runs(text, n)).otherwise(F.array().cast("array<string>")) for n in range(1, RUN + 1))))
    held = rows.select("doc_id", "_h", _loose_form(F.col("text")).alias("low")).select("doc_id", "_h", F.explode(grams).alias("run")).join(keys.select("run").distinct(), "run", "left_semi").distinct()
    often = held.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    # a run that no text holds is the rarest: its term is nowhere
    rarest = keys.join(often, "run", "left").groupBy("term", "label").agg(F.min_by("run", F.struct(F.coalesce("n", F.lit(0)), "run")).alias("run"))
    pairs = held.join(rarest, "run").groupBy("doc_id", "_h").agg(F.collect_set(F.struct("term", "label")).alias("terms"))
    named = pairs.select(F.col("doc_id").alias("_d"), F.col("_h").alias("_t"), "terms")
    return rows.join(named, rows["doc_id"].eqNullSafe(named["_d"]) & (rows["_h"] == named["_t"])).select("doc_id", "text", "terms")
