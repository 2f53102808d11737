"""Organisation names: tidying, and telling specific names from defined terms.

A word is a link, a legal form, marked, or an excluded term; the rules are stated
over these kinds. The helpers see distinct candidate strings only; ``settle_organisations`` runs
them once for each string and joins the answer back to the spans.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.functions.text import DETERMINERS
from redactory.operators.lexicon import Lexicon
from redactory.plans.rules import DOTTED_FORMS, JURISDICTION, JURISDICTION_TAIL, ORG_FORM_ANYWHERE, ORG_FORM_WORDS, SENTENCE_END

MAX_ORG_CHARS = 60
# fixed values
WORD_EDGES = ".,;:()[]{}\"'“”‘’"
LEAD_IN = regex.compile(r"\s*(?:,?\s*)?(?:and|or|by|between|with|from|to)\s+", regex.IGNORECASE)
LINKS = frozenset({"and", "or", "of", "the", "for", "a", "an", "de", "la"})
GENERIC_LINKS = frozenset(DETERMINERS) | {"and", "of", "for", "de", "la", "if"}
SEPARATORS = ",;:/–—"
_FORM = regex.compile(ORG_FORM_ANYWHERE)
_TAIL = regex.compile(JURISDICTION_TAIL)
_PLACE = regex.compile(JURISDICTION)
_BREAK = regex.compile(SENTENCE_END)
_DOTTED = regex.compile(DOTTED_FORMS)
_PLAIN_WORD = regex.compile(r"[A-Za-z0-9.']+")
_ANY_WORD = regex.compile(r"[A-Za-z0-9&.'-]+")
_MARK = regex.compile(r"\d|-|&")


def has_form(text: str) -> bool:
    return bool(_FORM.search(text or ""))


def _marked(word: str) -> bool:
    """A digit, hyphen or ampersand, or an acronym of two characters or more."""
    return bool(_MARK.search(word)) or (word.isupper() and sum(c.isascii() and c.isalnum() for c in word) > 1)


def _nested(text: str, stop: int) -> list[tuple[int, str, int]]:
    """(place, character, brackets open around it) from the right of ``text[:stop]``."""
    out, depth = [], 0
    for i in range(stop - 1, -1, -1):
        inner = text[i] == ")"
        out.append((i, text[i], depth))
        depth = max(0, depth + inner - (text[i] == "("))
    return out


class OrgCleaner:
    """E2, E3, E4, F7 and F8 under one list of excluded terms.

    A name is a range of the string it was found in; tidying only moves the two
    ends of the range towards each other, so offsets need no second search."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def noise(self, segment: str) -> bool:
        """Nothing but excluded phrases or words of legal forms."""
        words = {w.strip(WORD_EDGES).lower() for w in _PLAIN_WORD.findall(segment)} - {""}
        return words <= ORG_FORM_WORDS or self.lexicon.combination(segment) or self.lexicon.excluded(segment)

    def _tells(self, word: str) -> bool:
        """Whether a word can make a name distinct: no link, no legal form, and
        either marked or not an excluded term."""
        plain = word.lower().replace(".", "")
        return bool(word) and plain not in LINKS | ORG_FORM_WORDS and (_marked(word) or not self.lexicon.excluded(word))

    def _after_front(self, text: str, lo: int) -> int:
        """``lo`` moved over a noise segment before a comma, then over a lead-in."""
        comma = text.find(",", lo)
        if comma >= 0 and self.noise(text[lo:comma]) and any(self._tells(w.strip(WORD_EDGES)) for w in _ANY_WORD.findall(text, comma + 1)):
            lo = comma + 1
        lead = LEAD_IN.match(text, lo)
        lo = lead.end() if lead else lo
        return lo + len(text[lo:]) - len(text[lo:].lstrip())

    def _before_back(self, text: str, lo: int, hi: int) -> int:
        """``hi`` moved over a noise segment behind a name with a legal form, then
        over a noise parenthesis."""
        cut = max(text.rfind(c, lo, hi) for c in ",;:")
        if cut > lo and text[cut + 1 : hi].strip() and has_form(text[lo:cut]) and self.noise(text[cut + 1 : hi]):
            hi = cut
        hi = lo + len(text[lo:hi].rstrip())
        opening = text.rfind("(", lo, hi)
        if opening >= 0 and text[hi - 1] == ")" and self.noise(text[opening + 1 : hi - 1].strip()):
            hi = lo + len(text[lo:opening].rstrip())
        return hi

    def bounds(self, text: str, lo: int = 0, hi: int | None = None) -> tuple[int, int]:
        """The range of the name inside ``text[lo:hi]``; empty if none is left."""
        hi = lo + len(text[lo:hi].rstrip())
        lo = hi - len(text[lo:hi].lstrip())
        text = text[:hi]
        while (front := self._after_front(text, lo)) != lo:
            lo = front
        while lo < hi and (back := self._before_back(text, lo, hi)) != hi:
            hi = back
        hi = lo + len(text[lo:hi].rstrip(" ,;:"))
        return hi - len(text[lo:hi].lstrip(" ,;:")), hi

    def clean(self, text: str) -> str:
        lo, hi = self.bounds(text)
        return text[lo:hi]

    @staticmethod
    def without_jurisdiction(text: str) -> str:
        """No ", a Delaware limited liability company" at the end."""
        found = _TAIL.search(text)
        return text[: found.start()].rstrip(" ,;") if found else text

    def _ordinary(self, word: str, formed: bool) -> bool:
        """A word that any defined term may have; beside a legal form a marked
        word is not one, unless it is a link or a form itself."""
        bare = word.strip(WORD_EDGES)
        low = bare.lower()
        if low.rstrip(",") in GENERIC_LINKS or word.lower().rstrip(",") in GENERIC_LINKS:
            return True
        return not (formed and low not in ORG_FORM_WORDS and bare and (_marked(bare) or not self.lexicon.known(bare))) and self.lexicon.known(word)

    def generic(self, text: str) -> bool:
        """F8: a defined term such as "the Company", not a name."""
        text = self.clean(text)
        name = text.split()[:-1]
        if not name:
            return False
        formed = has_form(text)
        return bool(_PLACE.search(" ".join(name))) or all(self._ordinary(w, formed) for w in name)

    def specific(self, text: str) -> bool:
        text = self.clean(text)
        return bool(text) and has_form(text) and not self.lexicon.excluded(text) and not self.generic(text)

    @staticmethod
    def crosses_sentence(text: str) -> bool:
        """F7"""
        return bool(_BREAK.search(_DOTTED.sub("", text)))

    def settle_scanned(self, text: str) -> tuple[int, str] | None:
        """What a raw scan match becomes: (offset in it, name), or None."""
        lo, hi = self.bounds(text)
        lo, hi = self.bounds(text, lo, lo + len(self.without_jurisdiction(text[lo:hi])))
        name, defined = text[lo:hi], lambda x: self.generic(x) or self.lexicon.excluded(x)
        if not name or len(name) > MAX_ORG_CHARS or self.crosses_sentence(name) or defined(name):
            return None
        # excluded segments in front of the last one go
        starts = [lo, *(lo + m.end() for m in regex.finditer(r",\s*", name))]
        first = next((i for i, (a, b) in enumerate(zip(starts, starts[1:], strict=False)) if not self._dropped(text[a:b])), len(starts) - 1)
        if first:
            lo, name = starts[first], text[starts[first] : hi]
            if defined(name):
                return None
        return lo, name

    def _dropped(self, segment: str) -> bool:
        term = segment.rstrip().rstrip(",").strip()
        return bool(term) and self.lexicon.excluded(term)

    def drop_tail(self, text: str) -> str:
        """Cut trailing parentheses and segments that are excluded combinations."""
        hi = len(text.rstrip())
        while hi and (cut := self._tail(text, hi)) is not None:
            hi = len(text[:cut].rstrip())
        return text[:hi]

    def _tail(self, text: str, hi: int) -> int | None:
        """Where the excluded tail of ``text[:hi]`` begins, if it has one."""
        around = _nested(text, hi)
        if text[hi - 1] == ")":
            opening = next((i for i, c, depth in around if c == "(" and depth == 1), None)
            if opening is not None and (not (inner := text[opening + 1 : hi - 1].strip()) or self.lexicon.combination(inner)):
                return opening
        spaced = lambda i: text[i] == "-" and text[i - 1 : i].isspace() and text[i + 1 : i + 2].isspace()
        cut = next((i for i, c, depth in around if depth == 0 and (c in SEPARATORS or spaced(i))), None)
        tail = text[cut + 1 : hi].strip() if cut is not None else ""
        return cut if tail and self.lexicon.combination(tail) else None


def per_string(spans: DataFrame, lexicon: Lexicon, schema: str, answer: Callable[[OrgCleaner, str], tuple]) -> DataFrame:
    """(text, ...): ``answer`` for every distinct text of ``spans``."""

    def run(batches):
        cleaner = OrgCleaner(lexicon)
        for batch in batches:
            yield pd.DataFrame([(t, *answer(cleaner, t)) for t in batch["text"]], columns=["text", *(x.split()[0] for x in schema.split(","))])

    return spans.select("text").where("text is not null").distinct().mapInPandas(run, f"text string, {schema}")


def settle_organisations(orgs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Raw ORG matches to names: cleaned, moved, or dropped."""

    def answer(cleaner, text):
        found = cleaner.settle_scanned(text)
        return (None, None) if found is None else found

    fixed = per_string(orgs, lexicon, "shift int, name string", answer).where("name is not null")
    moved = orgs.join(fixed, "text").withColumn("start", F.col("start") + F.col("shift"))
    moved = moved.withColumn("end", F.col("start") + F.length("name")).withColumn("text", F.col("name"))
    return moved.select(*orgs.columns)


def trim_excluded_tails(spans: DataFrame, lexicon: Lexicon) -> DataFrame:
    """E4 on ORG spans; a span of which nothing is left keeps its text."""
    orgs = spans.where("label = 'ORG'")
    fixed = per_string(orgs, lexicon, "name string", lambda cleaner, text: (cleaner.drop_tail(text),))
    cut = orgs.join(fixed, "text").withColumn("text", F.when(F.col("name") != "", F.col("name")).otherwise(F.col("text")))
    cut = cut.withColumn("end", F.col("start") + F.length("text")).select(*spans.columns)
    return spans.where("label is distinct from 'ORG'").unionByName(cut)


def drop_excluded_combinations(spans: DataFrame, lexicon: Lexicon) -> tuple[DataFrame, DataFrame]:
    """(kept spans, suppressed spans) among ORG, NAME and LOC."""
    named = spans.where(F.col("label").isin("ORG", "NAME", "LOC"))
    judged = per_string(named, lexicon, "combo boolean, specific boolean", lambda cleaner, text: (cleaner.lexicon.combination(text), cleaner.specific(text)))
    joined = spans.join(judged, "text", "left")
    bad = F.col("label").isin("ORG", "NAME", "LOC") & F.coalesce("combo", F.lit(False)) & ~((F.col("label") == "ORG") & F.coalesce("specific", F.lit(False)))
    suppressed = joined.where(bad).select("doc_id", F.lit("excluded_combo").alias("reason"), "label", "text", "start", "end", "confidence", "source")
    return joined.where(~F.coalesce(bad, F.lit(False))).select(*spans.columns), suppressed


def classify_organisations(texts: DataFrame, lexicon: Lexicon) -> DataFrame:
    """F8: (text, cleaned, generic, specific) for distinct texts."""
    return per_string(texts, lexicon, "cleaned string, generic boolean, specific boolean", lambda c, t: (c.clean(t), c.generic(t), c.specific(t)))


def split_clean(phrases: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(text, cleaned) for distinct phrases; null where every segment goes."""
    return per_string(phrases, lexicon, "cleaned string", lambda c, t: (c.lexicon.split_clean(t),))
