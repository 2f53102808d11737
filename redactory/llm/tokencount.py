"""Edit-aware token counts over a segment tree of pre-tokens per document.

A byte-level BPE never merges across pre-tokens, so a text's token count is the
sum over its pre-tokens. Each document keeps a segment tree whose leaves hold a
run of pre-tokens and whose nodes hold the sums of characters and tokens below.
An edit descends the tree by characters to the pre-tokens it touches, backs up by
two (a pre-token and its white-space look-ahead may change), splits from there
until a new boundary falls on an old one behind the edit, re-encodes only those
pre-tokens, and adds the differences on the paths to the root. The pattern looks
only ahead, so from a common boundary on both splits agree.

Nulls, ties, repeats: a null text counts as empty. Edits are (start, stop,
replacement) in code points of the original text; they are clamped to it, sorted
by (start, stop), and one that overlaps its predecessor is left out and not
counted in ``n_edits``. A null replacement deletes. Rows are counted one by one;
columns named like an output are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm.common import Memo, Splitter

LEAF = 128
CACHE_WORDS = 200_000
# fixed value: the pre-token pattern of the vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
EDITS = "array<struct<start:int,stop:int,replacement:string>>"


class Counter:
    """Pre-tokens and their token counts under one ranks file."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = Splitter(pattern)
        self.count = Memo(lambda piece: len(self.encoding.encode_ordinary(piece)), CACHE_WORDS).__getitem__


class TokenTree:
    """A segment tree over leaves of pre-tokens; node i has children 2i, 2i + 1."""

    def __init__(self, text: str, counter: Counter):
        self.counter, self.reencoded = counter, 0
        pieces = counter.pattern.findall(text)
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.width = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        end = self.width + len(self.leaves)
        self.chars[self.width : end] = [sum(map(len, leaf)) for leaf in self.leaves]
        self.tokens[self.width : end] = [sum(map(counter.count, leaf)) for leaf in self.leaves]
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _find(self, at: int) -> tuple[int, int, int]:
        """(leaf, pre-token in it, its first character) of the one holding ``at``."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        leaf = node - self.width
        for k, piece in enumerate(self.leaves[leaf] if leaf < len(self.leaves) else []):
            if at < start + len(piece):
                return leaf, k, start
            start += len(piece)
        return leaf, len(self.leaves[leaf]), start

    def _back(self, leaf: int, k: int, start: int) -> tuple[int, int, int]:
        """One pre-token back, over empty leaves."""
        while k == 0:
            if leaf == 0:
                return 0, 0, 0
            leaf -= 1
            k = len(self.leaves[leaf])
        return leaf, k - 1, start - len(self.leaves[leaf][k - 1])

    def edit(self, start: int, stop: int, replacement: str) -> None:
        leaf, k, at = self._find(max(0, start - 1))
        for _ in range(2):
            leaf, k, at = self._back(leaf, k, at)
        # old pre-tokens are pulled in one by one, as far as the new split needs them
        old, ends, l, j = "", [], leaf, k
        new, shift, done = [], len(replacement) - (stop - start), 0
        text = ""
        ahead = 64
        while True:
            before = len(old)
            while len(old) < stop - at + ahead and l < len(self.leaves):
                if j == len(self.leaves[l]):
                    l, j = l + 1, 0
                    continue
                old += self.leaves[l][j]
                ends.append((len(old), l, j + 1))
                j += 1
            whole = l >= len(self.leaves)
            if len(old) == before and not whole:
                ahead *= 2
                continue
            text = old[: start - at] + replacement + old[stop - at :]
            fixed = {end + shift: (x, y) for end, x, y in ends if end >= stop - at}
            new, done, met = [], 0, None
            # the last pre-token of a cut text may be cut itself, and its look-ahead unknown
            safe = len(text) if whole else len(text) - 2
            for m in self.counter.pattern.finditer(text):
                if not whole and m.end() >= safe:
                    break
                new.append(m.group())
                done = m.end()
                if done in fixed and done >= start - at + len(replacement):
                    met = fixed[done]
                    break
            if met is not None:
                break
            if whole:
                met = (len(self.leaves) - 1, len(self.leaves[-1]))
                break
            ahead *= 2
        self.reencoded += len(new)
        self._replace(leaf, k, met[0], met[1], new)

    def _replace(self, leaf: int, k: int, last: int, upto: int, new: list[str]) -> None:
        """Pre-tokens from (leaf, k) up to (last, upto) become ``new``."""
        tail = self.leaves[last][upto:]
        if leaf == last:
            self.leaves[leaf][k:upto] = new
        else:
            self.leaves[leaf][k:] = new
            for x in range(leaf + 1, last):
                self.leaves[x] = []
            self.leaves[last] = tail
        for x in range(leaf, last + 1):
            node = self.width + x
            chars, tokens = sum(map(len, self.leaves[x])), sum(map(self.counter.count, self.leaves[x]))
            dc, dt = chars - self.chars[node], tokens - self.tokens[node]
            while node and (dc or dt):
                self.chars[node] += dc
                self.tokens[node] += dt
                node //= 2

    def text(self) -> str:
        return "".join("".join(leaf) for leaf in self.leaves)


def apply_edits(tree: TokenTree, edits: list[tuple[int, int, str]], length: int) -> int:
    """Apply non-overlapping edits from the right; how many were applied."""
    kept, reach = [], 0
    for start, stop, text in sorted((max(0, min(s, length)), max(0, min(e, length)), r or "") for s, e, r in edits if s is not None and e is not None and s <= e):
        if start >= reach:
            kept.append((start, stop, text))
            reach = max(stop, start)
    for start, stop, text in reversed(kept):
        tree.edit(start, stop, text)
    return len(kept)


_loaded: dict[tuple[str, str], Counter] = {}


def load(path: str, pattern: str = PATTERN) -> Counter:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Counter(path, pattern)
    return _loaded[path, pattern]


def attach_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """``docs`` with column ``edits`` gathered from (doc_id, start, stop,
    replacement); a document without edits gets null."""
    packed = edits.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "replacement")).cast(EDITS).alias("edits"))
    return docs.drop("edits").join(packed, "doc_id", "left")


class EditPattern:
    """Edits that replace every match of an alternation. Each alternative comes
    with the characters of which a match holds at least one (none named: it may
    match anywhere); those that cannot match in a text are not tried on it."""

    def __init__(self, alternatives: list[tuple[str, str]], replacement: str = ""):
        self.alternatives, self.replacement = alternatives, replacement

    @functools.cached_property
    def compiled(self) -> Memo:
        return Memo(lambda tried: re.compile("|".join(p for (_, p), t in zip(self.alternatives, tried, strict=True) if t)), 1 << 10)

    def __getstate__(self) -> dict:
        return {"alternatives": self.alternatives, "replacement": self.replacement}

    def edits(self, text: str) -> list[tuple[int, int, str]]:
        tried = tuple(not marks or any(map(text.__contains__, marks)) for marks, _ in self.alternatives)
        return [(*m.span(), self.replacement) for m in self.compiled[tried].finditer(text)] if any(tried) else []


def count_tokens(docs: DataFrame, path: str, texts: bool = True, find: EditPattern | None = None) -> DataFrame:
    """``docs`` (with a column ``edits``, or edits as ``find`` finds them) plus
    ``n_tokens`` before and ``n_tokens_edited`` after the edits, ``n_edits``,
    ``n_reencoded`` (pre-tokens encoded again) and, if ``texts``, ``edited_text``."""
    own = ("n_tokens", "n_tokens_edited", "n_edits", "n_reencoded", *(("edited_text",) if texts else ()))
    docs = docs.drop(*own)

    def run(batches):
        counter = load(path)
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                out: list[tuple] = []
                given = [[(e["start"], e["stop"], e["replacement"]) for e in edits or () if e] for edits in batch.column("edits").to_pylist()] if find is None else None
                for i, text in enumerate(batch.column("text").to_pylist()):
                    text = text or ""
                    tree = TokenTree(text, counter)
                    before = tree.total
                    n = apply_edits(tree, find.edits(text) if given is None else given[i], len(text))
                    out.append((before, tree.total, n, tree.reencoded, *((tree.text(),) if texts else ())))
                columns = [pa.array(c, pa.int64() if i < 4 else pa.string()) for i, c in enumerate(zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *own])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    counts = ", ".join(f"{c} {'string' if c == 'edited_text' else 'long'}" for c in own)
    return docs.mapInArrow(run, f"{fields}, {counts}")
