"""BPE encoding and decoding with forced-boundary splitting.

For a vocabulary with end-of-word symbols, two neighbouring symbols that stand
next to each other inside no vocabulary token can never be merged across. Such
pairs are certain cuts: a word is split at them, the fragments are encoded on
their own and the ids concatenated, which gives the ids of the whole word.

Ids equal those of the public library for the same file (no special tokens
added; special tokens written in a text are recognised). Decoding without a
decoder joins token strings by one space, as the library's ``decode`` does.

Nulls, ties, repeats: a null text is encoded as the empty text (no ids). Merge
ties go to the leftmost pair. Rows are encoded one by one; other columns pass
through, except those named like an output, which are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from redactory.llm.common import Memo, Splitter

CACHE_WORDS = 100_000
LONG_FRAGMENT = 64
LATER_SCRIPTS = re.compile("[\u0530-\U0010ffff]")
# fixed value: the pre-token pattern of the file; white space is in no pre-token
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORDS = Splitter(PRE_TOKEN)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level files."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A word-level BPE vocabulary with end-of-word tokens, read from ``path``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in (self.ids | self.special).items()}
        self.symbol = byte_symbols()
        self.byte = {c: b for b, c in enumerate(self.symbol)}
        self.library = Tokenizer.from_file(path)
        self.inside = {pair for token in self.ids for x in [self.split_token(token)] for pair in zip(x, x[1:], strict=False)}
        found = "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.special_at = re.compile(f"({found})") if found else None
        self.words = Memo(self.encode_word, CACHE_WORDS)

    def split_token(self, token: str) -> list[str]:
        """A token as symbols; its last one carries the end-of-word mark, if any."""
        if token.endswith(self.end) and token != self.end:
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merge(self, parts: list[str]) -> list[str]:
        """Lowest-rank merges within one fragment; ties go to the leftmost pair."""
        if len(parts) > LONG_FRAGMENT:
            return self.merge_long(parts)
        rank, never = self.ranks.get, len(self.ranks)
        ranks = [rank(pair, never) for pair in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < never:
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), never)
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), never)
        return parts

    def merge_long(self, parts: list[str]) -> list[str]:
        """``merge`` by a heap of pairs over a linked list, in time n log n."""
        rank, n = self.ranks.get, len(parts)
        ahead, behind = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = ahead[i] if parts[i] else -1
            if j < 0 or parts[i] != left or parts[j] != right:
                continue  # one of the two has been merged since
            parts[i], parts[j] = left + right, ""
            ahead[i] = k = ahead[j]
            if k >= 0:
                behind[k] = i
                if (r := rank((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := behind[i]) >= 0 and (r := rank((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [p for p in parts if p]

    def tokens(self, word: str) -> list[str]:
        """Tokens of one pre-token: cut at forced boundaries, encode each part."""
        symbols = [self.symbol[b] for b in word.encode("utf-8", "replace")]
        symbols[-1] += self.end
        out, start, inside = [], 0, self.inside
        for i, pair in enumerate(zip(symbols, symbols[1:], strict=False), 1):
            if pair not in inside:
                out += self.merge(symbols[start:i])
                start = i
        return out + self.merge(symbols[start:])

    def encode_word(self, word: str) -> tuple[str, str]:
        """(ids, tokens) of one pre-token, each joined by one space."""
        tokens = self.tokens(word)
        return " ".join([str(self.ids[t]) for t in tokens]), " ".join(tokens)

    def pre_tokens(self, text: str) -> list[str]:
        """Normalised words. Character classes depend on the Unicode version of a
        library, so a text with code points that are unassigned here is normalised
        and split by the tokenizer library's own rules."""
        if LATER_SCRIPTS.search(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
            words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(self.byte[c] for c in w).decode("utf-8", "replace") for w, _ in words]
        return WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def encode(self, text: str | None) -> tuple[str, str]:
        """(ids, tokens), each joined by one space."""
        ids, tokens = [], []
        parts = self.special_at.split(text or "") if self.special_at else [text or ""]
        known = self.words.__getitem__
        for i, part in enumerate(parts):
            if i % 2:
                ids.append(str(self.special[part]))
                tokens.append(part)
            elif part:
                pairs = list(map(known, self.pre_tokens(part)))
                ids += [p[0] for p in pairs]
                tokens += [p[1] for p in pairs]
        return " ".join(ids), " ".join(tokens)

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.names[i] for i in ids if i in self.names)


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The vocabulary at ``path``, once for each Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens``, ``token_ids`` array<int> (if ``ids``), ``decoded``,
    and the digests ``ids_sha256`` and ``decoded_sha256``."""
    own = ("n_tokens", *(("token_ids", "decoded") if ids else ()), "ids_sha256", "decoded_sha256")
    docs = docs.drop(*own)

    def run(batches):
        bpe = load(path)
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                made = [bpe.encode(t.as_py()) for t in batch.column("text")]
                columns = [pa.array([i.count(" ") + 1 if i else 0 for i, _ in made], pa.int64())]
                if ids:
                    columns += [pa.array([np.fromstring(i, np.int32, sep=" ") for i, _ in made], pa.list_(pa.int32())), pa.array([t for _, t in made], pa.string())]
                columns += [pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in made_of], pa.string()) for made_of in zip(*made, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *own])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    more = "token_ids array<int>, decoded string, " if ids else ""
    return docs.mapInArrow(run, f"{fields}, n_tokens long, {more}ids_sha256 string, decoded_sha256 string")
