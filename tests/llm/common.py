"""Brute-force helpers of the tests."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, n):
    w = words(text)
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


def sentence(rng, n=40, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_rows(seed=1):
    """(doc_id, text): nulls, empty and blank texts, a long one, ties, repeated rows."""
    rng = random.Random(seed)
    long_ = sentence(rng, 30_000, 5000)
    same = sentence(rng, 50)
    return [(1, None), (2, ""), (3, "  \n\t "), (4, long_), (5, same), (6, same), (5, same), (None, "no id here"), (7, "A"), (8, "é漢 😀 " + same)]
