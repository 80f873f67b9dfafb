"""Small documents with every awkward case, and brute-force versions of what the operators compute."""

from __future__ import annotations

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "tiempo nuevo casa " * 20_000

#: (doc_id, text): nulls, blanks, ties, repeats, control characters, other scripts and a very long text.
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "a"), (5, "a"), (5, "a"), (None, "a"), (None, None), (6, "a b"),
    (7, "a  b"), (8, "a\tb"), (9, " a b "), (10, "A B c D"), (11, "ÄÖ ß 日本語 \U0001f600 é"), (12, LONG), (13, LONG),
    (14, "\x00 ﻿  x"), (15, "one two three four five six seven"), (16, "1 2 3 ... !!! ###"),
    (17, "<|endoftext|> <s> </s> \\### </turn>"), (18, "a\n\na\n a\nb\n"), (19, "x y z x y z q x y z"),
]


def documents(spark, rows, extra: bool = False):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    if extra:  # columns that computed ones could clash with
        for name in ("kept", "keep_id", "digest", "score", "rule", "ids", "part", "band", "rep", "n_words", "verdict"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df.repartition(3)


def awkward(spark):
    return documents(spark, AWKWARD, extra=True)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, size):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
    n = min(size, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if n else frozenset()


def near_components(rows, size, percent):
    """{doc_id: (set size, smallest linked id)} by comparing all pairs."""
    sets = {i: shingles(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for at, a in enumerate(ids):
        for b in ids[at + 1 :]:
            both = len(sets[a] & sets[b])
            either = len(sets[a] | sets[b])
            if both and 100 * both >= percent * either:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: (len(sets[i]), root(i)) for i in ids}
