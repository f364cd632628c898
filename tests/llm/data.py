"""A small table with everything that is odd about documents, and plain Python versions of what operators count."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that operators use for columns of their own
    *[T.StructField(n, T.IntegerType()) for n in (
        "id", "row", "size", "shard", "slot", "score", "kept", "labels", "taken", "mix_source", "mix_size", "text_hash", "root", "set",
        "fingerprint", "n_words", "n_tokens", "held_out", "lang_pred", "component_id", "key", "k", "h", "body", "ids", "label")]])

EN, DE = "the house and the garden of our friends are near the river", "das Haus und der Garten von unseren Freunden sind an dem Fluss"


def prose(seed: int, words: int, of: str = EN) -> str:
    pick = random.Random(seed)
    stock = of.split() + [a + b for a in of.split() for b in of.split()]
    return " ".join(pick.choice(stock) for _ in range(words))


def changed(text: str, every: int) -> str:
    return " ".join(w if i % every else w + "x" for i, w in enumerate(text.split(" ")))


def odd_rows() -> list[tuple]:
    long = prose(1, 9000)
    base = prose(2, 300)
    rows = [
        (None, prose(3, 80), "en", "b"), (None, prose(3, 80), "en", "b"), (None, None, None, None),
        (1, None, "en", "a"), (2, "", "de", "a"), (3, " \n\t \x0b", None, "a"), (4, "...---... 1234 !!", "en", None),
        (5, base, "en", "a"), (6, base, "en", "b"), (6, base, "en", "b"), (6, base, "en", "b"), (7, changed(base, 60), "en", "c"),
        (8, changed(base, 9), "en", "c"), (9, long, "en", "a"), (10, "x" * 50_000, "en", "a"), (11, "one two three", "en", "a"),
        (12, "One  TWO three", "en", "a"), (13, "<|endoftext|> and\x00 odd  <|endoftext|> 　 text 's 're", "en", "b"),
        (14, "漢字かな交じり文。" * 300 + "😀👍🏽 é é ß İ K", "de", "é"), (15, prose(4, 200, DE), "de", "é"), (15, prose(5, 200, DE), "de", None),
        (16, "Under the MIT license, and the Apache License, Version 2.0; CC-BY-NC 4.0. GPL-3.0-or-later. All rights reserved.", "en", "a"),
        (17, "\n\n".join(["Same line."] * 40), "en", "a"), (18, prose(6, 200, DE), "de", "a"), (-5, prose(7, 120), "en", "a"),
        (2**62, prose(8, 120), "en", "a"), (19, "under the mit license " * 400, "en", "z"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), *[7] * (len(SCHEMA) - 5)) for i, t, lang, s in rows]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(rows, *columns):
    """Rows as a sorted list of tuples, null before everything."""
    return sorted((tuple(r[c] for c in columns) for r in rows), key=lambda t: [(v is not None, v) for v in t])


def shingles(text: str | None, n: int = 5) -> frozenset:
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def linked(sets: list[frozenset], percent: int = 75) -> list[int]:
    """Smallest position that each set reaches over links, by comparing all pairs."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(x) for x in range(len(sets))]


def good(judged: tuple) -> bool:
    """What the pipeline's quality stage keeps: the verdict of the bands, and few symbols a word."""
    return judged[-1] and judged[2] <= 0.3 * judged[0]
