"""Phrases against plain counting."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from check import compare
from mediatimeline.llm import phrases
from tests.llm import data

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain(rows, least, longest=4, top=2000):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            totals[lang] += len(words)
            for n in range(1, longest + 1):
                counts.update((lang, tuple(words[i:i + n])) for i in range(len(words) - n + 1))
    often = {k: f for k, f in counts.items() if len(k[1]) > 1 and f >= least}
    longer = defaultdict(int)
    for (lang, p), f in often.items():
        for n in range(2, len(p)):
            for i in range(len(p) - n + 1):
                longer[lang, p[i:i + n]] = max(longer[lang, p[i:i + n]], f)
    found = defaultdict(list)
    for (lang, p), a in often.items():
        if 100 * longer[lang, p] >= 80 * a:
            continue
        score, _, left, right = min((2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        found[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, totals[lang], -score)
                  for lang, own in found.items() for i, (score, a, p, left, right) in enumerate(sorted(own)[:top]))


def odd_texts():
    pick = random.Random(3)
    stock = ["the", "The", "house", "é", "É", "漢字", "a\x85b", "\x00", "x\x1c", "of", "ß", "new", "york", "city"]
    rows = [(r[2], r[1]) for r in data.odd_rows()]
    for i in range(400):
        words = pick.choices(stock, weights=range(1, len(stock) + 1), k=pick.randrange(0, 60))
        rows.append((pick.choice(["en", "en", "de", None, "und", ""]), "".join(w + pick.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n"]) for w in words)))
    return rows + [("en", "one passage that is in very many texts")] * 500


def run(spark, rows, **kw):
    docs = spark.createDataFrame([(t, lang, 1, 1, 1, 1) for lang, t in rows], "text string, lang string, h int, key int, f int, part int")
    return phrases.collocations(docs.repartition(3), **kw)


@pytest.mark.parametrize("kw", [{"least": 30}, {"least": 5, "budget": 300}, {"least": 3, "longest": 3, "top": 20, "budget": 4000}])
def test_plain(spark, kw, monkeypatch):
    """Small budgets make many groups and extend prefixes; small batches make many runs of one group."""
    if "budget" in kw:
        monkeypatch.setattr(phrases, "BATCH_WORDS", 700)
        monkeypatch.setattr(phrases, "COUNTED_WORDS", 10)
        monkeypatch.setattr(phrases, "KNOWN_WORDS", 10)
    rows = odd_texts()
    want = plain(rows, kw["least"], kw.get("longest", 4), kw.get("top", 2000))
    assert len(want) > 20
    assert sorted(tuple(r[c] for c in COLUMNS) for r in run(spark, rows, **kw).collect()) == want


def test_sql(spark):
    rows = odd_texts()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (lang VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r for r in rows if "\x00" not in (r[1] or "")])
    out = compare(run(spark, [r for r in rows if "\x00" not in (r[1] or "")]), con, phrases.sql())
    assert out.startswith("ok") and "TYPES" not in out, out


def test_words_with_one_number(spark, monkeypatch):
    """Words that share a number under one seed get other numbers under the next."""
    seeds: list[int] = []
    texts = spark.createDataFrame([("en", "a b c")], "lang string, text string")
    monkeypatch.setattr(phrases, "word_counts", lambda t, seed, f=phrases.word_counts: f(t, seed) if seeds else (seeds.append(seed), spark.createDataFrame(
        [(5, "en", "a", 1), (5, "en", "b", 1)], "h long, lang string, word string, f long"))[1])
    words, seed = phrases.vocabulary_of(texts)
    assert seed != seeds[0] and sorted(r.word for r in words.collect()) == ["a", "b", "c"]


def test_large_products(spark):
    """Counts whose products pass 64 bits."""
    huge = 8 * 10**18
    one = [([1, 2], huge)]
    phrases_, words = spark.createDataFrame(one, "key array<long>, f long"), spark.createDataFrame([(1, huge), (2, huge + 1)], "h long, f long")
    assert phrases.scored(phrases_, words).first()["score"] == 2_000_000 * huge // (2 * huge + 1)
    more = spark.createDataFrame([([1, 2], 10**17 + 1), ([1, 2, 3], 8 * 10**16), ([2, 3], 10**17)], "key array<long>, f long")
    assert sorted(r.key for r in phrases.not_contained(more).collect()) == [[1, 2], [1, 2, 3]]


def test_suffixes_stop_at_breaks():
    rows = phrases.suffixes(np.array([2, 3, 0, 4, 0, 5, 6, 7, 8, 9], np.int32), 4)
    assert rows.tolist() == [[2, 3, 0, 0], [5, 6, 7, 8], [6, 7, 8, 9], [7, 8, 9, 0], [8, 9, 0, 0]]


def test_empty(spark):
    assert run(spark, [("en", "x")]).where("false").columns == COLUMNS
    for rows in ([("en", None), (None, "")], [("en", "a b " * 20)]):
        assert run(spark, rows).collect() == []
    assert phrases.collocations(data.empty(spark)).collect() == []
