"""Operators that judge each row by itself."""

import random
import re
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from mediatimeline.llm import fingerprints, html_extract, language_id, license_rules, license_scan, quality_rules
from mediatimeline.llm.common import read
from tests.conftest import SMALL
from tests.llm import data


def test_quality_counts(spark):
    rows = {}
    for r in quality_rules.quality_rules(data.odd(spark)).collect():
        rows.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, rows.values())) == len(data.odd_rows())
    for doc_id, text, *_ in data.odd_rows():
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
        seen = Counter(windows)
        repeated = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated))
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        found = [r for r in rows[doc_id] if (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want]
        assert found and all(r.base_failed == failed and not (failed and r.kept) for r in found), (doc_id, want)
    assert quality_rules.quality_rules(data.empty(spark)).collect() == []


def test_bands_reject_both_ends():
    zip_ = zstandard.ZstdCompressor(level=3)
    import random
    pick = random.Random(5)
    noise = " ".join("".join(pick.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60)) for _ in range(300))
    assert not quality_rules.judge(noise, zip_)[-1]
    assert not quality_rules.judge("all of this is said again and again, " * 400, zip_)[-1]
    low, high = quality_rules.band(3000)
    assert 1 < low < high and quality_rules.band(10) == (0.0, float("inf"))


def topics() -> list[str]:
    """English help texts of Python itself, white space collapsed."""
    from pydoc_data.topics import topics as found
    return [text for text in (" ".join(t.split()) for t in found.values()) if len(text.split()) >= 50]


def test_incompressible_text_is_rejected():
    zip_ = zstandard.ZstdCompressor(level=3)
    pick = random.Random(11)
    stocks = {"hex": "0123456789abcdef", "letters": "abcdefghijklmnopqrstuvwxyz",
              "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
    for name, stock in stocks.items():
        for size in (600, 1024, 2048, 4096, 8192, 32_768, 200_000):
            kept = 0
            for _ in range(10):
                words = ["".join(pick.choices(stock, k=11)) for _ in range(size // 12 + 1)]
                kept += quality_rules.judge(" ".join(words)[:size], zip_)[-1]
            if size >= 1024 or name == "base64":  # shorter hex and letters overlap prose
                assert kept == 0, (name, size, kept)
    passages = [text[at:at + size] for text in topics() for size in (600, 1024, 2048, 4096, 8192) for at in range(0, len(text) - size + 1, size)]
    assert len(passages) > 500
    assert all(quality_rules.gain(text, zip_) >= quality_rules.band(len(text))[0] for text in passages)


def test_real_prose_is_kept_in_every_script():
    zip_ = zstandard.ZstdCompressor(level=3)
    texts = [t for t in topics() if len(re.findall(r"[#*$%&|<>]", t)) <= 0.3 * len(t.split())]
    assert len(texts) > 60
    for first in (None, 0x430, 0x905):  # as it is, in Cyrillic and in Devanagari letters
        for text in texts:
            if first:
                text = text.lower().translate({97 + i: chr(first + i) for i in range(26)})
            words = quality_rules.judge(text, zip_)
            assert words[-1] or words[5], (first, text[:60], words)  # kept, or failed by repeated words
    assert quality_rules.band(1 << 21)[1] > quality_rules.band(1 << 19)[1] > quality_rules.band(1 << 17)[1]
    for text in ("the same few words stand here " * 40, "другие слова стоят тут и там " * 40):
        assert not quality_rules.judge(text, zip_)[-1] and quality_rules.gain(text, zip_) > quality_rules.band(len(text))[1]


def test_good_documents_keep_all_columns(spark):
    assert quality_rules.good_documents(data.odd(spark)).columns == data.SCHEMA.names
    docs = read(spark, SMALL, "documents")
    zip_ = zstandard.ZstdCompressor(level=3)
    want = sorted(tuple(r) for r in docs.collect() if data.good(quality_rules.judge(r.text, zip_)))
    assert sorted(map(tuple, quality_rules.good_documents(docs).collect())) == want and 0 < len(want) < docs.count()


def test_symbols_are_a_rule_of_their_own(spark):
    """The verdict of the bands does not look at symbols; the pipeline's stage does."""
    marked = " ".join(w + "%%%" if i % 3 else w for i, w in enumerate(data.prose(3, 600).split()))
    docs = spark.createDataFrame([(1, marked), (2, data.prose(3, 600))], "doc_id long, text string")
    bands = {r.doc_id: r.kept for r in quality_rules.quality_rules(docs).collect()}
    assert bands == {1: quality_rules.judge(marked, zstandard.ZstdCompressor(level=3))[-1], 2: True}
    assert [r.doc_id for r in quality_rules.good_documents(docs).collect()] == [2]
    free = [r.doc_id for r in quality_rules.good_documents(docs, most_symbols=float("inf")).collect()]
    assert sorted(free) == sorted(k for k, kept in bands.items() if kept)


def reference_scan(text: str) -> tuple:
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = []
    for priority, label, confidence, keyword, regex in license_rules.parse():
        for i, word in enumerate(words):
            if word == keyword:
                first = max(0, i - license_scan.REACH)
                window = " ".join([*words[first:i], f"<{word}>", *words[i + 1:i + 1 + license_scan.REACH]])
                m = re.search(f"(?:^| )({regex})(?= |$)", window)
                if m:
                    start = i - m[1].split("<")[0].count(" ")
                    found.append((start, -(i + 1 + m[1].split(">")[1].count(" ")), priority, label, confidence))
    base = [f for f in found if f[2] < license_scan.BASE_RULES]
    labels, best, opened = set(), 0.0, None
    for f in sorted(found):
        if opened and -f[1] <= -opened[1]:
            continue
        if opened and f[0] < -opened[1]:
            if f[2] < opened[2]:
                opened = f
            continue
        if opened:
            labels.add(opened[3])
            best = max(best, opened[4])
        opened = f
    if opened:
        labels.add(opened[3])
        best = max(best, opened[4])
    names = {f[3] for f in base}
    return (len(words), len(base), min((f[0] for f in base), default=None), max((f[0] for f in base), default=None),
            ",".join(sorted(names)), ",".join(sorted(names | labels)), max(best, 1.0 if base else 0.0))


def test_license_scan(spark):
    lines = ["GNU General Public License version 3 or later", "SPDX-License-Identifier: BSD-3-Clause", "see the LICENSE file", "the mit license mit",
             "creative commons attribution noncommercial sharealike 4.0 international", "cc by nc sa 4.0 cc by nc", "xmit license", "émit license",
             "licensed under the Apache License, Version 2.0 (the License)", "permission is hereby granted, free of charge, to any person obtaining a copy"]
    extra = [(100 + i, f"{data.prose(i, 30)} {line} {data.prose(i, 20)} {line}", "en", "a", 0, *[7] * (len(data.SCHEMA) - 5)) for i, line in enumerate(lines)]
    docs = data.odd(spark).union(spark.createDataFrame(extra, data.SCHEMA))
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    found = data.pairs(license_scan.license_scan(docs).collect(), "doc_id", *columns)
    want = [(r[0], *reference_scan(r[1])) for r in data.odd_rows() + extra]
    assert found == sorted(want, key=lambda t: [(v is not None, v) for v in t])
    assert license_scan.license_scan(data.empty(spark)).collect() == []


def test_license_words_may_end_in_unicode_line_ends(spark):
    texts = [f"the mit{end} x under the mit license{end} x under the mit license and the {end}apache license{end}" for end in ("\u0085", "\u2028", "\u2029", "\u2028\u2029")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = [(i, *reference_scan(text)) for i, text in enumerate(texts)]
    assert all(w[2] for w in want)
    assert data.pairs(license_scan.license_scan(docs).collect(), "doc_id", *columns) == want


def test_rules_fit_their_windows():
    rules = license_rules.parse()
    assert len(rules) >= 200 and [r[0] for r in rules] == list(range(len(rules)))
    for *_, keyword, regex in rules:
        before, after = regex.split(f"<{keyword}>")
        assert max(len(before.split()), len(after.split())) <= license_scan.REACH


def test_fingerprints(spark):
    rows = fingerprints.fingerprints(data.odd(spark)).collect()
    assert len(rows) == len(data.odd_rows())
    texts = [(r[0], r[1] or "") for r in data.odd_rows()]
    by_print = {}
    for r in rows:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_print.setdefault(r.fingerprint, set()).add((r.doc_id, r.n_chars))
    assert len(by_print) == len({t for _, t in texts})
    assert data.pairs(rows, "doc_id", "n_chars") == sorted(((i, len(t)) for i, t in texts), key=lambda t: [(v is not None, v) for v in t])
    same = {i: next(p for p, ids in by_print.items() if i in {x for x, _ in ids}) for i in (5, 6)}
    assert same[5] == same[6]
    assert fingerprints.fingerprints(data.empty(spark)).collect() == []
    alone = fingerprints.fingerprints(data.odd(spark).where("doc_id = 9")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_differing_branches(spark):
    lines = [f"Line {i} says something. And more of it {i * 7}." for i in range(40)]
    other = lines[:20] + ["A new paragraph stands here."] + lines[20:]
    df = spark.createDataFrame([("\n".join(lines), "\n".join(other))], "a string, b string")
    both = df.select(*[fingerprints.rooted(fingerprints.fingerprint(F.col(c))).alias(c) for c in "ab"])
    places = both.select(fingerprints.differing(F.col("a"), F.col("b")).alias("p")).first().p
    assert len(places) == 1
    assert both.select(fingerprints.differing(F.col("a"), F.col("a")).alias("p")).first().p == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><div>no</div>";</script></head><body class="x">
<header><div class="logo">Site name</div></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="wrap-12"><div class="post post-%d"><h1>Title &amp; more</h1><p>First   paragraph with <b>bold<br>text</b> and &lt;tags&gt; it has, commas,
 many of them, so that it counts.<p>Second paragraph &eacute;&#233; is also quite long, with enough words to count as text.
<div class="ad">Buy now</div><form><input name=q><p>Your mail</p></form><script>if (a<b) {}</script><!-- <p>gone</p> -->
<ul><li>one point<li>two points</ul><p a="x>y">1 < 2 &copy third</p></div>
<aside>Side</aside><div class="comments"><p>Reader comment that is long, very long, longer than anything, and yet no part of it.</p></div></div>
<footer>&copy; Site</footer></body></html>"""
MAIN = ("Title & more\nFirst paragraph with bold text and <tags> it has, commas, many of them, so that it counts.\n"
        "Second paragraph éé is also quite long, with enough words to count as text.\none point\ntwo points\n1 < 2 © third")


def test_html(spark):
    short = '<html><body><div id="wrap-9"><div class="post post-77"><p>Short.</p></div><div class="widget"><p>Something longer than it</p></div></div>'
    other = "<main><p>Another page</p></main>"
    rows = [(i, "http://www.a.example/x", PAGE % i, 1) for i in range(5)]
    rows += [(5, "http://www.a.example/y", short, 1), (6, "HTTPS://u@B.example:80/", other, 1), (7, None, None, 1), (8, "x", "", 1), (None, "http://c.example", "plain text", 1),
             (9, "http://c.example", "<script>only", 1), (10, "http://www.a.example/z", "<p>" + "long text. " * 20_000, 1), (1, "http://www.a.example/x", PAGE % 1, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = html_extract.extract(pages).collect()
    assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
    texts = {r.page_id: r.text for r in found}
    assert all(texts[i] == MAIN for i in range(5)), texts[0]
    assert [texts[i] for i in (5, 6, 7, 8, None, 9)] == ["Short.", "Another page", "", "", "plain text", ""]
    assert texts[10] == ("long text. " * 20_000).strip()
    paths = {r.host: r.path for r in html_extract.host_paths(pages).collect()}
    assert paths["www.a.example"] == "/html/body.x/div/div.post.post-#" and paths["b.example"] == "/main"
    assert html_extract.extract(pages.limit(0)).collect() == []


def test_html_text_beside_the_winner_is_kept(spark):
    body = "".join(f"<p>Paragraph {i} of the body has a good number of words, as most of them do.</p>" for i in range(12))
    texts = {
        "article": (f"<article><h1>A title</h1><div class='lead'>A short lead.</div><div class='entry-content'>{body}</div></article>",
                    ["A title", "A short lead.", "Paragraph 0", "Paragraph 11"]),
        "sections": (f"<div><div class='one'>{body}</div><div class='two'><p>Second part {'with many words, too, ' * 15}</p></div></div>",
                     ["Paragraph 0", "Second part"]),
        "empty shell": (f"<div class='shell'></div><div class='other'>{body}</div>", ["Paragraph 0", "Paragraph 11"])}
    noise = "<nav>Menu</nav><div class='bar'><a href='/'>Home</a> <a href='/x'>Elsewhere</a></div>"
    rows = [(k, f"http://{k.replace(' ', '')}.example/", f"<html><body>{noise}{page}<footer>End</footer></body></html>") for k, (page, _) in texts.items()]
    rows += [("usual", "http://emptyshell.example/", f"<html><body>{noise}<div class='shell'>{body * 3}</div></body></html>")] * 3
    found = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    for name, (_, parts) in texts.items():
        assert all(part in found[name] for part in parts), (name, found[name])
        assert not any(word in found[name] for word in ("Menu", "Home", "Elsewhere", "End")), (name, found[name])


def test_language(spark):
    rows = [(i, data.prose(i, 60, data.EN if i % 2 else data.DE), "en" if i % 2 else "de", "a", 0, *[7] * (len(data.SCHEMA) - 5)) for i in range(1000, 1200)]
    docs = data.odd(spark).union(spark.createDataFrame(rows, data.SCHEMA))
    found = language_id.language_id(docs).collect()
    assert len(found) == len(rows) + len(data.odd_rows())
    right = [r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in found if r.held_out and r.doc_id and 1000 <= r.doc_id < 1200]
    assert len(right) > 20 and sum(right) >= 0.98 * len(right)
    assert all(0 <= r.score <= 1 for r in found)
    assert {r.doc_id for r in found if r.lang_pred == "und"} == {None, 1, 2, 3, 4}
    again = language_id.language_id(docs).collect()
    assert data.pairs(found, "doc_id", "lang_pred") == data.pairs(again, "doc_id", "lang_pred")
    assert language_id.language_id(data.empty(spark)).collect() == []
    unlabelled = language_id.language_id(data.odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
    kept = language_id.identified(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (1, 2, 3, 4)").count() == 0


def test_texts_of_no_learned_language_are_rejected(spark):
    docs = read(spark, SMALL, "documents").select("doc_id", "text", "lang")
    pick = random.Random(3)
    stocks = {"hex": "0123456789abcdef", "letters": "abcdefghijklmnopqrstuvwxyz", "consonants": "bcdfghjklmnpqrstvwxz",
              "cjk": "".join(map(chr, range(0x4E00, 0x9000)))}
    strange = {f"{name} {size}": " ".join("".join(pick.choices(stock, k=11)) for _ in range(size // 12))
               for name, stock in stocks.items() for size in (300, 1000, 4000, 20_000)}
    strange |= {"ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
                "zh": "人人生而自由在尊严和权利上一律平等他们赋有理性和良心并应以兄弟关系的精神相对待。",
                "el": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα."}
    known = {"en": "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and should "
                   "act towards one another in a spirit of brotherhood."}
    rows = spark.createDataFrame([(k, v) for k, v in (strange | known).items()], "doc_id string, text string")
    both = docs.select(F.col("doc_id").cast("string"), "text", "lang").union(rows.withColumn("lang", F.lit(None).cast("string")))
    kept = {r.doc_id for r in language_id.identified(both).select("doc_id").collect()}
    assert not kept & set(strange), kept & set(strange)
    assert set(known) <= kept
    labelled = {r.doc_id: r.text for r in docs.select(F.col("doc_id").cast("string"), "text").collect()}
    assert len(kept & set(labelled)) >= 0.97 * sum(map(language_id.has_letter, labelled.values()))


def test_fit_and_holdout_do_not_meet(spark):
    docs = data.odd(spark)
    import zlib
    for r in docs.select("doc_id", language_id.held_out(docs, "doc_id").alias("out")).collect():
        assert r.out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)


PROSE = "This is a long paragraph of prose that belongs to the article and must stay in the text, whatever its wrapper. "


@pytest.mark.parametrize("inner", ["article", "main"])
def test_no_wrapper_name_drops_the_article(inner):
    for word in html_extract.DROPPED_WORDS | html_extract.HEADER_WORDS | html_extract.FOREIGN_WORDS:
        for name in (word, f"has-{word}", f"{word}-less", f"with{word.title()}"):
            page = (f'<body><nav class="menu"><a href=x>Home</a></nav><div class="layout {name}"><{inner}><h1>Title</h1><p>{PROSE * 2}</p></{inner}></div>'
                    f'<div class="sidebar"><p>Buy now</p></div><div id="comments"><p>{PROSE}Not so.</p></div><footer>foot</footer></body>')
            assert html_extract.Page(page).text(None) == "Title\n" + (PROSE * 2).strip(), (name, inner)


@pytest.mark.parametrize("attribute", ['title="The hidden history"', 'data-id="promo-banner-7"', 'data-class="sidebar"', 'aria-label="comments hidden"',
                                       'data-hidden="true"', "alt='class=\"ad\"'", 'data-role="navigation"', "data-x=hidden"])
def test_other_attributes_mean_nothing(attribute):
    page = html_extract.Page(f"<article><section {attribute}><p>{PROSE}</p></section><p>{PROSE}</p></article>")
    assert page.text(None) == "\n".join([PROSE.strip()] * 2)


def test_boilerplate_stays_boilerplate():
    """Long comments, and long adverts beside a short article, are left out."""
    comments = "".join(f'<article class="comment"><p>{PROSE}</p></article>' for _ in range(5))
    page = html_extract.Page(f'<body><article><p>{PROSE}</p><p>{PROSE}</p></article><div class="comments">{comments}</div><div class="ad"><p>{PROSE * 9}</p></div></body>')
    assert page.text(None) == "\n".join([PROSE.strip()] * 2)
