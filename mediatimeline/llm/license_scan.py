"""License detection by ordered signature rules, in column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediatimeline.llm import license_rules
from mediatimeline.llm.common import ids_and_texts

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # counts the same words before A-Z are lowered
BASE_RULES = 3  # the first rules are the base phrases
REACH = 16  # words that a window holds on either side of a keyword; no rule is longer
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _rules_by_keyword(rules) -> Column:
    """Constant map: keyword to its rules in order."""
    groups: dict[str, list[Column]] = {}
    for priority, label, confidence, keyword, regex in rules:
        groups.setdefault(keyword, []).append(F.struct(
            F.lit(f"(?:^| )({regex})(?= |\\z)").alias("regex"), F.lit(priority).alias("priority"), F.lit(label).alias("label"),
            F.lit(confidence).alias("confidence")))
    return F.create_map(*[x for k, v in groups.items() for x in (F.lit(k), F.array(*v))])


def detections(words: Column, rules) -> Column:
    """All places where a rule holds, as (start, back, priority, label, confidence) with back = -end, sorted.

    Rules are tried only at their keywords, each in a window of REACH words to either side, so the work grows with the
    number of keywords in a text and never with the square of anything.
    """
    table = _rules_by_keyword(rules)
    any_keyword = "^(?:" + "|".join(dict.fromkeys(r[3] for r in rules)) + ")\\z"  # $ would also match before U+0085, U+2028 and U+2029
    anchors = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word"))), lambda a: a["word"].rlike(any_keyword))

    def at_anchor(a: Column) -> Column:
        first = F.greatest(a["at"] - REACH, F.lit(0))
        window = F.concat_ws(" ", F.slice(words, first + 1, a["at"] - first), F.concat(F.lit("<"), a["word"], F.lit(">")),
                             F.slice(words, a["at"] + 2, REACH))
        tried = F.transform(F.element_at(table, a["word"]), lambda r: F.struct(
            r.alias("rule"), F.call_function("regexp_extract", window, r["regex"], F.lit(1)).alias("found")))
        return F.transform(F.filter(tried, lambda t: t["found"] != ""), lambda t: F.struct(
            (a["at"] - _blanks(F.substring_index(t["found"], "<", 1))).alias("start"),
            -(a["at"] + 1 + _blanks(F.substring_index(t["found"], ">", -1))).alias("back"),
            t["rule"]["priority"].alias("priority"), t["rule"]["label"].alias("label"), t["rule"]["confidence"].alias("confidence")))

    return F.array_sort(F.flatten(F.transform(anchors, at_anchor)))


def resolve(found: Column) -> Column:
    """Labels and best confidence of what remains of sorted detections.

    In one pass with one open detection: one that lies inside the open one, or in the same place with a later rule, goes; of
    two that overlap in part the earlier rule stays; otherwise the open one is final.
    """
    start = F.struct(F.lit(0).alias("end"), F.lit(2147483647).alias("priority"), F.lit("").alias("label"),
                     F.lit(0.0).alias("confidence"), F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("best"))

    def with_open(s: Column) -> Column:
        return F.when(s["label"] != "", F.array_union(s["labels"], F.array(s["label"]))).otherwise(s["labels"])

    def step(s: Column, d: Column) -> Column:
        opened = [(-d["back"]).alias("end"), d["priority"].alias("priority"), d["label"].alias("label"), d["confidence"].alias("confidence")]
        replaced = F.struct(*opened, s["labels"].alias("labels"), s["best"].alias("best"))
        final = F.struct(*opened, with_open(s).alias("labels"), F.greatest(s["best"], s["confidence"]).alias("best"))
        return F.when(-d["back"] <= s["end"], s).when(d["start"] >= s["end"], final).when(d["priority"] < s["priority"], replaced).otherwise(s)

    return F.aggregate(found, start, step, lambda s: F.struct(
        with_open(s).alias("labels"), F.greatest(s["best"], s["confidence"]).alias("best")))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=None) -> DataFrame:
    """`id_col`, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    Words are runs of letters, digits and non-ASCII characters, A-Z in lower case. The first BASE_RULES rules are exact
    phrases: n_base counts all their places, first_word and last_word are their smallest and largest start (null without
    one), base_labels their labels. labels adds those of the other rules that survive `resolve`; a base label always stays.
    score is the best confidence among the surviving detections and base phrases, 0 without any.

    Texts without any keyword substring are told by one search and do no more; others are split into words once. All of it
    is one projection over the scan: no shuffle, no Python, whole texts. A null or empty text has no words, no places, empty
    labels and score 0. Ids may be null or repeated; every row comes out once. Other columns are not read.
    """
    rules = license_rules.parse() if rules is None else rules
    keywords = sorted(dict.fromkeys(r[3] for r in rules))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = ids_and_texts(docs, id_col, text_col)
    hinted = text.rlike("(?i)(?<![0-9A-Za-z])(?:" + "|".join(keywords) + ")(?![0-9A-Za-z])")
    words = F.filter(F.split(F.translate(text, UPPER, LOWER), NOT_WORD), lambda w: w != "")
    scanned = rows.select("id", F.regexp_count(text, F.lit(ANY_CASE_WORD)).cast("long").alias("n_words"),
                          F.when(hinted, words).otherwise(F.array().cast("array<string>")).alias("words"))
    found = scanned.select("id", "n_words", detections(F.col("words"), rules).cast(
        "array<struct<start:int,back:int,priority:int,label:string,confidence:double>>").alias("found"))
    base = F.filter("found", lambda d: d["priority"] < BASE_RULES)
    judged = found.select("id", "n_words", base.alias("base"), resolve(F.col("found")).alias("kept"))
    starts = F.transform("base", lambda d: d["start"].cast("long"))
    names = F.array_distinct(F.transform("base", lambda d: d["label"]))
    return judged.select(
        F.col("id").alias(id_col), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), F.array_join(F.array_sort(names), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(names, F.col("kept")["labels"])), ",").alias("labels"),
        F.greatest(F.col("kept")["best"], F.when(F.size("base") > 0, 1.0).otherwise(0.0)).alias("score"))
