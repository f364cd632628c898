"""Merkle fingerprints of documents: equal roots mean equal texts, differing branches show where two texts differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mediatimeline.llm.common import ids_and_texts
from mediatimeline.session import settle

PARAGRAPH = r"[^\n]*\n+|[^\n]+"
LEAF = r"[^.!?\n]{1,256}[.!?]*\n*|[.!?]+\n*|\n+"  # a sentence, or a piece of a long one; leaves cover every character
LEAF_HEX, NODE_HEX = 12, 16


def _hash(text: Column, digits: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def _node(section: Column) -> Column:
    """Hash of a section: over the hashes of its paragraphs, each over the hashes of its leaves."""
    return _hash(F.array_join(F.transform(F.split(section, "/"), lambda p: _hash(p, NODE_HEX)), "/"), NODE_HEX)


def fingerprint(text: Column) -> Column:
    """root:section=leaf,leaf/leaf;section=leaf, all in hex; `,` parts leaves, `/` paragraphs, `;` sections.

    Paragraphs are lines, leaves their sentences. A section ends behind a paragraph whose own hash starts with 0 to 3, so an
    inserted paragraph moves no later section boundary. The root is the SHA-256 over the sections' hashes.
    """
    leaves = F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), 0), lambda p: F.array_join(
        F.transform(F.regexp_extract_all(p, F.lit(LEAF), 0), lambda leaf: _hash(leaf, LEAF_HEX)), ","))
    ended = F.transform(leaves, lambda p: F.concat(p, F.when(_hash(p, 1).isin("0", "1", "2", "3"), ";").otherwise("/")))
    return F.regexp_replace(F.array_join(ended, ""), "[;/]$", "")


def rooted(body: Column) -> Column:
    sections = F.transform(F.split(body, ";"), lambda s: F.struct(_node(s).alias("node"), s.alias("body")))
    root = F.sha2(F.array_join(F.transform(sections, lambda s: s["node"]), ";"), 256)
    return F.concat(root, F.lit(":"), F.array_join(F.transform(sections, lambda s: F.concat(s["node"], F.lit("="), s["body"])), ";"))


def leaf_set(body: Column) -> Column:
    """The distinct leaf hashes of a fingerprint."""
    plain = F.regexp_replace(body, "^[0-9a-f]{64}:|[0-9a-f]{16}=", "")
    return F.array_distinct(F.filter(F.split(plain, "[,/;]"), lambda x: x != ""))


def likeness(a: Column, b: Column) -> Column:
    """Twice the common leaves by all leaves of two leaf sets; 1 for two empty ones."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def differing(a: Column, b: Column) -> Column:
    """(section, paragraph) of fingerprint b, from 0, that hold leaves unknown to a; sections that a has too are not opened."""
    known = F.transform(F.split(a, "[:;]"), lambda s: F.substring_index(s, "=", 1))
    leaves = leaf_set(a)
    parts = F.split(b, "[:;]")
    sections = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda s, i: F.struct(
        i.alias("section"), F.substring_index(s, "=", 1).alias("node"), F.split(F.substring_index(s, "=", -1), "/").alias("paragraphs")))
    opened = F.filter(sections, lambda s: ~F.array_contains(known, s["node"]))
    places = F.flatten(F.transform(opened, lambda s: F.transform(s["paragraphs"], lambda p, i: F.struct(
        s["section"].alias("section"), i.alias("paragraph"), F.split(p, ",").alias("leaves")))))
    changed = F.filter(places, lambda p: F.size(F.array_except(p["leaves"], leaves)) > 0)
    return F.transform(changed, lambda p: F.struct(p["section"].alias("section"), p["paragraph"].alias("paragraph")))


def followers(keys: DataFrame) -> DataFrame:
    """k, h with the key (before_k, before_h) and length (before_n) of the row before in the order of (id, h); the first
    follows the last.

    Ranges of ids are sorted each by itself; a table with one row per range carries the last row of a range over to the
    next that has rows.
    """
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settle(keys.repartitionByRange(parts, F.col("id").asc_nulls_first(), "h").withColumn("range", F.spark_partition_id()))
    me = F.struct("id", "h", "k", "n")
    last = placed.groupBy("range").agg(F.max(me).alias("last"))
    order = Window.orderBy("range")
    final = F.last("last").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    carried = last.select("range", F.coalesce(F.lag("last").over(order), final).alias("carried"))
    inside = Window.partitionBy("range").orderBy(F.col("id").asc_nulls_first(), "h")
    before = placed.select("range", "k", "h", F.lag(me).over(inside).alias("before")).join(carried, "range")
    before = before.withColumn("before", F.coalesce("before", "carried"))
    return before.select("k", "h", F.col("before")["k"].alias("before_k"), F.col("before")["h"].alias("before_h"),
                         F.col("before")["n"].alias("before_n"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many of the next document. Which
    document is next comes from a narrow table of keys. Each document then sends its start, as long as the one before
    needs it, and its fingerprint; texts are shuffled once, by (id, text hash), and the start of a text once more.

    A null text is empty. The order is by id, nulls first, then by a hash of the text; rows equal in both count as one
    document there, and each of them gets the same values. A single document follows itself. Two empty texts have likeness 1.
    An empty table gives an empty result. Other columns are not read. `id_col` has an integer or string type.
    """
    text = F.coalesce("text", F.lit(""))
    kind = docs.schema[id_col].dataType
    read = ids_and_texts(docs, id_col, text_col)
    key = F.coalesce(F.concat(F.lit("i"), F.col("id").cast("string")), F.lit("n")).alias("k")
    links = followers(read.select("id", F.xxhash64(text).alias("h"), key, F.length(text).alias("n")).distinct())
    rows = read.select(key, F.xxhash64(text).alias("h"), text.alias("text"), fingerprint(text).alias("body"))
    sent = rows.join(links, ["k", "h"]).select(
        F.col("before_k").alias("k"), F.col("before_h").alias("h"), F.col("body").alias("next_body"),
        F.substring("text", F.lit(1), F.floor(F.col("before_n") / 4).cast("int")).alias("head"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = rows.join(sent.dropDuplicates(["k", "h"]), ["k", "h"]).select(
        "k", "text", "body", "next_body", n.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), n - cut), "head").alias("edited"))
    compared = edited.withColumn("edited_body", fingerprint(F.col("edited"))).withColumn("leaves", leaf_set(F.col("body")))
    return compared.select(
        F.when(F.col("k") != "n", F.substring("k", 2, 2147483647)).cast(kind).alias(id_col), "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"), rooted(F.col("body")).alias("fingerprint"),
        rooted(F.col("edited_body")).alias("edited_fingerprint"),
        likeness(F.col("leaves"), leaf_set(F.col("edited_body"))).alias("near_edited"),
        likeness(F.col("leaves"), leaf_set(F.col("next_body"))).alias("near_next"))


def _body_sql(text: str) -> str:
    return rf"""regexp_replace(array_to_string(list_transform(list_transform(regexp_extract_all({text}, '{PARAGRAPH}'),
        lambda p: array_to_string(list_transform(regexp_extract_all(p, '{LEAF}'), lambda x: substring(sha256(x), 1, {LEAF_HEX})), ',')),
        lambda q: q || CASE WHEN substring(sha256(q), 1, 1) IN ('0', '1', '2', '3') THEN ';' ELSE '/' END), ''), '[;/]$', '')"""


def _root_sql(body: str) -> str:
    node = (f"substring(sha256(array_to_string(list_transform(string_split(s, '/'), lambda p: substring(sha256(p), 1, {NODE_HEX})), '/')), "
            f"1, {NODE_HEX})")
    sections = f"string_split({body}, ';')"
    return (f"sha256(array_to_string(list_transform({sections}, lambda s: {node}), ';')) || ':' || "
            f"array_to_string(list_transform({sections}, lambda s: {node} || '=' || s), ';')")


def _near_sql(a: str, b: str) -> str:
    def leaves(x):
        return f"list_distinct(list_filter(string_split(replace(replace({x}, '/', ','), ';', ','), ','), lambda y: y <> ''))"
    both = f"(len({leaves(a)}) + len({leaves(b)}))"
    return f"CASE WHEN {both} = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({leaves(a)}, {leaves(b)})) / {both} END"


SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
o AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS nx FROM d),
e AS (SELECT *, length(t)::BIGINT AS n_chars,
  substring(t, 1, length(t) - length(t) // 4) || substring(nx, 1, length(t) // 4) AS edited FROM o),
f AS (SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, {_body_sql('t')} AS b, {_body_sql('edited')} AS eb,
  {_body_sql('nx')} AS nb FROM e)
SELECT doc_id, n_chars, edited_sha256, {_root_sql('b')} AS fingerprint, {_root_sql('eb')} AS edited_fingerprint,
  {_near_sql('b', 'eb')} AS near_edited, {_near_sql('b', 'nb')} AS near_next FROM f"""
