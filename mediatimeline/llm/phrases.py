"""Phrases that occur together more often than their parts, from counts in depth-truncated suffix trees.

The corpus is one string of words with breaks between pieces. As in ERA (Mansour et al., 2011) its suffix tree is cut
vertically: prefixes are dealt into groups that fit a memory budget, every group builds the subtrees of its prefixes on its
own, here to a depth of `longest` words, and the number of leaves below a node is its phrase's count.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mediatimeline.llm.common import by_bytes
from mediatimeline.session import settle, ship

LEAST = 30  # occurrences of a candidate
LONGEST = 4  # words of a candidate
TOP = 2_000  # phrases a language
CONTAINED = (80, 100)  # a candidate goes if a longer one around it has this share of its occurrences
BUDGET = 3_000_000  # suffixes in one group
BATCH_WORDS = 2_000_000  # suffixes that a task gathers before it deals them out
COUNTED_WORDS = 800_000  # distinct words that a task counts before it hands them on
KNOWN_WORDS = 600_000  # words whose numbers a task remembers
FILTER_BITS = 26  # the set of frequent words is sent to tasks as 2^26 bits (8 MB), whatever their number
SALTS = 32

BREAK, SKIP = 0, 1
_SPLITS = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")


def by_language(batch: pa.RecordBatch) -> dict[str, bytes]:
    """Texts of each language as words between spaces, with a line end at every border of a piece. Only A-Z is lowered."""
    found: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        if text:
            found.setdefault(lang, []).append(text.encode("utf-8").lower().translate(_SPLITS))
    return {lang: b"\n".join(texts) for lang, texts in found.items()}


def number(lang: str, word: bytes, seed: int) -> int:
    """64 bits for a word of a language; 0 and 1 are taken. Two words with one number are found out in `vocabulary_of`."""
    return max(2, xxhash.xxh64_intdigest(lang.encode("utf-8") + b"\n" + word, seed))


def word_counts(texts: DataFrame, seed: int) -> DataFrame:
    """h (number), lang, word and f of all words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def rows() -> pa.RecordBatch:
            flat = [(lang, word, n) for lang, words in counts.items() for word, n in words.items() if word not in (b"", b"\n")]
            numbers = np.array([number(lang, word, seed) for lang, word, _ in flat], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([r[0] for r in flat], pa.string()),
                                               pa.array([r[1].decode("utf-8") for r in flat], pa.string()),
                                               pa.array([r[2] for r in flat], pa.int64())], names=["h", "lang", "word", "f"])

        for batch in by_bytes(batches):
            for lang, text in by_language(batch).items():
                counts.setdefault(lang, Counter()).update(text.replace(b"\n", b" \n ").split(b" "))
            if sum(map(len, counts.values())) > COUNTED_WORDS:
                yield rows()
                counts.clear()
        yield rows()

    counted = texts.mapInArrow(count, "h long, lang string, word string, f long")
    return counted.groupBy("lang", "word").agg(F.any_value("h").alias("h"), F.sum("f").alias("f"))


def vocabulary_of(texts: DataFrame) -> tuple[DataFrame, int]:
    """Words with their numbers and counts, written once, and the seed under which no two words share a number."""
    for _ in range(8):
        seed = int.from_bytes(os.urandom(4), "little")
        words = settle(word_counts(texts, seed))
        if not words.groupBy("h").count().where("count > 1").limit(1).count():
            return words, seed
    raise RuntimeError("words share numbers under eight seeds")


def frequent_bits(words: DataFrame, least: int) -> np.ndarray:
    """The set of words that occur `least` times or more, as FILTER_BITS bits: it may let others in, it leaves none out."""
    slot = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    bits = words.where(F.col("f") >= least).groupBy(F.shiftright(slot, 6).cast("int").alias("at")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - FILTER_BITS}) & 63 AS int))")).alias("bits")).toArrow()
    found = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    found[bits.column(0).to_numpy()] = bits.column(1).to_numpy().view(np.uint64)
    return found


class Numbers(dict):
    """Words of a language as small numbers of this task; words that are surely not frequent are breaks."""

    def __init__(self, lang: str, seed: int, bits: np.ndarray, hashes: list[int]):
        super().__init__({b"": SKIP, b"\n": BREAK})
        self.lang, self.seed, self.bits, self.hashes = lang, seed, bits, hashes

    def __missing__(self, word: bytes) -> int:
        h = number(self.lang, word, self.seed)
        slot = h >> (64 - FILTER_BITS)
        if int(self.bits[slot >> 6]) >> (slot & 63) & 1:
            self.hashes.append(h)
            self[word] = len(self.hashes) - 1
        else:
            self[word] = BREAK
        return self[word]


def mix(*parts: np.ndarray) -> np.ndarray:
    out = np.full(len(parts[0]), 0x9E3779B97F4A7C15, np.uint64)
    for p in parts:
        out = (out ^ p) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(29)
    return out


def suffixes(words: np.ndarray, longest: int) -> np.ndarray:
    """A row of `longest` words for every place, cut at the first break (0 from there on); rows of one word are left out."""
    padded = np.concatenate([words, np.zeros(longest, words.dtype)])
    rows = np.stack([padded[i:i + len(words)] for i in range(longest)], axis=1)
    for i in range(1, longest):
        rows[rows[:, i - 1] == BREAK, i] = BREAK
    return rows[rows[:, 1] != BREAK]


def summed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in sorted order, with the sums of their counts."""
    if not len(rows):
        return rows, counts
    order = np.lexsort(rows.T[::-1])
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
    return rows[first], np.add.reduceat(counts[order], first)


def prefix_groups(rows: np.ndarray, counts: np.ndarray, hashes: np.ndarray, heavy: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(depth, group of each row, rows, counts). Depth 0: whole suffixes, by their first word; their subtrees have all nodes
    below it. Prefixes that begin with a heavy word don't fit a group, so they are extended down to single nodes: for
    each depth the rows are cut there, added up, and dealt by all their words."""
    heavy_first = np.isin(hashes[rows[:, 0]], heavy)
    light, n = rows[~heavy_first], counts[~heavy_first]
    yield 0, (mix(hashes[light[:, 0]]) % np.uint64(groups)).astype(np.int64), light, n
    rows, counts = rows[heavy_first], counts[heavy_first]
    for depth in range(2, rows.shape[1] + 1):
        deep = rows[:, depth - 1] != BREAK
        cut, n = rows[deep].copy(), counts[deep]
        cut[:, depth:] = BREAK
        cut, n = summed(cut, n)
        yield depth, (mix(*[hashes[cut[:, i]] for i in range(depth)]) % np.uint64(groups)).astype(np.int64), cut, n


def squeeze(rows: np.ndarray, counts: np.ndarray, hashes: np.ndarray, zip_: zstandard.ZstdCompressor) -> tuple[bytes, bytes, bytes]:
    """Numbers of the words in use, rows as places among them, counts: each as bytes."""
    used, places = np.unique(rows, return_inverse=True)
    kind = np.uint16 if len(used) <= 1 << 16 else np.uint32
    return hashes[used].tobytes(), zip_.compress(places.reshape(rows.shape).T.astype(kind).tobytes()), zip_.compress(counts.astype(np.uint32).tobytes())


def dealt_suffixes(texts: DataFrame, seed: int, bits, heavy: list[int], groups: int, longest: int) -> DataFrame:
    """part (group), depth, words, rows, counts: the suffixes of the corpus, added up and dealt to the groups of their prefixes."""
    heavy_set = np.array(heavy, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        hashes: list[int] = [0, 0]
        numbers: dict[str, Numbers] = {}
        waiting: list[np.ndarray] = []

        def deal() -> Iterator[pa.RecordBatch]:
            table = np.array(hashes, np.uint64)
            rows = suffixes(np.concatenate(waiting), longest)
            rows, counts = summed(rows, np.ones(len(rows), np.int64))
            for depth, group, part, n in prefix_groups(rows, counts, table, heavy_set, groups):
                order = np.argsort(group, kind="stable")
                group, part, n = group[order], part[order], n[order]
                edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else [0]
                for a, b in zip(edges[:-1], edges[1:]):
                    blobs = squeeze(part[a:b], n[a:b], table, zip_)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([group[a]], pa.int64()), pa.array([depth], pa.int32()), *[pa.array([x], pa.binary()) for x in blobs]],
                        names=["part", "depth", "words", "rows", "counts"])

        for batch in by_bytes(batches):
            for lang, text in by_language(batch).items():
                known = numbers.setdefault(lang, Numbers(lang, seed, bits.value, hashes))
                tokens = text.replace(b"\n", b" \n ").split(b" ")
                found = np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens))
                waiting += [found[found != SKIP], np.zeros(1, np.int32)]
            if sum(map(len, waiting)) > BATCH_WORDS:
                yield from deal()
                waiting.clear()
                if len(hashes) > KNOWN_WORDS:
                    numbers.clear()
                    del hashes[2:]
        if waiting:
            yield from deal()

    return texts.mapInArrow(run, "part long, depth int, words binary, rows binary, counts binary")


def subtree(depth: int, rows: np.ndarray, counts: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes of two words or more with `least` leaves or more below them: their words and the leaves' total.

    The sorted suffixes are the tree's leaves from left to right; a node of depth d is a run of leaves that share d words.
    """
    rows, counts = summed(rows, counts)
    for d in range(2, rows.shape[1] + 1) if depth == 0 else [depth]:
        leaves = rows[:, d - 1] != BREAK
        under, n = rows[leaves, :d], counts[leaves]
        if len(under):
            first = np.flatnonzero(np.concatenate([[True], (under[1:] != under[:-1]).any(axis=1)]))
            total = np.add.reduceat(n, first)
            often = total >= least
            yield under[first][often], total[often]


def phrase_counts(texts: DataFrame, least: int = LEAST, longest: int = LONGEST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(phrases, words): `key` (numbers of the words) and f of all phrases of two to `longest` words that occur `least` times
    or more; h, lang, word and f of all words. texts: lang and text.

    Groups number total / `budget`. A word with over half of the budget is heavy; there are fewer than two a group, so the
    list sent to tasks is bounded by the number of groups. What a task has gathered is added up before it is dealt.
    """
    spark = texts.sparkSession
    ship(spark)
    words, seed = vocabulary_of(texts)
    total = words.agg(F.sum("f")).first()[0] or 0
    groups = max(1, -(-total // budget))
    heavy = [r.h % (1 << 64) for r in words.where(F.col("f") > budget // 2).select("h").collect()]
    bits = spark.sparkContext.broadcast(frequent_bits(words, least))
    dealt = dealt_suffixes(texts, seed, bits, heavy, groups, longest)

    def build(key: tuple, table: pa.Table) -> pa.Table:
        unzip = zstandard.ZstdDecompressor()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for depth in set(table.column("depth").to_pylist()):
            mine = table.filter(pa.compute.equal(table.column("depth"), depth))
            blobs = []
            for w, r, c in zip(*(mine.column(n).to_pylist() for n in ("words", "rows", "counts"))):
                numbers = np.frombuffer(w, np.uint64)
                kind = np.uint16 if len(numbers) <= 1 << 16 else np.uint32
                blobs.append((numbers, np.frombuffer(unzip.decompress(r), kind).reshape(longest, -1), np.frombuffer(unzip.decompress(c), np.uint32)))
            known = np.unique(np.concatenate([b[0] for b in blobs] + [np.zeros(1, np.uint64)]))  # 0, the break, comes first
            rows = np.concatenate([np.searchsorted(known, b[0]).astype(np.int32)[b[1]].T for b in blobs])
            counts = np.concatenate([b[2] for b in blobs]).astype(np.int64)
            found += [(known[nodes], n) for nodes, n in subtree(depth, rows, counts, least)]
        keys = [row.view(np.int64).tolist() for nodes, _ in found for row in nodes]
        return pa.table({"key": pa.array(keys, pa.list_(pa.int64())), "f": pa.array([int(x) for _, n in found for x in n], pa.int64())})

    phrases = dealt.groupBy("part").applyInArrow(build, "key array<long>, f long")
    return settle(phrases), words


def big(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """key, a, l, r and score of every phrase: of the cut with the lowest score, ties to the one after fewest words."""
    counts = phrases.select("key", "f").union(words.select(F.array("h"), "f"))
    k = F.explode(F.sequence(F.lit(1), F.size("key") - 1))
    cuts = phrases.select("key", F.col("f").alias("a"), k.alias("k"))
    halves = cuts.select("key", "a", "k", F.explode(F.array(
        F.struct(F.lit(True).alias("left"), F.slice("key", 1, F.col("k")).alias("half")),
        F.struct(F.lit(False).alias("left"), F.slice("key", F.col("k") + 1, F.size("key")).alias("half")))).alias("h"))
    met = halves.select("key", "a", "k", "h.left", "h.half").join(counts.withColumnRenamed("key", "half"), "half")
    per_cut = met.groupBy("key", "k").agg(F.first("a").alias("a"), F.max(F.when(F.col("left"), F.col("f"))).alias("l"),
                                          F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    score = F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * big(F.col("a")), big(F.col("l")) + big(F.col("r")))
    lowest = per_cut.groupBy("key").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    return lowest.select("key", "a", "cut.l", "cut.r", "cut.score")


def not_contained(phrases: DataFrame, share: tuple[int, int] = CONTAINED) -> DataFrame:
    """key of the phrases that no longer one with `share` of their occurrences has inside."""
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("key") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.size("key") - n + 1), lambda start: F.slice("key", start, n))))
    around = phrases.where(F.size("key") > 2).select(F.explode(inner).alias("key"), "f").groupBy("key").agg(F.max("f").alias("longer"))
    kept = phrases.join(around, "key", "left").where(
        F.col("longer").isNull() | (big(F.col("longer")) * share[1] < big(F.col("f")) * share[0]))
    return kept.select("key")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, budget: int = BUDGET,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the `top` phrases of each language.

    Score: 2,000,000 times the phrase's count over the sum of its parts' counts, of the worst of its cuts into two parts.
    Phrases are contiguous inside pieces. Everything is counted over the whole table; numbers are exact, products are
    decimals. Words travel as 64-bit numbers that are checked to differ.

    A null language is `und`. Null and empty texts have no words; an empty table gives an empty result; repeated rows count
    again. Equal scores and counts are ordered by the phrase's bytes. Other columns are not read.
    """
    texts = docs.select(F.coalesce(docs[lang_col].cast("string"), F.lit("und")).alias("lang"), docs[text_col].cast("string").alias("text"))
    phrases, words = phrase_counts(texts, least, longest, budget)
    rated = scored(phrases, words).join(not_contained(phrases), "key")
    spelled = rated.select("*", F.posexplode("key").alias("at", "h")).join(words.select("h", "lang", "word"), "h")
    texted = spelled.groupBy("key").agg(
        F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"),
        *[F.first(c).alias(c) for c in ("a", "l", "r", "score")])
    named = texted.select("lang", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase"), "a", "l", "r", "score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = named.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def sql(least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> str:
    """The same for DuckDB, over the table documents."""
    grams = " UNION ALL ".join(
        f"SELECT lang, w[i:i + {n - 1}] AS p FROM (SELECT lang, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM pieces WHERE len(w) >= {n})"
        for n in range(1, longest + 1))
    return f"""
WITH pieces AS MATERIALIZED (
  SELECT lang, [x FOR x IN regexp_split_to_array(piece, '[ \\t]+') IF x <> ''] AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\f\\r]')) AS piece FROM documents)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, p, count(*) AS f FROM ({grams}) GROUP BY lang, p HAVING count(*) >= {least}),
cand AS MATERIALIZED (SELECT * FROM counts WHERE len(p) > 1),
cuts AS (SELECT lang, p, f AS a, unnest(range(1, len(p))) AS k FROM cand),
halves AS (
  SELECT c.lang, c.p, a, k, x.f AS l, y.f AS r, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score FROM cuts c
  JOIN counts x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN counts y ON y.lang = c.lang AND y.p = c.p[k + 1:]),
rated AS (SELECT lang, p, min((score, k, a, l, r)) AS m FROM halves GROUP BY lang, p),
inner_phrases AS (
  SELECT lang, p[i:i + n - 1] AS p, max(f) AS longer FROM (
    SELECT lang, p, f, n, unnest(range(1, len(p) - n + 2)) AS i FROM (SELECT lang, p, f, unnest(range(2, len(p))) AS n FROM cand WHERE len(p) > 2))
  GROUP BY ALL),
kept AS (
  SELECT r.lang, array_to_string(r.p, ' ') AS phrase, m[3] AS a, m[4] AS l, m[5] AS r, m[1] AS score FROM rated r
  LEFT JOIN inner_phrases i ON i.lang = r.lang AND i.p = r.p WHERE longer IS NULL OR {CONTAINED[1]}::HUGEINT * longer < {CONTAINED[0]}::HUGEINT * m[3])
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
  FROM kept JOIN totals USING (lang)) WHERE rank <= {top}"""
