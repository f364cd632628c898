"""Language identification by a string kernel with Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediatimeline.llm.common import by_bytes, giving_back, hash_unit, whole_rows
from mediatimeline.session import ship

SAMPLE_ROWS = 4_000  # labelled texts that the fit uses, shared equally by the languages
LANDMARKS = 192
RIDGE = 1e-3
SIZES = (512, 2048, 8192)  # buckets for the presence of 1-, 2- and 3-grams
SLICE = 1 << 20  # characters of a text that are turned into n-grams at a time
ROWS = 256  # texts of one matrix product
UNKNOWN = "und"
LEAST_SCORE = 0.4  # under it no language claims a text
LEAST_LIKENESS = 0.54  # under it a text is unlike its language: hex stays under 0.52, held-out prose of the test tables over 0.7
COMMON = 0.01  # share of a language's texts that makes a bucket one of its own
FREE = 2  # n-grams that a text is granted, so that one odd n-gram doesn't decide on a word or two

_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def presence(text: str, row: np.ndarray) -> None:
    """Set the buckets of all n-grams of the text in `row`; letters in lower case, everything else in ASCII is a blank."""
    text = text.lower()
    longest = len(SIZES)
    for start in range(0, len(text), SLICE):
        codes = np.frombuffer(text[start:start + SLICE + longest - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        codes[(codes < 128) & ((codes < 97) | (codes > 122))] = 32
        mixed, offset = np.zeros(len(codes), np.uint64), 0
        for n, size in enumerate(SIZES):
            if len(codes) <= n:
                break
            mixed = mixed[:len(codes) - n] * np.uint64(1_000_003) + codes[n:]
            bucket = (mixed + np.uint64(1)) * _STEP[n] >> np.uint64(40)
            row[offset + (bucket % np.uint64(size)).astype(np.int64)] = 1
            offset += size


def kernel_rows(present: np.ndarray) -> np.ndarray:
    """Scale presence rows so that their dot product is the blended kernel: per n the common buckets over the geometric mean
    of both counts, averaged over n."""
    scaled, offset = present.astype(np.float32), 0
    for size in SIZES:
        block = scaled[:, offset:offset + size]
        block /= np.sqrt(np.maximum(block.sum(axis=1, keepdims=True), 1) * len(SIZES))
        offset += size
    return scaled


@dataclass(frozen=True)
class Model:
    """Languages in order, landmarks as kernel rows, one column of weights and one row of common buckets per language, and
    the least likeness of a text to its language."""

    languages: tuple[str, ...]
    landmarks: np.ndarray
    weights: np.ndarray
    common: np.ndarray
    floor: float

    def scores(self, present: np.ndarray) -> np.ndarray:
        return kernel_rows(present) @ self.landmarks.T @ self.weights

    def like(self, present: np.ndarray, best: np.ndarray) -> np.ndarray:
        """True for the rows that are like the language `best` of theirs."""
        return likeness(present, self.common)[np.arange(len(best)), best] >= self.floor


def likeness(present: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Share of each row's buckets that a language has too, one column per language, averaged over 2- and 3-grams.

    The kernel alone doesn't tell this: weights have no bias, so a text that resembles nothing scores near one half.
    """
    found, offset = np.zeros((len(present), len(common)), np.float32), SIZES[0]
    for size in SIZES[1:]:
        theirs = common[:, offset:offset + size].T.astype(np.float32)
        for start in range(0, len(present), ROWS):
            block = present[start:start + ROWS, offset:offset + size].astype(np.float32)
            found[start:start + ROWS] += (block @ theirs + FREE) / (block.sum(axis=1, keepdims=True) + FREE)
        offset += size
    return found / len(SIZES[1:])


def common_buckets(present: np.ndarray, labels: np.ndarray, count: int) -> np.ndarray:
    """Per language, the buckets that at least COMMON of its rows have."""
    found = np.zeros((count, present.shape[1]), bool)
    for k in range(count):
        own = present[labels == k]
        if len(own):
            found[k] = own.sum(axis=0, dtype=np.int64) >= max(1.0, COMMON * len(own))
    return found


def least_likeness(present: np.ndarray, labels: np.ndarray, count: int) -> float:
    """LEAST_LIKENESS, or less where labelled rows, judged by the others, would fall under it: a small sample knows few n-grams."""
    half = np.arange(len(labels)) % 2
    own = [likeness(present[half == h], common_buckets(present[half != h], labels[half != h], count))[np.arange((half == h).sum()), labels[half == h]]
           for h in (0, 1)]
    return min(LEAST_LIKENESS, float(np.quantile(np.concatenate(own), 0.01)))


def solve(languages: list[str], present: np.ndarray, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fit on labelled presence rows: landmarks in turn from every language, at least one from each, one-versus-rest targets of
    -1 and 1. Kernel rows are made and added up ROWS at a time, so the driver never holds them all."""
    names = tuple(sorted(set(languages)))
    labels = np.array([names.index(x) for x in languages])
    turn = np.empty(len(labels), np.int64)
    for k in range(len(names)):
        own = labels == k
        turn[own] = np.arange(own.sum())
    chosen = np.lexsort((labels, turn))[:max(landmarks, len(names))]
    marks = kernel_rows(present[chosen])
    among = (marks @ marks.T).astype(np.float64)
    left = ridge * len(present) * among + 1e-6 * np.eye(len(marks))
    right = np.zeros((len(marks), len(names)))
    for start in range(0, len(present), ROWS):
        across = (kernel_rows(present[start:start + ROWS]) @ marks.T).astype(np.float64)
        left += across.T @ across
        right += across.T @ np.where(labels[start:start + ROWS, None] == np.arange(len(names)), 1.0, -1.0)
    weights = np.linalg.solve(left, right).astype(np.float32)
    return Model(names, marks, weights, common_buckets(present, labels, len(names)), least_likeness(present, labels, len(names)))


def held_out(docs: DataFrame, id_col: str, folds: int = 5) -> Column:
    """True for the rows that the fit never sees; a null id counts as the empty text."""
    return F.crc32(F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS,
        landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model | None:
    """Model from a bounded sample of labelled rows outside the held-out fold; None without any.

    Languages are counted over all rows; each then gives rows with the chance that makes its part of `sample_rows`. Only
    presence bits of the sampled texts, 1.3 kB each, come to the driver.
    """
    ship(docs.sparkSession)
    text, lang = docs[text_col].cast("string"), docs[lang_col].cast("string")
    rows = docs.where(~held_out(docs, id_col)).select(text.alias("text"), lang.alias("lang"), hash_unit(docs[id_col], text).alias("draw"))
    rows = rows.where("lang is not null and text is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = sample_rows / len(counts)
    chance = F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, share / n))]), F.col("lang"))
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("draw", T.DoubleType()), T.StructField("bits", T.BinaryType())])
    width = sum(SIZES)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, column=0):
            found = []
            for text, lang, draw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if has_letter(text):
                    row = np.zeros(width, np.uint8)
                    presence(text, row)
                    found.append((lang, draw, np.packbits(row).tobytes()))
            if found:
                kinds = [pa.string(), pa.float64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=schema.names)

    sample = sorted((r.lang, r.draw, bytes(r.bits)) for r in rows.where(F.col("draw") < chance).mapInArrow(run, schema).collect())
    if not sample:
        return None
    present = np.unpackbits(np.frombuffer(b"".join(bits for _, _, bits in sample), np.uint8).reshape(len(sample), -1), axis=1)[:, :width]
    return solve([lang for lang, _, _ in sample], present, landmarks, ridge)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, lang_pred and score of every row, from its text alone.

    The kernel values of a batch of texts with the landmarks are one matrix product, their weighting a second. score is the
    winner's value, from -1 and 1 moved to 0 and 1; it is 0 for a text that is unlike its language, such as one in a script that
    was not learned, hex or random letters. A text that is null or has no letter, or any text without a model, is
    `und` with score 0.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # at most LANDMARKS * sum(SIZES) floats, whatever the input
    rows = docs.select(docs[text_col].cast("string").alias("text"), *[docs[c] for c in keep])
    schema = T.StructType([*[rows.schema[i + 1] for i in range(len(keep))], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        present = np.zeros((ROWS, sum(SIZES)), np.uint8)
        for batch in by_bytes(batches, column=0):
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                texts = part.column(0).to_pylist()
                known = [own is not None and has_letter(text) for text in texts]
                present[:len(texts)] = 0
                for i, text in enumerate(texts):
                    if known[i]:
                        presence(text, present[i])
                names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if any(known):
                    values = own.scores(present[:len(texts)])
                    best = values.argmax(axis=1)
                    top = np.clip((values[np.arange(len(texts)), best].astype(np.float64) + 1) / 2, 0, 1)
                    top[~own.like(present[:len(texts)], best)] = 0.0
                    names = [own.languages[k] if ok else UNKNOWN for k, ok in zip(best, known)]
                    scores = np.where(known, top, 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                                 names=schema.names)

    return rows.mapInArrow(run, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fit_options) -> DataFrame:
    """`id_col`, held_out, lang_pred and score of every row, by a model that learned from the rows of the other folds.

    The fit sees text and non-null language of a bounded sample; a prediction sees the text only. Ids may be null or
    repeated, every row comes out once. Without labelled rows all are `und`. An empty table gives an empty result. Columns not
    named are not read. Reruns give the same model, up to the order of floating-point sums inside a matrix product.
    """
    model = fit(docs, id_col, text_col, lang_col, **fit_options)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), held_out(docs, id_col).alias("held_out"))
    found = identify(rows, model, "text", ("id", "held_out"))
    return found.withColumnRenamed("id", id_col)


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_score: float = LEAST_SCORE,
               **fit_options) -> DataFrame:
    """The rows of `docs` whose text has a language: not `und`, and a score of at least `least_score`."""
    model = fit(docs, id_col, text_col, lang_col, **fit_options)
    rows = docs.select(docs[text_col].alias("text"), whole_rows(docs))
    found = identify(rows, model, "text", ("row",))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score)).select("row.*")
