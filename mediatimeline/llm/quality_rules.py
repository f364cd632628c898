"""Quality rules by compression: repetitive and incompressible texts fall outside bands that depend on length."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediatimeline.llm.common import by_bytes, giving_back, ids_and_texts, whole_rows
from mediatimeline.session import ship

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
INF = float("inf")

# Lowest and highest gain by log2 of the characters, straight lines between and the last one carried on. Gain is the
# compressed size of the characters in random order over that of the text: 1 for text without structure, whatever its
# alphabet. Random letters, hex and base64 lie within 0.985 and 1.015; prose from 1,024 characters on lies above, and overlaps
# them below. Help texts and licenses reach 1.9 at 512 characters and 2.1 at 32,768; text said again and again starts at 2.1 at
# 256 characters and 3.0 at 1,024.
BANDS = ((8, 0.90, 1.8), (9, 0.91, 2.1), (9.95, 0.97, 2.15), (10, 1.018, 2.15), (11, 1.04, 2.2), (12, 1.06, 2.3), (13, 1.09, 2.4),
         (14, 1.10, 2.5), (15, 1.10, 2.7), (16, 1.10, 2.9), (17, 1.10, 3.1))
LEAST_RATIO = ((8, 1.05), (9, 1.30))  # raw / compressed bytes by log2 of the bytes: base64 is told by it below 1,024 characters
MOST_SYMBOLS = 0.3  # SYMBOLS per word that `good_documents` allows: a rule of its own, as text full of them compresses like prose
CHUNK_CHARS = 4096
BAD_CHUNK_SHARE = 0.34

FIELDS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
          ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("ratio", T.DoubleType()), ("gain", T.DoubleType()),
          ("n_chunks", T.LongType()), ("n_bad_chunks", T.LongType()), ("kept", T.BooleanType())]
ARROW = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]


def _limit(x: float, knots, column: int) -> float:
    return float(np.interp(x, [k[0] for k in knots], [k[column] for k in knots]))


def band(size: int, bands=BANDS) -> tuple[float, float]:
    """Lowest and highest allowed gain for a text of `size` characters; below the first knot every gain is allowed."""
    if size < 1 << bands[0][0]:
        return 0.0, INF
    x = log2(size)
    (before, _, under), (last, _, top) = bands[-2:]
    rising = (top - under) / (last - before) * max(0.0, x - last)
    return _limit(x, bands, 1), _limit(x, bands, 2) + rising


def narrow(text: str) -> np.ndarray:
    """The text with one number per character, one byte wide where it has at most 256 different ones, so that no script
    weighs more than another."""
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, places, counts = np.unique(codes, return_inverse=True, return_counts=True)
    rank = np.empty(len(kinds), np.uint32)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(kinds))
    return rank[places].astype(np.uint8 if len(kinds) <= 256 else np.uint16 if len(kinds) <= 65_536 else np.uint32)


def gain(text: str, compressor: zstandard.ZstdCompressor) -> float:
    """Compressed size of the characters in random order, always the same one, over the compressed size of the text."""
    if not text:
        return 0.0
    ordered = narrow(text)
    mixed = ordered.copy()
    np.random.default_rng(0).shuffle(mixed)
    return len(compressor.compress(mixed.tobytes())) / len(compressor.compress(ordered.tobytes()))


def outside(text: str, size: int, ratio: float, found: float, bands=BANDS) -> bool:
    """True if a text of `size` bytes has a gain beyond its limits, or a ratio below its own."""
    low, high = band(len(text), bands)
    return not low <= found <= high or size >= 1 << LEAST_RATIO[0][0] and ratio < _limit(log2(size), LEAST_RATIO, 1)


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window which the text has at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total, covered = 0, 0  # words before `covered` are counted
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def judge(text: str | None, compressor: zstandard.ZstdCompressor, bands=BANDS, chunk: int = CHUNK_CHARS,
          bad_share: float = BAD_CHUNK_SHARE) -> tuple:
    """The columns of FIELDS for one text. Beyond the base rules, the verdict is that of the compression bands alone."""
    text = text or ""
    raw = text.encode("utf-8")
    words = raw.split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    n_repeat = repeated_words(words)
    failed = n_words < 50 or 100 * n_repeat > 50 * n_words
    ratio, whole = 0.0, gain(text, compressor)
    if raw:
        ratio = len(raw) / len(compressor.compress(raw))
    n_chunks = n_bad = 0
    if len(text) > chunk:
        for start in range(0, len(text), chunk):
            piece = text[start:start + chunk]
            own = piece.encode("utf-8")
            n_chunks += 1
            n_bad += outside(piece, len(own), len(own) / len(compressor.compress(own)), gain(piece, compressor), bands)
    kept = not (failed or outside(text, len(raw), ratio, whole, bands) or n_bad > bad_share * n_chunks)
    return (n_words, word_chars, n_symbols, len(lines) - len(set(lines)), n_repeat, failed, ratio, whole, n_chunks, n_bad, kept)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands=BANDS, chunk: int = CHUNK_CHARS,
                  bad_share: float = BAD_CHUNK_SHARE, level: int = 3, rows_too: bool = False) -> DataFrame:
    """`id_col`, with `rows_too` the whole row as a struct, word and line counts, compression ratios and a verdict for every row.

    base_failed: under 50 words, or more than half of the words in repeated 3-word windows. kept: not base_failed, the
    gain and the zstandard ratio of the whole text within the limits for its length, and at most `bad_share` of its chunks of
    `chunk` characters (texts over one chunk only) outside the limits for theirs. Random letters, hex and base64 are caught from
    1,024 characters on, base64 from 512. Compression and counting are per row and read whole texts, so there is no
    shuffle, and memory is bounded by one Arrow batch and the longest text.

    A null text counts as empty: no words, base_failed. Ids may be null or repeated; every row comes out once. An empty
    table gives an empty result. Other columns are not read, or travel inside the struct, so their names can't clash.
    """
    ship(docs.sparkSession)
    rows = ids_and_texts(docs, id_col, text_col)
    if rows_too:
        rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), whole_rows(docs))
    schema = T.StructType([rows.schema["id"], *rows.schema.fields[2:], *[T.StructField(n, t) for n, t in FIELDS]])
    names = schema.names

    @giving_back
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=level)
        for batch in by_bytes(batches):
            found = [judge(text, compressor, bands, chunk, bad_share) for text in batch.column(1).to_pylist()]
            columns = [pa.array(values, kind) for values, kind in zip(zip(*found), ARROW)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *columns], names=names)

    return rows.mapInArrow(score, schema).withColumnRenamed("id", id_col)


def good_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_symbols: float = MOST_SYMBOLS, **options) -> DataFrame:
    """The rows of `docs`, with all their columns, that the rules keep and that have at most `most_symbols` of SYMBOLS a word.

    The second is a rule beside the compression bands, which cannot see symbols: pass infinity to leave it out. A null or empty
    text goes; equal rows stay or go together; an empty table gives an empty result.
    """
    judged = quality_rules(docs, id_col, text_col, rows_too=True, **options)
    return judged.where(F.col("kept") & (F.col("n_symbols") <= most_symbols * F.col("n_words"))).select("row.*")
