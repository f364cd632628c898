"""Token counts of whole texts, without keeping any token."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mediatimeline.llm.common import BATCH_BYTES, by_bytes, ids_and_texts, safe_units, vocabulary
from mediatimeline.session import ship

CACHE_UNITS = 300_000
LONG_UNIT = 400  # characters; longer units are rare and are not cached

_loaded: dict[int, tuple] = {}


def _tokenizer(data: bytes) -> tuple:
    """The tokenizer of this worker process and its cache, made once per vocabulary."""
    key = hash(data)
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(data.decode("utf-8"))
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded.clear()
        _loaded[key] = (tokenizer, {})
    return _loaded[key]


def count_batch(tokenizer, cache: dict[str, int], texts: list[str | None]) -> list[int]:
    """Tokens of each text: distinct units between safe boundaries are encoded in one batch, their lengths are added up."""
    parts = [safe_units(text) if text else [] for text in texts]
    fresh: set[str] = set()
    for units in parts:
        fresh.update(units)
    fresh.difference_update(cache)
    if len(cache) + len(fresh) > CACHE_UNITS:
        keep = {unit for units in parts for unit in units} - fresh
        cache_now = {unit: cache[unit] for unit in keep}
        cache.clear()
        cache.update(cache_now)
    wanted = list(fresh)
    lengths = dict(zip(wanted, (len(e) for e in tokenizer.encode_batch_fast(wanted, add_special_tokens=False))))
    long_ones = {unit: n for unit, n in lengths.items() if len(unit) > LONG_UNIT}
    cache.update(lengths)
    counts = [sum(map(cache.__getitem__, units)) for units in parts]
    for unit in long_ones:
        del cache[unit]
    return counts


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024,
                 batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """`id_col`, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    The file is a `tokenizers` vocabulary (.json) whose splitter is the byte-level one; it is sent to the executors as
    bytes of a checked size. Begin, end and other added special tokens are not counted, special strings inside texts are
    read as the library reads them by default, nothing is truncated or padded. Each task reads Arrow batches, cuts them
    to `batch_bytes` of text, and returns lengths only. No shuffle, so neither hot keys nor lost executors matter.

    Null and empty texts have 0 bytes and 0 tokens. Ids may be null or repeated: a row comes out for every row that goes
    in. An empty table gives an empty result. Other columns are not read, so their names can't clash.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = vocabulary(spark, tokenizer_path)
    rows = ids_and_texts(docs, id_col, text_col)
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, cache = _tokenizer(shared.value)
        for batch in by_bytes(batches, batch_bytes):
            texts = batch.column(1).to_pylist()
            counts = count_batch(tokenizer, cache, texts)
            sizes = [len(text.encode("utf-8")) if text else 0 for text in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()),
                 pa.array([n > limit for n in counts], pa.bool_())], names=["id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(count, schema).withColumnRenamed("id", id_col)
