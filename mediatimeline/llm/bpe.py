"""Byte-level BPE as a tree reduction: halves are encoded apart and joined by encoding a window around the seam again."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mediatimeline.llm.common import by_bytes, giving_back, ids_and_texts, safe_units, vocabulary
from mediatimeline.session import ship

LEAF_CHARS = 512
CACHE_UNITS = 200_000
LONG_UNIT = 200  # characters; longer units are not cached

_loaded: dict[int, "Codec"] = {}


Part = tuple[list[str], list[tuple[list[int], str]]]  # units, and of each its ids and the same ids as text


class Codec:
    """Encodes and decodes texts by the ranks of one file.

    A part of a text is encoded as units, strings between boundaries that no token spans whatever stands around them
    (see `safe_units`), so the tokens of a unit depend on the unit alone. A part of one document is an element of a monoid:
    `join` is associative, and the empty part is its neutral element.
    """

    def __init__(self, ranks: bytes, pattern: str):
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.bytes_of = {rank: token for token, rank in table.items()}
        self.cache: dict[str, tuple[list[int], str]] = {}

    def part(self, text: str, start: int, end: int, leaf: int) -> Part:
        """Encode text[start:end]: both halves by themselves, then the seam."""
        if end - start <= leaf:
            units = safe_units(text[start:end]) if end > start else []
            return units, [self.tokens(unit) for unit in units]
        middle = (start + end) // 2
        return self.join(self.part(text, start, middle, leaf), self.part(text, middle, end, leaf))

    def join(self, left: Part, right: Part) -> Part:
        """Encode a window around the seam again, widened until the boundaries at both of its ends are certain.

        A boundary is certain if the character before it is not white space and the one behind it is a space. Inside the
        window boundaries and tokens are found anew; outside it none can change.
        """
        (units, tokens), (more, more_tokens) = left, right
        if not units or not more:
            return left if units else right
        i = j = 1
        while i < len(units) and not _certain(units[-i - 1], units[-i]):
            i = min(len(units), 2 * i)
        while j < len(more) and not _certain(more[j - 1], more[j]):
            j = min(len(more), 2 * j)
        window = safe_units("".join(units[-i:]) + "".join(more[:j]))
        units[-i:] = window
        tokens[-i:] = [self.tokens(unit) for unit in window]
        units += more[j:]
        tokens += more_tokens[j:]
        return left

    def tokens(self, unit: str) -> tuple[list[int], str]:
        found = self.cache.get(unit)
        if found is None:
            ids = self.encoding.encode_ordinary(unit)
            found = (ids, ",".join(map(str, ids)))
            if len(unit) <= LONG_UNIT:
                if len(self.cache) >= CACHE_UNITS:
                    self.cache.clear()
                self.cache[unit] = found
        return found

    def encode(self, text: str, leaf: int = LEAF_CHARS) -> list[tuple[list[int], str]]:
        """Per unit of the text, its ids and the same ids as text."""
        return self.part(text, 0, len(text), leaf)[1]

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids, halves first."""
        if len(ids) <= 4096:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def _certain(before: str, behind: str) -> bool:
    return behind[0] == " " and not before[-1].isspace()


def codec(data: bytes, pattern: str) -> Codec:
    """The codec of this worker process, made once per vocabulary."""
    key = hash((data, pattern))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Codec(data, pattern)
    return _loaded[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF_CHARS,
           digest: bool = False) -> DataFrame:
    """`id_col`, n_tokens and ids (array of int) of every row; with `digest` instead of ids, ids_sha256 and decoded_sha256.

    Ids are those of the rank file's library without special tokens: each match of `pattern` is merged by itself. The text
    is halved until parts have `leaf` characters, and parts are joined by encoding a window around each seam again. The
    digest form decodes the ids and hashes the bytes, so a round trip is checked over whole texts while only hashes leave
    the task. There is no shuffle; memory is bounded by one Arrow batch and the longest text.

    A null text counts as empty: 0 tokens, empty ids, hashes of the empty string. Ids of rows may be null or repeated, every
    row comes out once. An empty table gives an empty result. Other columns are not read, so their names can't clash.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = vocabulary(spark, ranks_path)
    rows = ids_and_texts(docs, id_col, text_col)
    more = [("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())] if digest else [("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([rows.schema["id"], T.StructField("n_tokens", T.LongType()), *[T.StructField(n, t) for n, t in more]])
    names = schema.names

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in by_bytes(batches, 1 << 20):
            counts, first, second = [], [], []
            for text in batch.column(1).to_pylist():
                units = own.encode(text or "", leaf)
                ids = [i for unit, _ in units for i in unit]
                counts.append(len(ids))
                if digest:
                    first.append(hashlib.sha256(",".join([s for _, s in units]).encode()).hexdigest())
                    second.append(hashlib.sha256(own.decode(ids)).hexdigest())
                else:
                    first.append(ids)
            kinds = [pa.string(), pa.string()] if digest else [pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), *[pa.array(v, k) for v, k in zip((first, second), kinds)]], names=names)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(rows: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """`id_col` and text of rows with token ids; bytes that are no UTF-8 become the replacement character, null ids null."""
    spark = rows.sparkSession
    ship(spark)
    shared = vocabulary(spark, ranks_path)
    chosen = rows.select(rows[id_col].alias("id"), rows[ids_col].alias("ids"))
    schema = T.StructType([chosen.schema["id"], T.StructField("text", T.StringType())])

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern)
        for batch in batches:
            texts = [None if ids is None else own.decode(ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return chosen.mapInArrow(run, schema).withColumnRenamed("id", id_col)
