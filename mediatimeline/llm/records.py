"""Token sequences as length-delimited binary records, with a separate index of offsets for shuffled reads.

A record file is a row of frames: length of the payload (8 bytes), masked checksum of those 8 bytes (4), payload, masked
checksum of the payload (4). All numbers are little-endian. The checksum is CRC-32, rotated right by 15 bits plus a
constant, so that a file of frames is not its own checksum. A payload is the width of an id in bytes (1), the length of the
key (4; 2^32 - 1: null), the key in UTF-8, and the ids. The index has 16 bytes a record: offset of its frame and number of
ids before it in the file; one more entry closes it. The manifest lists the files in order; files it doesn't list don't count.
"""

from __future__ import annotations

import math
import os
import random
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mediatimeline.llm.common import by_bytes, ids_and_texts, vocabulary
from mediatimeline.session import ensure_checkpoint_dir, ship
from mediatimeline.sources import store

MASK_DELTA = 0xA282EAD8
NO_KEY = 0xFFFFFFFF
ENCODE_BYTES = 2 << 20
CACHE_PIECES = 400_000
LONG_PIECE = 200  # characters; longer pieces are rare and are not kept
READ_BYTES = 64 << 20  # of records in one read task
CHUNK_BYTES = 4 << 20  # read at once, and given on as one batch
OPEN_FILES = 64

WORD = r"^(?P<w>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<m>[!-&(-/:-@\[-`{-~]*)$"  # without the apostrophe, which opens contractions

_loaded: dict[int, tuple] = {}


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(data, at: int) -> tuple[bytes, int] | None:
    """Payload of the frame at `at` and the place after it; None if it reaches over the end of `data`."""
    if at + 12 > len(data):
        return None
    size, check = struct.unpack_from("<QI", data, at)
    if check != masked(bytes(data[at:at + 8])):
        raise ValueError(f"the length at {at} does not match its checksum")
    end = at + 12 + size
    if end + 4 > len(data):
        return None
    payload = bytes(data[at + 12:end])
    if struct.unpack_from("<I", data, end)[0] != masked(payload):
        raise ValueError(f"the record at {at} does not match its checksum")
    return payload, end + 4


def pack(key: str | None, ids: bytes, width: int) -> bytes:
    name = b"" if key is None else key.encode("utf-8")
    return b"".join((struct.pack("<BI", width, NO_KEY if key is None else len(name)), name, ids))


def unpack(payload: bytes) -> tuple[str | None, np.ndarray]:
    width, size = struct.unpack_from("<BI", payload)
    start = 5 + (0 if size == NO_KEY else size)
    return None if size == NO_KEY else payload[5:start].decode("utf-8"), np.frombuffer(payload, f"<u{width}", offset=start)


# Encoding

def _tokenizer(data: bytes, end_id: int) -> tuple:
    """Tokenizer of this worker process, bytes of an id, and the cache; made once per vocabulary."""
    key = hash((data, end_id))
    if key not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(data.decode("utf-8"))
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded.clear()
        _loaded[key] = (tokenizer, id_width(max(tokenizer.get_vocab_size(), end_id + 1)), {})
    return _loaded[key]


def id_width(ids: int) -> int:
    return 2 if ids <= 1 << 16 else 4


def known_ids(tokenizer, cache: dict[str, bytes], pieces: list[str], kind: np.dtype) -> list[bytes]:
    """Ids of each of distinct pieces as bytes; new ones are encoded in batches and remembered."""
    if len(cache) > CACHE_PIECES:
        cache.clear()
    found = [cache.get(piece) for piece in pieces]
    fresh = [i for i, ids in enumerate(found) if ids is None]
    for start in range(0, len(fresh), 10_000):
        some = fresh[start:start + 10_000]
        for i, e in zip(some, tokenizer.encode_batch_fast([pieces[i] for i in some], add_special_tokens=False)):
            found[i] = np.array(e.ids, kind).tobytes()
            if len(pieces[i]) <= LONG_PIECE:
                cache[pieces[i]] = found[i]
    return found


def encode_batch(tokenizer, cache: dict[str, bytes], texts: pa.Array, width: int, end: bytes) -> list[bytes]:
    """Ids of each text as bytes, with the end id.

    The splitters of vocabularies with word ends drop white space, and no match spans it, so the units between are encoded
    on their own. A unit of letters and ASCII marks after them is two matches of the splitter, and letters may be lowered
    first. Each distinct piece is encoded once; the texts are put together by place.
    """
    kind = np.dtype(f"<u{width}")
    plain = pc.fill_null(texts, "")
    for space in ("\n", "\t", "\r"):
        plain = pc.replace_substring(plain, space, " ")
    lists = pc.split_pattern(plain, " ")
    units = lists.flatten().dictionary_encode()
    word = pc.extract_regex(units.dictionary, WORD)
    first = pc.coalesce(pc.utf8_lower(pc.struct_field(word, "w")), units.dictionary)
    pieces = pa.concat_arrays([first, pc.fill_null(pc.struct_field(word, "m"), "")]).dictionary_encode()
    ids = known_ids(tokenizer, cache, pieces.dictionary.to_pylist(), kind)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // width
    at = np.cumsum(sizes) - sizes
    unit = units.indices.to_numpy(zero_copy_only=False)
    piece = pieces.indices.to_numpy(zero_copy_only=False).reshape(2, -1)[:, unit].T.ravel()
    lengths = sizes[piece]
    ends = np.cumsum(lengths)
    tokens = np.frombuffer(b"".join(ids), kind)[np.repeat(at[piece] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
    pieces_of = 2 * np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    stops = (np.where(pieces_of > 0, ends[pieces_of - 1], 0) * width if len(ends) else pieces_of).tolist()
    return [tokens[a:b] + end for a, b in zip([0, *stops[:-1]], stops)]


def encoder(shared, end_id: int, batch_bytes: int = ENCODE_BYTES):
    """Function from Arrow batches (key, text) to batches (key, ids, width): ids in little-endian, 2 bytes an id if they suffice
    for the vocabulary, else 4."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, width, cache = _tokenizer(shared.value, end_id)
        end = end_id.to_bytes(width, "little")
        for batch in by_bytes(batches, batch_bytes):
            found = encode_batch(tokenizer, cache, batch.column(1), width, end)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), pa.array([width] * len(found), pa.int32())],
                                             names=["key", "ids", "width"])

    return run


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key (the id as a string) and text in ascending order of the ids, nulls first; rows alike in id follow a hash of their texts.

    Texts are dealt by ranges of (id, hash, place in the input), so an id with very many rows spreads over tasks.
    """
    order = ["id", "tie", "place"]
    rows = ids_and_texts(docs, id_col, text_col).select("id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("id").cast("string").alias("key"), "text")


# Files

WRITTEN = "partition int, name string, records long, tokens long, size long"


def write_part(path: str, batches: Iterator[pa.RecordBatch]) -> pa.RecordBatch:
    """Write the batches (key, ids, width) of this task as one file and its index; what the manifest must know of them."""
    fs, root = store.at(path)
    fs.create_dir(root)
    partition = TaskContext.get().partitionId()
    name = store.new_name("part", partition)
    records = tokens = size = 0
    try:
        with fs.open_output_stream(f"{root}/{name}.rec") as out, fs.open_output_stream(f"{root}/{name}.idx") as index:
            for batch in batches:
                entries = []
                for key, ids, width in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    entries.append(struct.pack("<QQ", size, tokens))
                    framed = frame(pack(key, ids, width))
                    out.write(framed)
                    size += len(framed)
                    tokens += len(ids) // width
                records += len(entries)
                index.write(b"".join(entries))
            index.write(struct.pack("<QQ", size, tokens))
    except BaseException:
        store.remove(fs, [f"{root}/{name}.rec", f"{root}/{name}.idx"])
        raise
    return pa.RecordBatch.from_arrays([pa.array([partition], pa.int32()), pa.array([name]), *[pa.array([n], pa.int64()) for n in (records, tokens, size)]],
                                      names=["partition", "name", "records", "tokens", "size"])


@dataclass
class Part(InputPartition):
    """Records `first` to `last` (not included) of all, by number; `turn` is the (factor, shift, total) of a shuffled read."""

    files: list[tuple[str, int, int]]  # name, number of its first record, ids before it; an entry for the end
    first: int
    last: int
    turn: tuple[int, int, int] | None


class RecordReader(DataSourceReader):
    def __init__(self, path: str, seed: int | None, with_ids: bool, part_bytes: int):
        self.path, self.seed, self.with_ids, self.part_bytes = path, seed, with_ids, part_bytes

    def partitions(self) -> list[Part]:
        files = [f for f in store.manifest(self.path)["files"] if f["records"]]
        starts, records, tokens = [], 0, 0
        for f in files:
            starts.append((f["name"], records, tokens))
            records, tokens = records + f["records"], tokens + f["tokens"]
        if self.seed is not None and records:
            pick = random.Random(self.seed)
            factor = next(x for x in iter(lambda: pick.randrange(1, records + 1), None) if math.gcd(x, records) == 1)
            turn = (factor, pick.randrange(records), records)
            parts = max(1, math.ceil(sum(f["size"] for f in files) / self.part_bytes))
            edges = [records * i // parts for i in range(parts + 1)]
            return [Part([*starts, ("", records, tokens)], a, b, turn) for a, b in zip(edges, edges[1:]) if a < b]
        found = []
        for (name, first, before), f in zip(starts, files):
            pieces = max(1, min(f["records"], math.ceil(f["size"] / self.part_bytes)))
            edges = [first + f["records"] * i // pieces for i in range(pieces + 1)]
            found += [Part([(name, first, before), ("", first + f["records"], 0)], a, b, None) for a, b in zip(edges, edges[1:])]
        return found

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no records at all
            return
        fs, root = store.at(self.path)
        rows: list[tuple] = []
        size = 0
        for start, payload in (self._in_order if part.turn is None else self._shuffled)(fs, root, part):
            key, ids = unpack(payload)
            wide = ids.astype("<u4")
            rows.append((key, start, len(ids), zlib.crc32(wide.tobytes()), wide.astype(np.int64) if self.with_ids else None))
            size += len(payload)
            if size > CHUNK_BYTES:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[0] for r in rows], pa.string()), *[pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2, 3)]]
        if self.with_ids:
            ends = np.cumsum([0, *[len(r[4]) for r in rows]])
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([r[4] for r in rows]), pa.int64())))
        return pa.RecordBatch.from_arrays(columns, names=[f.name for f in read_schema(self.with_ids)])

    def _in_order(self, fs, root: str, part: Part) -> Iterator[tuple[int, bytes]]:
        """The part's records by one pass over its bytes of the file."""
        name, first, before = part.files[0]
        with fs.open_input_file(f"{root}/{name}.idx") as index:
            index.seek((part.first - first) * 16)
            offset, tokens = struct.unpack("<QQ", index.read(16))
        left = part.last - part.first
        with fs.open_input_file(f"{root}/{name}.rec") as file:
            file.seek(offset)
            data, at = b"", 0
            while left:
                got = unframe(data, at)
                if got is None:
                    more = file.read(CHUNK_BYTES)
                    if not more:
                        raise ValueError(f"{name} ends inside a record")
                    data, at = data[at:] + more, 0
                    continue
                yield before + tokens, got[0]
                tokens += len(unpack(got[0])[1])
                at, left = got[1], left - 1

    def _shuffled(self, fs, root: str, part: Part) -> Iterator[tuple[int, bytes]]:
        """The part's share of all records in shuffled order, each by its offset in the index."""
        factor, shift, total = part.turn
        firsts = [first for _, first, _ in part.files]
        opened: dict[str, tuple] = {}
        for number in range(part.first, part.last):
            record = (factor * number + shift) % total
            name, first, before = part.files[bisect_right(firsts, record) - 1]
            if name not in opened:
                if len(opened) >= OPEN_FILES:
                    for file in opened.pop(next(iter(opened))):
                        file.close()
                opened[name] = (fs.open_input_file(f"{root}/{name}.idx"), fs.open_input_file(f"{root}/{name}.rec"))
            index, file = opened[name]
            index.seek((record - first) * 16)
            offset, tokens, end, _ = struct.unpack("<QQQQ", index.read(32))
            file.seek(offset)
            got = unframe(file.read(end - offset), 0)
            if got is None:
                raise ValueError(f"{name} ends inside a record")
            yield before + tokens, got[0]


def read_schema(with_ids: bool) -> T.StructType:
    fields = [T.StructField("key", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32")]]
    return T.StructType([*fields, *([T.StructField("ids", T.ArrayType(T.LongType()))] if with_ids else [])])


class RecordFiles(DataSource):
    """Spark data source of record files. Options: path; for reads seed (shuffled by it), with_ids, part_bytes."""

    @classmethod
    def name(cls) -> str:
        return "token_records"

    def schema(self) -> T.StructType:
        return read_schema(self.options.get("with_ids", "true") == "true")

    def reader(self, schema: T.StructType) -> RecordReader:
        seed = self.options.get("seed")
        return RecordReader(self.options["path"], None if seed is None else int(seed), self.options.get("with_ids", "true") == "true",
                            int(self.options.get("part_bytes", READ_BYTES)))


def write_records(rows: DataFrame, path: str, encode=None) -> None:
    """Write key, ids (binary) and width of every row, a file per partition in order of the partitions.

    With `encode`, a function over Arrow batches that gives those three columns, the same Python worker encodes and writes.
    Every attempt of a task writes under a name of its own, a file counts once the manifest lists it, and one row a file
    comes to the driver for that: failed, repeated or speculative attempts never show. The folder must be one that tasks
    and driver can reach.
    """
    ship(rows.sparkSession)
    given = rows if encode is not None else rows.select("key", "ids", "width")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield write_part(path, batches if encode is None else encode(batches))

    try:
        rows_of_files = given.mapInArrow(run, WRITTEN).collect()
    except BaseException:
        store.clear(path)
        raise
    files = [{n: r[n] for n in ("name", "records", "tokens", "size")} for r in sorted(rows_of_files, key=lambda r: r.partition)]
    store.publish(path, {"files": files}, {f"{f['name']}.{end}" for f in files for end in ("rec", "idx")})


def read_records(spark: SparkSession, path: str, seed: int | None = None, with_ids: bool = True, part_bytes: int = READ_BYTES) -> DataFrame:
    """key, start (ids of all records before it in written order), n_tokens, ids_crc32 (of the ids as 4-byte numbers) and ids
    of every record; with a seed in an order shuffled over all files, each record fetched by its offset in the index."""
    ship(spark)
    spark.dataSource.register(RecordFiles)
    reader = spark.read.format("token_records").option("path", path).option("with_ids", str(with_ids).lower()).option("part_bytes", part_bytes)
    return (reader if seed is None else reader.option("seed", seed)).load()


def records(docs: DataFrame, tokenizer_path: str, end_id: int = 1, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, write the records in ascending order of the ids, read them back: `id_col`, start, n_tokens and
    ids_crc32 of every row.

    `path` is a new folder (without one: in the shared folder). Null and empty texts have the end id alone. Null ids come
    first; rows alike in id are ordered by a hash of their texts. Special strings inside texts are read as the library does
    by default. An empty table gives files without records and an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    if path is None:
        ensure_checkpoint_dir(spark)
        path = f"{spark.sparkContext.getCheckpointDir()}/records-{uuid.uuid4().hex}"
    write_records(in_order(docs, id_col, text_col), path, encoder(vocabulary(spark, tokenizer_path), end_id))
    kind = docs.schema[id_col].dataType
    return read_records(spark, path, with_ids=False).select(F.col("key").cast(kind).alias(id_col), "start", "n_tokens", "ids_crc32")
