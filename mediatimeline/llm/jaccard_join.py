"""Jaccard join of word-shingle sets by partition-and-enumerate signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mediatimeline.llm.common import by_bytes, giving_back, ids_and_texts, small_batches, whole_rows
from mediatimeline.session import settle, ship

WORDS = 5
PERCENT = 75
FIRST_TOP = 256  # sets up to this size use one partition per shingle; above it sizes double from band to band
PER_PART = 1.9  # shingles of the largest set of a band per partition
STAR_ROUNDS = 3  # rounds in which every set is compared with one other set
STAR_SHARE = 4  # one in so many signatures serves to choose these pairs; the search after them uses all
AGAIN = 0.8  # the search between components is narrowed a second time if the first one leaves less than this of the signatures it looks at
BLOCK = 2_048  # sets of a family that are counted against as many others in one task
DEALT_ROWS = 400_000  # signatures that a task gathers before it deals them out
BUCKET_BYTES = 32_000_000  # text whose signatures make a bucket, on average
MOST_BUCKETS = 1 << 15  # beyond, buckets get larger
LOOK_BYTES = 2 << 20  # text that a task splits into words at once; what this takes meanwhile is many times as much
SIG_BYTES = 6  # of a signature travel; two of a bucket that differ meet with odds of 1 to 2**43, and a pair too much is compared in vain
SEND_ROWS = 2_000_000  # narrow rows up to this number are broadcast to pick texts; more are joined by a shuffle

ROW_KINDS = [("text_hash", pa.int64()), ("set", pa.int64()), ("size", pa.int32()), ("own", pa.int32()), ("next", pa.int32()), ("sure", pa.bool_())]

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63,
                 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers; equal numbers stay equal."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of all texts, and the number of words of each text. Only A-Z is lowered and only ASCII white
    space separates; each distinct word of the batch is hashed once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    there = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # white space at an end leaves an empty part
    coded = flat.dictionary_encode()
    known = np.array(coded.dictionary.cast(pa.binary()).to_pylist(), dtype=object)
    hashes = pd.util.hash_array(known, categorize=False) if len(known) else np.zeros(0, np.uint64)
    ends = np.cumsum(np.r_[0, pc.list_value_length(lists).to_numpy(zero_copy_only=False)])
    before = np.r_[0, np.cumsum(there)]
    return hashes[coded.indices.to_numpy(zero_copy_only=False)[there]], np.diff(before[ends])


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word windows; a shorter text is one window, one without words none."""
    hashes, lengths = word_hashes(texts)
    windows = np.zeros(len(hashes), np.uint64)
    for j in range(words):
        if len(hashes) > j:
            windows[:len(hashes) - j] += hashes[j:] * _ODD[j]
    windows = mixed_bits(windows)
    sets, at = [], 0
    for n in lengths.tolist():
        if n >= words:
            sets.append(np.unique(windows[at:at + n - words + 1]))
        elif n:
            own = (hashes[at:at + n] * _ODD[:n]).sum(dtype=np.uint64) + np.uint64(n)
            sets.append(mixed_bits(np.array([own], np.uint64) ^ _ODD[7]))
        else:
            sets.append(np.zeros(0, np.uint64))
        at += n
    return sets


def set_key(shingles: np.ndarray) -> int:
    """One 64-bit number per set; the odds that two of n different sets share it are n * n / 2**65."""
    total = mixed_bits(shingles ^ _ODD[5]).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mixed_bits(np.array([total], np.uint64)).view(np.int64)[0])


class Bands:
    """Which signatures a set of a given size has.

    Two sets of a and b shingles, a <= b, with Jaccard similarity of at least percent / 100 differ in at most
    (100 - percent) (a + b) / (100 + percent) shingles, and b <= 100 a / percent. The shingle domain is dealt by hash into
    partitions, and what a set holds of a partition is a signature: a pair that differs in k shingles differs in at most k
    partitions. So if the smaller set has more than k partitions that aren't empty, one of them is the same in both.

    Bands of sizes, by the larger set, have partition counts of their own; a set has signatures in its own band and, as
    the smaller one, in the band of its largest partner. There are enough partitions for the bound and a margin of several
    deviations of the number of empty ones; that the bound holds is checked for every set, see `dealt_rows`.
    """

    def __init__(self, percent: int = PERCENT):
        if not 75 <= percent <= 100:
            raise ValueError("percent must be from 75 to 100")
        self.percent = percent

    def partner(self, size: int) -> int:
        return 100 * size // self.percent

    def most_different(self, size: int) -> int:
        """Largest difference between a set of `size` and a similar one that isn't smaller."""
        return (100 - self.percent) * (size + self.partner(size)) // (100 + self.percent)

    @staticmethod
    def band(size: int) -> int:
        return 0 if size <= FIRST_TOP else (size - 1).bit_length() - FIRST_TOP.bit_length() + 1

    def bands(self, size: int) -> list[int]:
        return list(range(self.band(size), self.band(self.partner(size)) + 1))

    def parts(self, band: int) -> int:
        return math.ceil((FIRST_TOP << band) / PER_PART)


def salted(shingles: np.ndarray, salt: int) -> np.ndarray:
    return mixed_bits(shingles + np.uint64((2 * salt + 1) * int(_ODD[6]) % 2**64))


def parts_of(mixed: np.ndarray, parts: int) -> np.ndarray:
    return (mixed >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)


def signatures(shingles: np.ndarray, bands: Bands, salt: int) -> list[tuple[int, np.ndarray]]:
    """(band, signatures) of a set; the last five bits of a signature are the band."""
    found = []
    size = len(shingles)
    whole = salted(shingles, salt)
    for band in bands.bands(size) if size else []:
        mixed = whole
        if band:
            part = parts_of(mixed, bands.parts(band))
            order = np.argsort(part)
            part, mixed = part[order], mixed_bits(mixed[order] ^ _ODD[4])
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            mixed = mixed_bits(np.add.reduceat(mixed, starts) + (part[starts] + np.uint64(1)) * _ODD[3])
        found.append((band, (mixed & ~np.uint64(31)) | np.uint64(band)))
    return found


def dealt_rows(docs: DataFrame, bands: Bands, words: int, salt: int, buckets: int) -> DataFrame:
    """All that one look at the texts gives; each row has `sigs` and `sets`, or `row`.

    * `sigs` and `sets`: the signatures of a `bucket` and their sets' numbers, in one order, many in a row. A signature's highest bits
      give its bucket and don't travel (SIG_BYTES). Copies that one task meets again are left out there.
    * `row` with `sure`: id, text_hash, set (null: no shingles) and size of a text, and whether the bound holds for its set. `key` and
      `bucket` only spread these rows.
    * `row` with `own` and `next`: how many signatures the set `key` has in its band and in the next one, once a task.
    """
    docs = docs.select("id", "text", F.xxhash64("text").alias("text_hash"))
    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("key", T.LongType()), T.StructField("sigs", T.BinaryType()),
                           T.StructField("sets", T.BinaryType()), row_field(docs.schema["id"].dataType)])

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sigs: list[np.ndarray] = []
        keys: list[np.ndarray] = []

        def batch_of(bucket: np.ndarray, key=None, sigs=None, sets=None, row=None) -> pa.RecordBatch:
            # The first batch names the type of the ids, which only the input knows.
            columns = [bucket, key, sigs, sets, row]
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), row_kind]
            return pa.RecordBatch.from_arrays([pa.nulls(len(bucket), k) if c is None else c if isinstance(c, pa.Array) else pa.array(c, k)
                                               for c, k in zip(columns, kinds)], names=schema.names)

        def deal() -> pa.RecordBatch:
            sig, key = np.concatenate(sigs), np.concatenate(keys)
            bucket = ((sig >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.uint16)  # numbers of 16 bits sort fast
            order = np.argsort(bucket, kind="stable")
            sig, key, bucket = sig[order], key[order], bucket[order].astype(np.int64)
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            edges = list(zip(first, np.r_[first[1:], len(bucket)]))
            low = sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES]
            return batch_of(bucket[first], sigs=[low[a:b].tobytes() for a, b in edges], sets=[key[a:b].tobytes() for a, b in edges])

        row_kind = None
        for batch in by_bytes(batches, LOOK_BYTES):
            row_kind = row_kind or pa.struct([("id", batch.schema.field(0).type), *ROW_KINDS])
            n = batch.num_rows
            sets, sizes, sure, fresh = [], [], [], []
            for shingles in shingle_sets(batch.column(1), words):
                size = len(shingles)
                key = set_key(shingles) if size else None
                bound = True
                if size and key not in seen:
                    seen.add(key)
                    counts = []
                    for _, found in signatures(shingles, bands, salt):
                        sigs.append(found)
                        keys.append(np.full(len(found), key, np.int64))
                        counts.append(len(found))
                    bound = min(counts) > bands.most_different(size)
                    fresh.append((key, size, *(counts + [0])[:2]))
                sets.append(key)
                sizes.append(size)
                sure.append(bound)
            spread = mixed_bits(np.arange(n, dtype=np.uint64) + batch.column(2)[:1].to_numpy().view(np.uint64)).view(np.int64)
            texts = pa.StructArray.from_arrays([batch.column(0), batch.column(2), pa.array(sets, pa.int64()), pa.array(sizes, pa.int32()),
                                                pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.array(sure, pa.bool_())], fields=list(row_kind))
            yield batch_of(spread_over(spread, buckets), spread, row=texts)
            if fresh:
                key, size, own, follow = (np.array(c) for c in zip(*fresh))
                counted = pa.StructArray.from_arrays([pa.nulls(len(key), row_kind[0].type), *(pa.nulls(len(key), pa.int64()) for _ in range(2)),
                                                      *(pa.array(c, pa.int32()) for c in (size, own, follow)), pa.nulls(len(key), pa.bool_())], fields=list(row_kind))
                yield batch_of(spread_over(key, buckets), key, row=counted)
            if sum(map(len, sigs)) > DEALT_ROWS:
                yield deal()
                sigs.clear()
                keys.clear()
        if sigs:
            yield deal()

    return docs.mapInArrow(run, schema)


def row_field(ident: T.DataType) -> T.StructField:
    kinds = (("id", ident), ("text_hash", T.LongType()), ("set", T.LongType()), ("size", T.IntegerType()), ("own", T.IntegerType()),
             ("next", T.IntegerType()), ("sure", T.BooleanType()))
    return T.StructField("row", T.StructType([T.StructField(n, k) for n, k in kinds]))


def spread_over(key: np.ndarray, buckets: int) -> np.ndarray:
    return parts_of(mixed_bits(key.view(np.uint64)), buckets).astype(np.int64)


class Met:
    """Signatures of a bucket so far, in order, each with the first set that had it and whether others have had it too."""

    def __init__(self) -> None:
        self.sig, self.key, self.shared = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, sig: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of the signatures that several sets have, as far as known now and not given before."""
        order = np.argsort(sig)
        sig, key = sig[order], key[order]
        first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        at = np.searchsorted(self.sig, sig[first])
        old = at < len(self.sig)
        old[old] = self.sig[at[old]] == sig[first][old]
        # What each entry is measured by: the first set that ever had the signature.
        held = key[first].copy()
        held[old] = self.key[at[old]]
        was = np.zeros(len(first), bool)
        was[old] = self.shared[at[old]]
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(sig)]))
        other = key != held[group]
        now = was | np.logical_or.reduceat(other, first)
        fresh = now & ~was
        out_sig, out_key = np.r_[sig[other], sig[first][fresh]], np.r_[key[other], held[fresh]]
        self.shared[at[old]] = now[old]
        new = ~old
        self.sig = np.insert(self.sig, at[new], sig[first][new])
        self.key = np.insert(self.key, at[new], held[new])
        self.shared = np.insert(self.shared, at[new], now[new])
        return out_sig, out_key


def met_in_buckets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(signatures, sets) of the entries that several sets have, from packed rows (bucket, sigs, sets) in order of buckets.

    One entry a signature of the bucket at hand is kept, so a signature that very many sets have costs no memory.
    """
    bucket, met, waiting = None, Met(), 0
    sigs: list[np.ndarray] = []
    keys: list[np.ndarray] = []

    def take() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if sigs:
            yield met.add(np.concatenate(sigs), np.concatenate(keys))
            sigs.clear()
            keys.clear()

    for batch in batches:
        for here, sig, key in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if here != bucket:
                yield from take()
                bucket, met, waiting = here, Met(), 0
            if width < 8:  # what is left out is the same within a bucket, but for the bucket itself
                padded = np.zeros((len(sig) // width, 8), np.uint8)
                padded[:, :width] = np.frombuffer(sig, np.uint8).reshape(-1, width)
                sigs.append(padded.view("<u8").ravel() | np.uint64(here << 8 * width))
            else:
                sigs.append(np.frombuffer(sig, np.uint64))
            keys.append(np.frombuffer(key, np.int64))
            waiting += len(sigs[-1])
            if waiting > DEALT_ROWS // 2:
                yield from take()
                waiting = 0
    yield from take()


def shared_signatures(rows: DataFrame) -> DataFrame:
    """(sig, set) of the signatures that several sets have, once each, from packed rows with whole signatures."""

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sig, key in met_in_buckets(batches, 8):
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(key)], names=["sig", "set"])

    # Copies of a set in several tasks give an entry several times.
    found = rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "sig long, set long")
    return found.dropDuplicates(["sig", "set"])


def shared_or_rows(dealt: DataFrame) -> DataFrame:
    """(key, sig, row): signatures that several sets have, `key` being the set, beside the rows that `dealt_rows` gives, untouched."""
    schema = T.StructType([dealt.schema["key"], T.StructField("sig", T.LongType()), dealt.schema["row"]])

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, others = [], []

        def packed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds[:] = [batch.schema.field("row").type]
                there = pc.is_valid(batch.column("sigs"))
                rest = batch.filter(pc.invert(there))
                if rest.num_rows:
                    others.append(rest)
                yield batch.filter(there).select(["bucket", "sigs", "sets"])
                # Rows held back here leave with the next signatures, or at the end.

        def held_back() -> Iterator[pa.RecordBatch]:
            for rest in others:
                yield pa.RecordBatch.from_arrays([rest.column("key"), pa.nulls(rest.num_rows, pa.int64()), rest.column("row")], names=schema.names)
            others.clear()

        for sig, key in met_in_buckets(packed(), SIG_BYTES):
            yield from held_back()
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(sig.view(np.int64)), pa.nulls(len(sig), kinds[0])], names=schema.names)
        yield from held_back()

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


class Alive:
    """The live entries of sets whose rows come in order of sets, each with counts of signatures and shared signatures.

    Two similar sets differ in at most `most_different` signatures of their band, so a set with more that nobody else has is
    out: a text that is mostly its own, whatever passages it shares with others. What comes several times counts once.
    """

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.waiting: list[tuple[np.ndarray, ...]] = []

    def add(self, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
        """Take (set, signature, whether this row is one of counts, size, own, next); give the entries of all sets but the last one."""
        self.waiting.append(columns)
        return self._given(last=False)

    def rest(self) -> tuple[np.ndarray, ...]:
        return self._given(last=True)

    def _given(self, last: bool) -> tuple[np.ndarray, ...]:
        columns = [np.concatenate(c) for c in zip(*self.waiting)] if self.waiting else [np.zeros(0, np.int64)] * 6
        order = np.lexsort((columns[1], ~columns[2].astype(bool), columns[0]))  # counts first
        key, sig, entry = columns[0][order], columns[1][order], ~columns[2][order].astype(bool)
        once = np.r_[True, (key[1:] != key[:-1]) | (sig[1:] != sig[:-1]) | (entry[1:] != entry[:-1])][:len(key)]
        columns = [c[order][once] for c in columns]
        end = len(columns[0]) if last or not len(key) else int(np.searchsorted(columns[0], key[-1]))
        self.waiting = [tuple(c[end:] for c in columns)]
        key, sig, counts, size, own, follow = (c[:end] for c in columns)
        entry = ~counts.astype(bool)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][:end])
        at = np.repeat(np.arange(len(first)), np.diff(np.r_[first, end]))[entry]
        key, sig = key[entry], sig[entry]
        size, own, follow = size[first].astype(np.int64), own[first].astype(np.int64), follow[first].astype(np.int64)
        band = sig & 31
        later = band != np.where(size <= FIRST_TOP, 0, np.frexp(np.maximum(size - 1, 1))[1] - FIRST_TOP.bit_length() + 1)[at]
        held = np.where(later, follow[at], own[at])
        shared = np.bincount(2 * at + later, minlength=2 * len(first))[2 * at + later]
        most = (100 - self.percent) * (size + 100 * size // self.percent) // (100 + self.percent)
        stay = held - shared <= most[at]
        return sig[stay], key[stay], band[stay], size[at][stay], held[stay]


def live_or_rows(shared: DataFrame, percent: int) -> DataFrame:
    """(sig, set, band, size, held): the live signature entries, `held` being how many signatures the set has in the band; and
    `row`, the rows of texts, untouched."""
    kinds = [("sig", T.LongType()), ("set", T.LongType()), ("band", T.LongType()), ("size", T.IntegerType()), ("held", T.IntegerType())]
    schema = T.StructType([*(T.StructField(n, k) for n, k in kinds), shared.schema["row"]])

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alive, row_kind = Alive(percent), None

        def given(found: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            if len(found[0]):
                columns = [pa.array(c, k) for c, k in zip(found, (pa.int64(),) * 3 + (pa.int32(),) * 2)]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(found[0]), row_kind)], names=schema.names)

        for batch in batches:
            row_kind = batch.schema.field("row").type
            text = pc.is_valid(pc.struct_field(batch.column("row"), "sure"))
            texts, rest = batch.filter(text), batch.filter(pc.invert(text))
            if texts.num_rows:
                nothing = [pa.nulls(texts.num_rows, k) for k in (pa.int64(),) * 3 + (pa.int32(),) * 2]
                yield pa.RecordBatch.from_arrays([*nothing, texts.column("row")], names=schema.names)
            if rest.num_rows:
                columns = [rest.column("key"), pc.fill_null(rest.column("sig"), 0), pc.is_null(rest.column("sig")),
                           *(pc.fill_null(pc.struct_field(rest.column("row"), n), 0) for n in ("size", "own", "next"))]
                yield from given(alive.add(*(c.to_numpy(zero_copy_only=False) for c in columns)))
        yield from given(alive.rest())

    return shared.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def most_different(size: Column, percent: int) -> Column:
    return F.floor((100 - percent) * (size + F.floor(100 * size / percent)) / (100 + percent))


def live(entries: DataFrame, percent: int) -> DataFrame:
    """Entries of the sets that can have a partner.

    Two similar sets differ in at most `most_different` signatures of their band, so a set with more that nobody else has is
    out: a text that is mostly its own, whatever passages it shares with others. Its leaving may leave others alone.
    """
    shared = F.count("*").over(Window.partitionBy("set", "band"))
    return entries.withColumn("shared", shared).where(F.col("held") - F.col("shared") <= most_different(F.col("size"), percent)).drop("shared")


def weighted(entries: DataFrame) -> DataFrame:
    """Entries of the signatures for the stars, with the set's `weight`: how many sets it meets, met again for every signature."""
    some = entries.where(F.pmod(F.shiftrightunsigned("sig", 5), F.lit(STAR_SHARE)) == 0).select("sig", "set", "size")
    counted = some.withColumn("n", F.count("*").over(Window.partitionBy("sig"))).where("n > 1")
    return counted.withColumn("weight", F.sum("n").over(Window.partitionBy("set"))).drop("n")


def chosen_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(set, shingles as bytes) of the sets in `wanted` (id, set, one id per set)."""
    names = wanted.select(F.col("id").alias("wanted_id"), F.col("set").alias("wanted"))
    if wanted.count() <= SEND_ROWS:  # 16 bytes a row; beyond this number texts and names are joined by a shuffle
        names = F.broadcast(names)
    picked = docs.join(names, docs["id"].eqNullSafe(F.col("wanted_id"))).select("wanted", "text")
    schema = T.StructType([T.StructField("set", T.LongType()), T.StructField("shingles", T.BinaryType())])

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            found = [(key, s.tobytes()) for key, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), words))
                     if len(s) and set_key(s) == key]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())],
                                                 names=schema.names)

    return picked.mapInArrow(run, schema).dropDuplicates(["set"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, common, either) of the pairs (a, b) whose sets are similar, by intersection of the whole sets."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("a", "b", "common", "either")])
    both = pairs.join(sets.select(F.col("set").alias("a"), F.col("shingles").alias("of_a")), "a")
    both = both.join(sets.select(F.col("set").alias("b"), F.col("shingles").alias("of_b")), "b").select("a", "b", "of_a", "of_b")

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                either = len(x) + len(y) - common
                if 100 * common >= percent * either:
                    rows.append((a, b, common, either))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=schema.names)

    return both.mapInArrow(run, schema)


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, root) of every node with a link, root the smallest node that it reaches; `known` are earlier results to go on from.

    Each round hooks every root to the smallest one that it has a link to, follows hooks to their ends by doubling, and drops links
    that have become loops. Stars need one round, chains a logarithm of their length. Nodes never leave the tables.
    """
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    roots = known
    if known is not None:
        edges = _moved(edges, known)
    edges = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not edges.isEmpty():
        hooks = settle(edges.groupBy("u").agg(F.min("v").alias("to")).select(F.col("u").alias("node"), F.col("to").alias("root")))
        while True:
            ahead = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = settle(hooks.join(ahead, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            hooks = jumped.select("node", "root")
            if jumped.where("moved").isEmpty():
                break
        ends = edges.select(F.col("v").alias("node")).distinct().join(hooks, "node", "left_anti").select("node", F.col("node").alias("root"))
        if roots is None:
            roots = hooks.unionByName(ends)
        else:
            held = roots.select("node", F.col("root").alias("old"))
            renamed = held.join(hooks.select(F.col("node").alias("old"), F.col("root").alias("new")), "old", "left")
            old = renamed.select("node", F.coalesce("new", "old").alias("root"))
            fresh = hooks.unionByName(ends).join(held.select("node"), "node", "left_anti")
            roots = old.unionByName(fresh)
        roots = settle(roots)
        edges = _moved(edges, hooks)
        edges = settle(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if roots is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots


def _moved(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges between the roots of their ends, without loops."""
    for side in ("u", "v"):
        named = roots.select(F.col("node").alias(side), F.col("root").alias("to"))
        edges = edges.join(named, side, "left").withColumn(side, F.coalesce("to", side)).drop("to")
    return edges.where("u <> v")


def size_fits(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """id, text_hash, n_shingles and root of every row; rows with one root are connected, null means no shingles."""
    ship(docs.sparkSession)
    bands = Bands(percent)
    rows = ids_and_texts(docs, id_col, text_col)
    with small_batches(docs.sparkSession):  # all Python work is done in here; what is returned only joins
        amount = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = min(-(-amount // BUCKET_BYTES) or 1, MOST_BUCKETS)
        for salt in range(100):
            looked = settle(live_or_rows(shared_or_rows(dealt_rows(rows, bands, words, salt, buckets)), percent))
            found = looked.where("row is not null").select("row.*")
            if found.where("not sure").isEmpty():
                break
        else:
            raise RuntimeError("no salt deals the shingles evenly enough")
        sets = settle(found.where("size > 0").groupBy("set").agg(F.min("id").alias("id")))
        entries = looked.where("sig is not null").drop("row")
        roots = linked(rows, entries, sets, words, percent)
    joined = found.join(roots.select(F.col("node").alias("set"), "root"), "set", "left")
    return joined.select("id", "text_hash", F.col("size").cast("long").alias("n_shingles"), F.coalesce("root", "set").alias("root"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """`id_col`, n_shingles and component_id (the smallest id that a row reaches over links, itself included) of every row.

    Two rows link when 100 * intersection >= percent * union of their sets of word windows. Rows with equal sets are one set from
    the start. Sets with a common signature are candidates, unless too many of their signatures are their own. In a few
    rounds every set is compared with one set only, the most connected one with which it shares most signatures, which joins a
    group of near copies like a star. Then only pairs of sets in different components are left. They are counted in blocks:
    a task gets two blocks of a family and finds the pairs that share as many signatures as similar sets must; these are
    compared in full. So no link between components is lost, and no list of all pairs in a group is ever written.

    A null text, or one without words, has an empty set, links with nothing, and has its own id as component. Rows with a null
    id take part; a component of such rows only has a null component_id. Repeated rows are equal sets. An empty table gives
    an empty result. Other columns are not read.
    """
    found = classes(docs, id_col, text_col, words, percent)
    smallest = found.where("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    return found.join(smallest, "root", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs`, one of each component: the one with the smallest id, nulls first, and among equals the smallest text hash.

    Rows without shingles are components of their own. Of rows equal in id and text one stays.
    """
    found = settle(classes(docs, id_col, text_col, words, percent))
    first = found.where("root is not null").groupBy("root").agg(F.min(F.struct("id", "text_hash")).alias("first")).select("first.*")
    stay = first.union(found.where("root is null").select("id", "text_hash").distinct())
    stay = settle(stay.select(id_key(F.col("id")).alias("k"), "text_hash"))
    text = docs[text_col].cast("string")
    rows = docs.select(whole_rows(docs), id_key(docs[id_col]).alias("k"), F.xxhash64(text).alias("text_hash"))
    # Both steps use one key without nulls, so the texts are shuffled once.
    return rows.join(stay, ["k", "text_hash"], "left_semi").dropDuplicates(["k", "text_hash"]).select("row.*")


def id_key(ident: Column) -> Column:
    """A key that is never null and different for different ids."""
    return F.coalesce(F.concat(F.lit("i"), ident.cast("string")), F.lit("n"))


def linked(rows: DataFrame, entries: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, root) over sets, from the live signature entries (sig, set, band, size, held)."""
    some = settle(weighted(entries))
    roots = tried = None
    for _ in range(STAR_ROUNDS):
        pairs = star_pairs(some, roots, tried, percent)
        if pairs.isEmpty():
            break
        tried = pairs if tried is None else tried.union(pairs)
        roots = components(compared(rows, pairs, sets, words, percent), roots)
    seen = Observation()
    rest = settle(live(between(with_roots(entries, roots)).observe(seen, F.count("*").alias("n")), percent))
    left = rest.count()
    if left and left < AGAIN * seen.get["n"]:  # many have left, and may have left others alone; of nothing no number may be seen
        rest = settle(live(between(rest), percent))
    pairs = settle(block_pairs(rest, percent).distinct())
    return components(compared(rows, pairs, sets, words, percent), roots)


def with_roots(entries: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return entries.withColumn("root", F.col("set"))
    named = entries.join(roots.select(F.col("node").alias("set"), "root"), "set", "left")
    return named.withColumn("root", F.coalesce("root", "set"))


def between(entries: DataFrame) -> DataFrame:
    """Entries of the signatures that sets of several components have."""
    of_sig = Window.partitionBy("sig")  # one shuffle; sums per signature beside the entries would travel as many again
    ends = entries.withColumn("low", F.min("root").over(of_sig)).withColumn("high", F.max("root").over(of_sig))
    return ends.where("low <> high").drop("low", "high")


def star_pairs(entries: DataFrame, roots: DataFrame | None, tried: DataFrame | None, percent: int) -> DataFrame:
    """One pair (a, b) for every set a that shares a signature with a more connected set b of another component.

    b is the most connected set of a signature; of several, the one under most signatures that wasn't tried.
    """
    named = with_roots(entries, roots)
    center = F.max(F.struct("weight", "set", "size", "root"))
    met = named.withColumn("center", center.over(Window.partitionBy("sig")))
    met = met.where((F.col("root") != F.col("center")["root"]) & size_fits(F.col("size"), F.col("center")["size"], percent))
    votes = met.groupBy(F.col("set").alias("a"), F.col("center")["set"].alias("b")).agg(F.count("*").alias("n"))
    if tried is not None:
        votes = votes.join(tried, ["a", "b"], "left_anti")
    best = votes.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b"))
    return settle(best)


def block_pairs(entries: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of sets in different components that share enough signatures to be similar.

    Sets that a chain of signatures connects are a family. A family's sets are dealt into blocks by hash; every two blocks
    meet in one task, which counts common signatures. Tasks hold about two blocks, however large a family.
    """
    low = F.min("set").over(Window.partitionBy("sig"))
    chain = components(entries.select(F.col("set").alias("a"), low.alias("b")).where("a <> b").distinct())
    sets = entries.groupBy("set", "band").agg(F.first("size").alias("size"), F.first("held").alias("held"), F.first("root").alias("root"),
                                              F.collect_list("sig").alias("sigs"))  # at most one signature per shingle of the set
    sets = sets.join(chain.select(F.col("node").alias("set"), F.col("root").alias("family")), "set")
    counts = sets.groupBy("family", "band").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = sets.join(counts, ["family", "band"]).withColumn("mine", F.pmod(F.xxhash64("set"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("first", F.least("mine", "other")).withColumn("second", F.greatest("mine", "other"))

    def count(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("set")
        one = part[part["mine"] == part["first"].iloc[0]]
        two = part[part["mine"] == part["second"].iloc[0]]
        common = common_counts(list(one["sigs"]), list(two["sigs"]))
        a, b = one["size"].to_numpy()[:, None], two["size"].to_numpy()[None, :]
        need = np.maximum(one["held"].to_numpy()[:, None], two["held"].to_numpy()[None, :]) - (100 - percent) * (a + b) // (100 + percent)
        fits = (common >= np.maximum(need, 1)) & (one["root"].to_numpy()[:, None] != two["root"].to_numpy()[None, :])
        fits &= 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
        exact = part["band"].iloc[0] == 0  # there signatures are shingles, and the counts are the intersections
        if exact:
            fits &= 100 * common >= percent * (a + b - common)
        x, y = np.nonzero(fits)
        found = pd.DataFrame({"a": one["set"].to_numpy()[x], "b": two["set"].to_numpy()[y]})
        if exact:  # of links between the same two components one is enough
            ends = np.sort(np.column_stack([one["root"].to_numpy()[x], two["root"].to_numpy()[y]]), axis=1)
            found = found[~pd.DataFrame(ends).duplicated().to_numpy()]
        return pd.DataFrame({"a": found.min(axis=1), "b": found.max(axis=1)}).astype("int64")

    return dealt.groupBy("family", "band", "first", "second").applyInPandas(count, "a long, b long")


def common_counts(one: list, two: list, width: int = 4096, rare: int = 2_000, piece: int = 4_000_000) -> np.ndarray:
    """Matrix of common elements of each of the sets `one` with each of the sets `two`.

    Elements of few pairs of sets, up to one in `rare` of all, are counted pair by pair, about `piece` pairs at a time; the others by
    matrix products, `width` elements at a time.
    """
    counts = np.zeros((len(one), len(two)), np.float32)
    if not one or not two:
        return counts
    flat = [np.concatenate([np.asarray(s, np.int64) for s in sets]) for sets in (one, two)]
    known = np.intersect1d(*flat)
    places = []
    for sets, values in zip((one, two), flat):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        column = np.searchsorted(known, values)
        inside = column < len(known)
        inside[inside] = known[column[inside]] == values[inside]
        order = np.argsort(column[inside], kind="stable")
        places.append((row[inside][order], column[inside][order]))
    holders = [np.bincount(column, minlength=len(known)) for _, column in places]
    starts = [np.cumsum(n) - n for n in holders]
    met = holders[0] * holders[1]
    few = np.flatnonzero(met <= max(1, len(one) * len(two) // rare))
    cuts = np.cumsum(met[few]) // piece
    for some in np.split(few, np.flatnonzero(np.diff(cuts)) + 1):
        column = np.repeat(some, met[some])
        nth = np.arange(len(column)) - np.repeat(np.cumsum(met[some]) - met[some], met[some])
        x, y = np.divmod(nth, holders[1][column])
        pairs = places[0][0][starts[0][column] + x] * len(two) + places[1][0][starts[1][column] + y]
        counts += np.bincount(pairs, minlength=counts.size).reshape(counts.shape)
    many = np.ones(len(known), bool)
    many[few] = False
    number = np.cumsum(many) - 1
    places = [(row[many[column]], number[column[many[column]]]) for row, column in places]
    for start in range(0, int(many.sum()), width):
        dense = []
        for sets, (row, column) in zip((one, two), places):
            low, high = np.searchsorted(column, (start, start + width))
            block = np.zeros((len(sets), width), np.float32)
            block[row[low:high], column[low:high] - start] = 1
            dense.append(block)
        counts += dense[0] @ dense[1].T
    return counts


def compared(rows: DataFrame, pairs: DataFrame, sets: DataFrame, words: int, percent: int) -> DataFrame:
    needed = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    wanted = settle(sets.select("id", "set").join(needed, "set"))
    return settle(verified(pairs, settle(chosen_sets(rows, wanted, words)), percent))
