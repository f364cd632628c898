"""Record files against the tokenizers library, and what reads and failed tasks see of them."""

import json
import os
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mediatimeline.llm import records
from tests.llm import data

JSON = public_tokenizers.path("word_bpe_49k.json")
TEXT = st.lists(st.sampled_from(list("abÀßªΣσé'sT.,1 \n\t\r\x0b　漢😀́") + ["<|endoftext|>", "  ", "'re", "Word,", "É.", "don't", "(a)", "\x00", "\x85", " "]), max_size=120).map("".join)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_parts_are_encoded_alone(tokenizer, text):
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert records.encode_batch(tokenizer, {}, pa.array([text, None, ""], pa.string()), 2, b"\x01\x00") == [
        np.array([*ids, 1], "<u2").tobytes(), b"\x01\x00", b"\x01\x00"]


def test_full_cache(tokenizer, monkeypatch):
    monkeypatch.setattr(records, "CACHE_PIECES", 2)
    cache = {}
    for text in ("a b c d", "d e f", "a a  b", "x" * 300 + " y"):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert records.encode_batch(tokenizer, cache, pa.array([text]), 4, b"") == [np.array(ids, "<u4").tobytes()]
    assert "x" * 300 not in cache


@settings(max_examples=100, deadline=None)
@given(st.one_of(st.none(), st.text(max_size=20)), st.lists(st.integers(0, 65535), max_size=30))
def test_frames(key, ids):
    data_ = records.frame(records.pack(key, np.array(ids, "<u2").tobytes(), 2))
    payload, end = records.unframe(data_, 0)
    found, back = records.unpack(payload)
    assert end == len(data_) and found == key and back.tolist() == ids
    assert all(records.unframe(data_[:n], 0) is None for n in range(len(data_)))
    for place in range(len(data_)):
        spoilt = bytearray(data_)
        spoilt[place] ^= 4
        with pytest.raises(ValueError, match="checksum"):
            records.unframe(spoilt, 0)


def plain(rows, tokenizer):
    """Rows in order of id (nulls first); rows alike in id are equal texts or compared as a group."""
    return [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]


def test_records(spark, tokenizer, tmp_path):
    docs = data.odd(spark).repartition(5, "n_chars")
    got = records.records(docs, JSON, path=str(tmp_path / "out")).collect()
    want = plain([r[:2] for r in data.odd_rows()], tokenizer)
    assert data.pairs(got, "doc_id", "n_tokens", "ids_crc32") == data.pairs(
        [{"doc_id": i, "n": len(ids), "crc": zlib.crc32(np.array(ids, "<u4").tobytes())} for i, ids in want], "doc_id", "n", "crc")
    run = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == run
        run += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == [i for i, _ in want]
    again = records.records(docs, JSON, path=str(tmp_path / "again")).collect()
    assert data.pairs(got, "doc_id", "start", "ids_crc32") == data.pairs(again, "doc_id", "start", "ids_crc32")


def test_reads(spark, tmp_path):
    path = "file:" + str(tmp_path / "out")
    rows = spark.range(1000).select(F.col("id").cast("string").alias("key"), F.expr("cast(repeat('ab', int(id % 7)) as binary)").alias("ids"), F.lit(2).alias("width"))
    records.write_records(rows.repartition(4, "key"), path)
    straight = records.read_records(spark, path, part_bytes=5000).collect()
    assert len(straight) == 1000 and all(r.ids == [25185] * (int(r.key) % 7) and r.n_tokens == len(r.ids) for r in straight)
    mixed = records.read_records(spark, path, seed=3, part_bytes=5000).collect()
    assert sorted(mixed) == sorted(straight) and [r.key for r in mixed] != [r.key for r in straight]
    assert mixed == records.read_records(spark, path, seed=3, part_bytes=5000).collect()
    near = sum(abs(a.start - b.start) < 50 for a, b in zip(mixed, mixed[1:]))
    assert near < 100  # neighbours in a shuffled read are strangers in the files
    name = json.load(open(tmp_path / "out" / "manifest.json"))["files"][0]["name"]
    with open(tmp_path / "out" / f"{name}.rec", "r+b") as file:
        file.seek(40)
        byte = file.read(1)
        file.seek(40)
        file.write(bytes([byte[0] ^ 1]))
    with pytest.raises(Exception, match="checksum"):
        records.read_records(spark, path).collect()


def test_failed_task_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(100, numPartitions=4).select(
        F.col("id").cast("string").alias("key"), F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise("ab").cast("binary").alias("ids"), F.lit(2).alias("width"))
    with pytest.raises(Exception, match="broken"):
        records.write_records(rows, path)
    assert not os.path.isdir(path) or os.listdir(path) == []


def test_empty(spark, tmp_path):
    got = records.records(data.empty(spark), JSON, path=str(tmp_path / "out"))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.collect() == []
    assert records.read_records(spark, str(tmp_path / "out"), seed=1).collect() == []
