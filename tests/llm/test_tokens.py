import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mediatimeline.llm import bpe, token_counts
from mediatimeline.llm.common import safe_units
from tests.llm import data

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXT = st.lists(st.sampled_from(list("ab'stre.,1 \n\t\r é漢😀") + [" ", "<|endoftext|>", "\x00", "  "]), max_size=200).map("".join)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(open(RANKS, "rb").read(), public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_units_are_encoded_alone(tokenizer, text):
    units = safe_units(text)
    assert "".join(units) == text
    want = len(tokenizer.encode(text, add_special_tokens=False).ids)
    assert token_counts.count_batch(tokenizer, {}, [text, None, ""]) == [want, 0, 0]


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 40))
def test_tree_equals_library(codec, encoding, text, leaf):
    parts = codec.encode(text, leaf)
    ids = [i for unit, _ in parts for i in unit]
    assert ids == encoding.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(TEXT, TEXT, TEXT)
def test_join_is_associative(codec, a, b, c):
    def part(text):
        return codec.part(text, 0, len(text), 1 << 30)
    assert codec.join(codec.join(part(a), part(b)), part(c)) == codec.join(part(a), codec.join(part(b), part(c))) == part(a + b + c)


def test_counts(spark, tokenizer):
    rows = token_counts.token_counts(data.odd(spark), JSON, batch_bytes=1000).collect()
    want = []
    for r in data.odd_rows():
        n = len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)
        want.append((r[0], len((r[1] or "").encode()), n, n > 1024))
    assert data.pairs(rows, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=lambda t: [(v is not None, v) for v in t])
    assert token_counts.token_counts(data.empty(spark), JSON).collect() == []


def test_encode_and_decode(spark, encoding):
    docs = data.odd(spark)
    rows = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, digest=True).collect()
    want = []
    for r in data.odd_rows():
        ids = encoding.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert data.pairs(rows, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=lambda t: [(v is not None, v) for v in t])
    ids = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, leaf=7)
    back = bpe.decode(ids, RANKS, public_tokenizers.PATTERN).collect()
    assert data.pairs(back, "doc_id", "text") == data.pairs([{"doc_id": r[0], "text": r[1] or ""} for r in data.odd_rows()], "doc_id", "text")
    assert bpe.encode(data.empty(spark), RANKS, public_tokenizers.PATTERN).collect() == []
