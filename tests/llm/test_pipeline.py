import base64
import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import tiktoken
import zstandard

import __spark_entry__ as entry_module
import corpus_pipeline
from check import compare
from mediatimeline.llm import language_id, quality_rules
from mediatimeline.session import settle
from tests.conftest import SMALL
from tests.llm import data
from tests.llm.test_tables import level_targets


def test_registered():
    names = set(entry_module.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))


def test_fingerprints_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    out = compare(entry_module.queries()["op6_fingerprints"](spark, SMALL), con, entry_module.oracle_sql()["op6_fingerprints"])
    assert out.startswith("ok") and "TYPES" not in out, out


def test_stages(spark):
    """Every stage against a plain version of it, on what the stage before kept."""
    docs = settle(spark.read.parquet(f"{SMALL}/documents.parquet"))
    columns, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(settle(stage(spark, seen[-1], SMALL)))
    assert all(s.columns == columns for s in seen[:-1])
    rows = [[r.asDict() for r in s.collect()] for s in seen]

    spoken = language_id.language_id(seen[0]).where(f"lang_pred <> 'und' and score >= {language_id.LEAST_SCORE}")
    assert sorted(r["doc_id"] for r in rows[1]) == sorted(r.doc_id for r in spoken.collect())

    zip_ = zstandard.ZstdCompressor(level=3)
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(r["doc_id"] for r in rows[1] if data.good(quality_rules.judge(r["text"], zip_)))

    left = sorted(rows[2], key=lambda r: r["doc_id"])
    roots = data.linked([data.shingles(r["text"]) for r in left])
    assert sorted(r["doc_id"] for r in rows[3]) == sorted({left[k]["doc_id"] for k in roots})

    sizes, taken, longest = defaultdict(int), Counter(), Counter()
    for r in rows[3]:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        sizes[r["source"]] += n
        longest[r["source"]] = max(n, longest[r["source"]])
    times = Counter(r["doc_id"] for r in rows[4])
    assert set(times) <= {r["doc_id"] for r in rows[3]} and set(times.values()) <= {1, 2}
    for r in rows[4]:
        taken[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    for source, target in level_targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= longest[source] + 1

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in rows[4]:
        ids = library.encode_ordinary(r["text"])
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()))
    assert data.pairs(rows[5], "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want)


def test_odd_rows_go_through(spark):
    docs = data.odd(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, SMALL))
        assert docs.columns == data.SCHEMA.names
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()


def test_empty_table_goes_through(spark):
    docs = data.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, SMALL))
    assert docs.count() == 0
