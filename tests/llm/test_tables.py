"""Operators that look at all rows together."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mediatimeline.llm import jaccard_join, mixing, sharding
from mediatimeline.llm.common import read
from tests.conftest import SMALL
from tests.llm import data


def order(rows):
    return sorted(rows, key=lambda t: [(v is not None, v) for v in t])


def check_shards(rows, texts, n_shards):
    assert data.pairs(rows, "doc_id", "size", "text_crc32") == order(
        (i, len((t or "").encode()) + 1, None if t is None else zlib.crc32(t.encode())) for i, t in texts)
    assert {(r.law, r.grown_shard) for r in rows} <= {("bytes", None)}
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    assert set(by) <= set(range(n_shards))
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return [sum(r["size"] for r in by[k]) for k in range(n_shards)]


def test_sharding_documents(spark):
    docs = read(spark, SMALL, "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rows = sharding.shard(docs).collect()
    sizes = check_shards(rows, texts, 8)
    assert max(sizes) - min(sizes) <= 2 * max(len(t.encode()) + 1 for _, t in texts)
    assert data.pairs(rows, "doc_id", "shard", "slot") == data.pairs(sharding.shard(docs).collect(), "doc_id", "shard", "slot")


def test_sharding_odd_rows(spark):
    check_shards(sharding.shard(data.odd(spark), 3).collect(), [(r[0], r[1]) for r in data.odd_rows()], 3)
    assert sharding.shard(data.empty(spark)).collect() == []


def test_sharding_splits_a_hot_text(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("own text "), "id")).otherwise("copy").alias("text"))
    rows = sharding.shard(docs, 8, rows_per_range=50).collect()
    sizes = check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()], 8)
    assert max(sizes) - min(sizes) <= 60
    narrow = sharding.sizes(docs)
    _, held = sharding.ranges(narrow, 80)
    assert max(n for n, _ in held) <= 400


def test_overfull_ranges_are_divided(spark):
    """A sample that saw nothing leaves one range; counting finds and divides it."""
    rows = sharding.sizes(spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text")))
    old, sharding.DRAWS_PER_RANGE = sharding.DRAWS_PER_RANGE, 2
    try:
        _, held = sharding.ranges(rows, 60)
    finally:
        sharding.DRAWS_PER_RANGE = old
    assert sum(n for n, _ in held) == 3000 and max(n for n, _ in held) <= 600


def level_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, open_, targets = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if budget * weight[s] / total > 2 * sizes[s]]
        if not over:
            targets |= {s: budget * weight[s] / total for s in open_}
            break
        for s in over:
            targets[s] = 2.0 * sizes[s]
        budget -= sum(targets[s] for s in over)
        open_ -= set(over)
    return targets


def check_mix(rows, docs):
    count = {}
    sizes = defaultdict(int)
    for i, text, source in docs:
        count.setdefault(i, []).append((len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), source))
        sizes[source] += count[i][-1][0]
    targets = level_targets(dict(sizes))
    taken, longest = defaultdict(int), defaultdict(int)
    assert len(rows) == len(docs)
    for r in rows:
        source = next(s for n, s in count[r.doc_id] if n == r["size"] and sizes[s] == r.source_size)
        assert r.target == pytest.approx(targets[source]) and r.taken in (0, r["size"], 2 * r["size"])
        taken[source] += r.taken
        longest[source] = max(longest[source], r["size"])
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= longest[s] + 1, (s, taken[s], targets[s])


def test_mix_documents(spark):
    docs = read(spark, SMALL, "documents")
    rows = mixing.mix(docs).collect()
    check_mix(rows, [(r.doc_id, r.text, r.source) for r in docs.collect()])
    assert data.pairs(rows, "doc_id", "taken") == data.pairs(mixing.mix(docs).collect(), "doc_id", "taken")


def test_mix_odd_rows(spark):
    docs = data.odd(spark).where("doc_id is not null")
    check_mix(mixing.mix(docs).collect(), [(r[0], r[1], r[3]) for r in data.odd_rows() if r[0] is not None])
    assert mixing.mix(data.odd(spark)).count() == len(data.odd_rows())
    assert mixing.mix(data.empty(spark)).collect() == []
    copies = mixing.mixed(data.odd(spark))
    assert copies.columns == data.odd(spark).columns
    assert copies.count() == mixing.mix(data.odd(spark)).agg(F.sum("copies")).first()[0]


def test_mix_with_buckets(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") < 2000, "a").otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source"))
    rows = docs.select(*mixing.keyed(docs, "doc_id", "text", "source"))
    plan = mixing.plan(rows, bucket_rows=37)
    got = rows.join(plan, ["mix_source", "mix_size"]).groupBy("mix_source").agg(F.sum(mixing.copies() * F.col("mix_size")).alias("n"), F.first("target").alias("t")).collect()
    assert all(abs(r.n - r.t) <= 3 for r in got)


def test_newton_solves_the_dual(spark):
    docs = read(spark, SMALL, "documents")
    rows = docs.select(*mixing.keyed(docs, "doc_id", "text", "source"))
    cells = rows.groupBy("mix_source", "mix_size").agg(F.count("*").alias("n"))
    solved = {r.mix_source: r for r in mixing.tilt(cells, mixing.targets(cells)).collect()}
    sizes = defaultdict(list)
    for r in rows.collect():
        sizes[r.mix_source].append(r.mix_size)
    for source, s in solved.items():
        x = np.array(sizes[source])
        rate = np.full(len(x), 2.0) if s.full else np.minimum(2, np.exp(s.lam * x / s.scale))
        assert (rate * x).sum() == pytest.approx(s.target, rel=1e-5)


def test_jaccard_documents(spark):
    docs = read(spark, SMALL, "documents")
    texts = sorted((r.doc_id, r.text) for r in docs.collect())
    sets = [data.shingles(t) for _, t in texts]
    roots = data.linked(sets)
    want = [(i, len(s), texts[r][0]) for (i, _), s, r in zip(texts, sets, roots)]
    assert data.pairs(jaccard_join.jaccard_components(docs).collect(), "doc_id", "n_shingles", "component_id") == want
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({texts[r][0] for r in roots})


def test_jaccard_small_batches(spark):
    """While sets are looked for, tasks get Arrow batches of a few MB, however many rows Spark would put into one."""
    def held(batches):
        for batch in batches:
            assert batch.num_rows == 1 or batch.nbytes <= 6 << 20, f"a batch of {batch.nbytes} bytes"
            yield batch

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    texts = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("word "), 1000), "id").alias("text"))
    found = jaccard_join.jaccard_components(texts.mapInArrow(held, texts.schema))
    assert found.count() == 3000 and spark.conf.get(name) == before


def test_jaccard_odd_rows(spark):
    rows = sorted(data.odd_rows(), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [data.shingles(r[1]) for r in rows]
    want = order((r[0], len(s), r[0] if not s else rows[k][0]) for r, s, k in zip(rows, sets, data.linked(sets)))
    assert data.pairs(jaccard_join.jaccard_components(data.odd(spark)).collect(), "doc_id", "n_shingles", "component_id") == want
    assert jaccard_join.jaccard_components(data.empty(spark)).collect() == []
    assert jaccard_join.one_of_each(data.empty(spark)).collect() == []


def test_jaccard_at_the_threshold_and_chains(spark):
    """Pairs just at, above and below 0.75, chains of links, and a group that shares one passage."""
    rows, words = [], [f"w{i}" for i in range(4000)]
    for k, n in enumerate((60, 300, 700, 1500)):
        base = words[k * 900:k * 900 + n + 4]  # n shingles
        for j, cut in enumerate((n // 4 - 1, n // 4, n // 4 + 1)):
            rows.append((f"{k}{j}", " ".join(base[cut:])))  # a subset with n - cut of n shingles
        rows.append((f"{k}9", " ".join(base)))
    chain = data.prose(11, 400).split()
    for step in range(12):
        rows.append((f"c{step:02}", " ".join(w if i >= step * 12 else f"z{i}" for i, w in enumerate(chain))))
    passage = data.prose(12, 60)
    rows += [(f"p{i:02}", f"{data.prose(100 + i, 40)} {passage} {data.prose(200 + i, 30)}") for i in range(40)]
    rows.sort()
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    sets = [data.shingles(t) for _, t in rows]
    want = [(i, len(s), rows[r][0]) for (i, _), s, r in zip(rows, sets, data.linked(sets))]
    assert data.pairs(jaccard_join.jaccard_components(docs).collect(), "doc_id", "n_shingles", "component_id") == want


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 1200), st.floats(0, 1), st.integers(0, 2**32))
def test_similar_sets_share_signatures(size, part, seed):
    """The bound itself: a similar pair differs in at most k signatures of its band, and both have more than k."""
    bands, pick = jaccard_join.Bands(), np.random.default_rng(seed)
    larger = size + int(part * (bands.partner(size) - size))
    most = 25 * (size + larger) // 175
    gone = min((most - (larger - size)) // 2, size)
    pool = pick.integers(0, 2**63, size + larger, dtype=np.uint64)
    a, b = np.unique(pool[:size]), np.unique(np.r_[pool[gone:size], pool[size:larger + gone]])
    assert 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
    mine, theirs = dict(jaccard_join.signatures(a, bands, 0)), dict(jaccard_join.signatures(b, bands, 0))
    x, y = mine[bands.band(len(b))], theirs[bands.band(len(b))]
    assert len(x) > bands.most_different(len(a)) and len(y) > bands.most_different(len(b))
    differ = 25 * (len(a) + len(b)) // 175
    assert len(np.intersect1d(x, y)) >= max(1, max(len(x), len(y)) - differ)


@pytest.mark.parametrize("piece,most", [(1, 1), (2, 7), (5, 100), (1000, 100)])
def test_shared_signatures(spark, monkeypatch, piece, most):
    monkeypatch.setattr(jaccard_join, "DEALT_ROWS", 2 * most)
    entries = [(s, k) for s in range(30) for k in range(1 + 7 * (s % 5))] * 2
    np.random.default_rng(1).shuffle(entries)
    rows = []
    for bucket in range(3):
        mine = np.array([e for e in entries if e[0] % 3 == bucket])
        rows += [(bucket, mine[i:i + piece, 0].astype(np.uint64).tobytes(), mine[i:i + piece, 1].astype(np.int64).tobytes()) for i in range(0, len(mine), piece)]
    got = sorted(map(tuple, jaccard_join.shared_signatures(spark.createDataFrame(rows, "bucket long, sigs binary, sets binary")).collect()))
    assert got == sorted({tuple(map(int, e)) for e in entries if e[0] % 5})


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 4)), min_size=1, max_size=12), max_size=6))
def test_met(batches):
    met, got = jaccard_join.Met(), []
    for batch in batches:
        sig, key = np.array([b[0] for b in batch], np.uint64), np.array([b[1] for b in batch], np.int64)
        got += list(zip(*(x.tolist() for x in met.add(sig, key))))
    owners = defaultdict(set)
    for s, k in (e for batch in batches for e in batch):
        owners[s].add(k)
    assert set(got) == {(s, k) for s, ks in owners.items() if len(ks) > 1 for k in ks}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\x0b\x0c\raAbÉ\x1c\x85\u3000\x00", max_size=30)), max_size=5))
def test_shingles(texts):
    sets = jaccard_join.shingle_sets(pa.array(texts, pa.string()))
    plain = [data.shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in plain]
    for a in range(len(texts)):
        for b in range(a):
            assert len(np.intersect1d(sets[a], sets[b])) == len(plain[a] & plain[b])


def test_blocks_find_every_pair(spark):
    """Sets in blocks of three: all pairs in different components with enough common signatures, none twice."""
    pick = np.random.default_rng(3)
    base = pick.integers(0, 2**40, 60) * 32
    sets = [(k, [int(x) for x in pick.permutation(base)[:int(n)]] + [int(x) for x in pick.integers(2**41, 2**42, 60 - int(n)) * 32])
            for k, n in enumerate(pick.integers(40, 60, 20))]
    rows = [(sig, k, 0, 60, 60, k // 2, 1) for k, sigs in sets for sig in sigs]
    df = spark.createDataFrame(rows, "sig long, set long, band long, size int, held int, root long, weight long")
    got = [tuple(r) for r in jaccard_join.block_pairs(df, 75, 3).collect()]
    want = {}
    for a, x in sets:
        for b, y in sets:
            if a < b and a // 2 != b // 2 and len(set(x) & set(y)) >= 0.75 * len(set(x) | set(y)):
                want.setdefault((a // 2, b // 2), set()).add((a, b))
    ends = {tuple(sorted((a // 2, b // 2))) for a, b in got}
    assert ends == set(want) and len(want) > 5 and set(got) <= set().union(*want.values())


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 15), st.integers(0, 15)), min_size=1, max_size=20), st.integers(0, 20))
def test_components(spark, links, first):
    root = list(range(16))
    for _ in range(16):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    schema = "a long, b long"
    known = jaccard_join.components(spark.createDataFrame(links[:first], schema)) if links[:first] else None
    got = {r.node: r.root for r in jaccard_join.components(spark.createDataFrame(links, schema), known).collect()}
    assert all(got.get(i, i) == root[i] for i in range(16))


def test_one_look_gives_texts_and_live_signatures(spark):
    """From one look at the texts: each text's row once, and the signatures that sets share, of the sets that may have a partner."""
    bands, passage = jaccard_join.Bands(), data.prose(12, 60)
    texts = [f"{data.prose(100 + i, 40)} {passage} {data.prose(200 + i, 30)}" for i in range(6)]
    texts += [data.prose(7, 400), "x " + data.prose(7, 400), data.prose(8, 200), data.prose(8, 200), None, "", "one"] * 2
    rows = jaccard_join.ids_and_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), "doc_id", "text")
    looked = jaccard_join.live_or_rows(jaccard_join.shared_or_rows(jaccard_join.dealt_rows(rows, bands, 5, 0, 3)), 75).collect()
    sets = jaccard_join.shingle_sets(pa.array(texts, pa.string()))
    keys = [jaccard_join.set_key(s) if len(s) else None for s in sets]
    assert sorted((r.row.id, r.row.set or 0, r.row.size) for r in looked if r.row) == [(i, k or 0, len(s)) for i, (k, s) in enumerate(zip(keys, sets))]
    owners, held = defaultdict(set), {}
    for key, s in zip(keys, sets):
        for band, found in jaccard_join.signatures(s, bands, 0) if len(s) else []:
            held[key, band] = len(s), len(found)
            for sig in found.tolist():
                owners[sig % 2**48].add((key, band))
    shared = defaultdict(set)
    for sig, who in owners.items():
        for entry in who if len(who) > 1 else ():
            shared[entry].add(sig)
    want = {(sig, key, band, *held[key, band]) for (key, band), found in shared.items()
            if held[key, band][1] - len(found) <= bands.most_different(held[key, band][0]) for sig in found}
    got = [(r.sig % 2**48, r.set, r.band, r.size, r.held) for r in looked if r.sig is not None]
    assert want and len(got) == len(want) and set(got) == want


def test_between_shuffles_entries_once(spark):
    entries = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (2, 1, 1), (2, 3, 3), (3, 3, 3)], "sig long, set long, root long")
    found = jaccard_join.between(entries)
    assert sorted(map(tuple, found.collect())) == [(2, 1, 1), (2, 3, 3)]
    assert found._jdf.queryExecution().sparkPlan().toString().count("Aggregate") == 0
    assert found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange hash") == 1


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30)), max_size=9), st.lists(st.sets(st.integers(0, 30)), max_size=9), st.sampled_from([1, 7, 2000]), st.integers(1, 20))
def test_common_counts(one, two, rare, piece):
    """Elements of few pairs are counted pair by pair, others by products: the counts are the same."""
    got = jaccard_join.common_counts([sorted(s) for s in one], [sorted(s) for s in two], 4, rare, piece)
    assert got.tolist() == [[len(a & b) for b in two] for a in one]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(-9, 9), st.tuples(st.integers(1, 600), st.sets(st.integers(0, 9)), st.sets(st.integers(0, 9)), st.integers(0, 3)), max_size=6),
       st.integers(1, 9), st.randoms())
def test_alive(sets, piece, pick):
    rows, want = [], set()
    for key, (size, own, follow, alone) in sorted(sets.items()):
        band = jaccard_join.Bands.band(size)
        mine = [(key, 0, True, size, len(own) + alone, len(follow) + alone)] * 2
        for b, found in ((band, own), (band + 1, follow)):
            mine += [(key, 32 * s + b, False, 0, 0, 0) for s in found] * 2
            if alone <= jaccard_join.Bands().most_different(size):
                want |= {(32 * s + b, key, b, size, len(found) + alone) for s in found}
        pick.shuffle(mine)
        rows += mine
    alive, got = jaccard_join.Alive(75), []
    for i in range(0, len(rows), piece):
        got += zip(*(c.tolist() for c in alive.add(*(np.array(c) for c in zip(*rows[i:i + piece])))))
    got += zip(*(c.tolist() for c in alive.rest()))
    assert len(got) == len(want) and set(got) == want
