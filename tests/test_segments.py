"""Segment and scene merging against the step-by-step procedures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediatimeline.operators import segments as seg
from mediatimeline.operators.ordered import NO_CUTS, find_cuts

BLANKS = (" ", "  ", "\u00a0", "\n", "\u3000", "\x1f")
WORDS = "one two three And But so. then yes! what? alpha beta".split()


def speech(seed, n=120):
    rng = random.Random(seed)
    rows, end = [], {}
    for i in range(n):
        m = 1 if rng.random() < 0.7 else 2
        start = end.get(m, 0.0) + rng.choice([0.0, 0.29, 0.3, 0.5, 0.8, 1.0, 2.0])
        stop = round(start + rng.choice([0.5, 1.0, 2.4, 2.5, 4.0]), 3)
        end[m] = stop
        text = rng.choice(BLANKS).join(rng.choice(WORDS) for _ in range(rng.randint(0, 6))) + rng.choice(("", "", " ", "\n", "\u00a0"))
        if seed == 5 and i % 3:
            text = rng.choice(("", " ", "\u2003"))
        rows.append((m, i, round(start, 3), stop, text, rng.randint(1, 10) / 10))
    return rows


def fold(rows):
    """The left fold, written out."""
    out, cur = [], list(rows[0][2:])
    for r in rows[1:]:
        text, nxt = cur[2].strip(), r[4].strip()
        length, gap, extra = cur[1] - cur[0], r[2] - cur[1], r[3] - r[2]
        open_end = bool(text) and not text.endswith((".", "!", "?", ":")) and not nxt.startswith(seg.OPENERS)
        if length < 2.5 or gap < 0.8 or open_end or len(text.split()) < 4 or len(nxt.split()) < 3:
            total = length + extra
            conf = (cur[3] * length + r[5] * extra) / total if total > 0 else cur[3]
            cur = [cur[0], r[3], text + (" " if gap < 0.3 else "... ") + nxt, conf]
        else:
            out.append(cur)
            cur = list(r[2:])
    return out + [cur]


@pytest.mark.parametrize("seed", [1, 2, 3, 4, 5, 6])
def test_merge_segments(spark, seed):
    rows = speech(seed, 120 if seed < 6 else 1500)
    df = spark.createDataFrame(rows, "media_id int, ordinal bigint, start double, end double, text string, confidence double")
    want = []
    for m in (1, 2):
        for s, e, text, conf in fold([r for r in rows if r[0] == m]):
            want.append((m, s, e, " ".join(text.split()), round(conf, 9)))
    for cuts in (NO_CUTS, find_cuts(df, by=("start", "ordinal"), rows=15 if seed < 6 else 400)):
        out = seg.merge_segments(df, cuts=cuts).collect()
        got = [(r["media_id"], r["start"], r["end"], r["text"], round(r["confidence"], 9)) for r in out]
        assert sorted(got) == sorted(want)


def test_merge_segments_carries_fields(spark):
    rows = [(1, 0, 0.0, 1.0, "one two", 0.5, "ann", ["one", "two"]), (1, 1, 1.1, 2.0, "three.", 0.5, "bob", ["three"]),
            (1, 2, 2.1, 3.0, "more", 0.5, "bob", None), (1, 3, 3.1, 9.0, "and a full stop.", 0.5, "eve", ["x"]),
            (1, 4, 12.0, 13.0, "a new one here", 0.5, "eve", [])]
    df = spark.createDataFrame(rows, "media_id int, ordinal bigint, start double, end double, text string, confidence double, speaker string, words array<string>")
    out = sorted(seg.merge_segments(df, first=("speaker",), lists=("words",)).collect())
    assert [(r.parts, r.speaker, r.words) for r in out] == [(4, "ann", ["one", "two", "three", "x"]), (1, "eve", [])]


def cos(a, b):
    return float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))


def nearest(vectors, t):
    return min(vectors, key=lambda v: (abs(v[0] - t), v[0]))[1]


def greedy(scenes, vectors, threshold, rounds):
    for n in range(1, rounds + 1):
        out, i, changed = [], 0, False
        while i < len(scenes):
            if i + 1 < len(scenes):
                a, b = scenes[i], scenes[i + 1]
                if cos(nearest(vectors, (a[0] + a[1]) / 2), nearest(vectors, (b[0] + b[1]) / 2)) > threshold:
                    out.append((a[0], b[1], min(a[2], b[2]), a[3] + b[3] + 1))
                    i, changed = i + 2, True
                    continue
            out.append(scenes[i])
            i += 1
        scenes = out
        if not changed:
            break
    return scenes, n


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(4)
    rows, vectors = [], {}
    for m in (1, 2):
        base = rng.normal(size=4)
        for i in range(30 if m == 1 else 9):
            base = base * 0.8 + rng.normal(size=4) * 0.8
            vectors.setdefault(m, []).append((i + 0.5, base.astype(np.float32).astype(float)))
            rows.append((m, i, i + 0.5, base.astype(np.float32).tolist()))
    df = spark.createDataFrame(rows, "media_id int, ordinal bigint, t double, embedding array<float>")
    return df, vectors


@pytest.mark.parametrize("rounds", [1, 5])
def test_merge_similar(spark, frames, rounds):
    df, vectors = frames
    scenes, want, steps = [], [], []
    for m, vs in vectors.items():
        mine = [(float(i), i + 1.0, (i % 7) / 7, 0) for i in range(len(vs))]
        scenes += [(m, i + 1, s, e, c, "normal", 0, 0) for i, (s, e, c, _) in enumerate(mine)]
        merged, n = greedy(mine, vs, 0.3, rounds)
        want += [(m, *x) for x in merged]
        steps.append((m, n))
    sdf = spark.createDataFrame(scenes, "media_id int, scene_id bigint, start double, end double, confidence double, semantic_type string, merge_count int, split_count int")
    for cuts in (NO_CUTS, find_cuts(df, rows=10)):
        out = seg.merge_similar(sdf, df, 0.3, rounds, cuts=cuts).collect()
        assert sorted((r["media_id"], r["start"], r["end"], r["confidence"], r["merge_count"]) for r in out) == sorted(want)
        assert {(r["media_id"], r["stability_iterations"]) for r in out} == set(steps)
        for m in vectors:  # alone or together, a media's rows are the same
            alone = seg.merge_similar(sdf.where(F.col("media_id") == m), df, 0.3, rounds, cuts=cuts).collect()
            assert sorted(map(str, alone)) == sorted(str(r) for r in out if r["media_id"] == m)
        assert all((r["semantic_type"] == "merged") == (r["merge_count"] > 0) for r in out)


def test_split_dissimilar(spark, frames):
    df, vectors = frames
    spans = [(1, 1, 0.0, 3.99), (1, 2, 4.0, 8.0), (1, 3, 8.0, 14.0), (1, 4, 14.0, 30.0), (2, 1, 0.0, 9.0)]
    want = []
    for m, k, s, e in spans:
        cuts, every = [], max(1.0, (e - s) / 5)
        if e - s >= 4:
            times, t = [], s + every
            while t < e - every:
                times.append(t)
                t += every
            for a, b in zip(times, times[1:]):
                if cos(nearest(vectors[m], a), nearest(vectors[m], b)) < 0.7 and b - s >= 2 and e - b >= 2:
                    cuts.append(b)
        edges = [s, *cuts, e]
        want += [(m, k, a, b, "split" if cuts else "normal") for a, b in zip(edges, edges[1:])]
    sdf = spark.createDataFrame([(*x, "normal", 0) for x in spans], "media_id int, scene_id bigint, start double, end double, semantic_type string, split_count int")
    out = seg.split_dissimilar(sdf, df, 0.7).collect()
    assert sorted((r["media_id"], r["scene_id"], r["start"], r["end"], r["semantic_type"]) for r in out) == sorted(want)
    assert any(w[4] == "split" for w in want)


def test_ward_merging_takes_the_cheapest_neighbours():
    def plain(points, weights, k):
        means, sizes, lefts = list(points), list(weights), list(range(len(points)))
        while len(means) > k:
            costs = [a * b / (a + b) * float(((x - y) ** 2).sum()) for a, b, x, y in zip(sizes, sizes[1:], means, means[1:])]
            i = costs.index(min(costs))
            total = sizes[i] + sizes[i + 1]
            means[i:i + 2] = [(means[i] * sizes[i] + means[i + 1] * sizes[i + 1]) / total]
            sizes[i:i + 2] = [total]
            del lefts[i + 1]
        return lefts

    rng = np.random.default_rng(1)
    for _ in range(100):
        n, k = int(rng.integers(8, 40)), int(rng.integers(1, 8))
        points, weights = rng.integers(0, 4, (n, 2)).astype(float), rng.integers(1, 4, n).astype(float)
        assert seg._ward_boundaries(points, weights, k) == plain(points, weights, k)


def test_structural_resolution_does_not_depend_on_length(spark):
    rows = [(1, i, float(i), [float(i // 7 * 10), 1.0]) for i in range(35)]
    longer = rows + [(1, i, float(i), [40.0, 1.0]) for i in range(35, 3000)]
    sections = []
    for r in (rows, longer):
        df = spark.createDataFrame(r, "media_id int, ordinal bigint, t double, embedding array<double>")
        dur = spark.createDataFrame([(1, float(len(r)))], "media_id int, duration double")
        sections.append([x["start"] for x in seg.structural_segments(df, dur).orderBy("segment").collect()])
    assert sections[0] == sections[1] == [0.0, 7.0, 14.0, 21.0, 28.0]


def test_structural_blocks(spark):
    rows = [(1, i, float(i), [float(i // 20 * 10), 1.0]) for i in range(100)] + [(2, i, float(i), [1.0, 1.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "media_id int, ordinal bigint, t double, embedding array<double>")
    dur = spark.createDataFrame([(1, 100.0), (2, 90.0)], "media_id int, duration double")
    for cuts in (NO_CUTS, find_cuts(df, rows=20)):
        got = seg.structural_segments(df, dur, cuts=cuts).orderBy("media_id", "segment").collect()
        assert [(r["start"], r["end"]) for r in got if r["media_id"] == 1] == [(i * 20.0, i * 20.0 + 20) for i in range(5)]
        assert [(r["start"], r["end"]) for r in got if r["media_id"] == 2] == [(0.0, 30.0), (30.0, 60.0), (60.0, 90.0)]
    open_tail = seg.structural_segments(df, dur, close_tail=False).filter("media_id = 1").count()
    assert open_tail == 4
