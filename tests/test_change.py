"""Change, run and streak operators against straightforward loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediatimeline.functions import framing
from mediatimeline.operators import change
from mediatimeline.operators.intervals import cut_scenes
from mediatimeline.operators.ordered import NO_CUTS, find_cuts


@pytest.fixture(scope="module", params=["plain", "cut"])
def data(request, spark):
    rng = random.Random(7)
    rows = [(1 if rng.random() < 0.6 else rng.randint(2, 4), i, rng.randint(0, 60) / 4, rng.choice(["A", "A", "B", None]), rng.randint(0, 10) / 10, rng.choice("xy"))
            for i in range(200)]
    df = spark.createDataFrame(rows, "media_id int, ordinal bigint, t double, label string, confidence double, category string")
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        groups.setdefault(r[0], []).append(r)
    return df, groups, NO_CUTS if request.param == "plain" else find_cuts(df, rows=15)


def test_gated_change_is_the_fold(data):
    df, groups, cuts = data
    want = []
    for rows in groups.values():
        last = None
        for r in rows:
            if r[4] > 0.6 and r[3] != last:
                want.append((r[1], last, r[3]))
                last = r[3]
    got = change.gated_label_change(df, cuts=cuts).select("ordinal", "prev_label", "label").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_run_spans_is_the_loop(data):
    df, groups, cuts = data
    want = []
    for m, rows in groups.items():
        label, start, members = rows[0][3], rows[0][2], [rows[0]]
        for i in range(1, len(rows)):
            r = rows[i]
            if r[3] != label or r[4] < 0.6:
                mean = np.mean([x[4] for x in rows[:i] if x[3] == label])
                want.append((m, label, start, r[2], round(float(mean), 9), common(members)))
                label, start, members = r[3], r[2], [r]
            else:
                members.append(r)
        want.append((m, label, start, 99.0, rows[-1][4], common(members)))
    out = change.run_spans(df.withColumn("duration", F.lit(99.0)), cuts=cuts, category="category").collect()
    got = [(r["media_id"], r["label"], r["start"], r["end"], round(r["confidence"], 9), r["category"]) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)


def common(members):
    seen = [m[5] for m in members]
    return max(dict.fromkeys(seen), key=seen.count)


def test_breaker_is_the_loop(data):
    df, groups, cuts = data
    want = {}
    for rows in groups.values():
        streak, stopped = 0, False
        for r in rows:
            streak = streak + 1 if r[3] == "A" else 0
            want[r[1]] = (streak, streak >= 3, stopped)
            stopped = stopped or streak >= 3
    out = change.circuit_breaker(df, F.col("label") == "A", keys=("media_id",), by=("t", "ordinal"), cuts=cuts)
    assert {r["ordinal"]: (r["streak"], r["tripped"], r["stopped"]) for r in out.collect()} == want


def test_breaker_success_between(spark):
    rows = [(1, i, i, s) for i, s in enumerate("FFFSFFFF")]
    df = spark.createDataFrame(rows, "batch_id int, item bigint, seq bigint, status string")
    out = change.circuit_breaker(df, F.col("status") == "F").orderBy("item").collect()
    assert [r["streak"] for r in out] == [1, 2, 3, 0, 1, 2, 3, 4]
    assert [r["stopped"] for r in out] == [False] * 3 + [True] * 5


def test_first_row_and_gate(spark):
    df = spark.createDataFrame([(1, 0, 0.0, "A", 0.9), (1, 1, 1.0, "b", 0.6), (1, 2, 2.0, "A", 0.9), (1, 3, 3.0, None, 0.9)],
                               "media_id int, ordinal bigint, t double, label string, confidence double")
    assert [r["ordinal"] for r in change.gated_label_change(df).orderBy("t").collect()] == [0, 3]
    assert [r["ordinal"] for r in change.label_change(df).orderBy("t").collect()] == [1, 2]
    steps = df.withColumn("value", F.element_at(F.array(*[F.lit(x) for x in (10.0, 20.0, 30.5, 1.0)]), (F.col("ordinal") + 1).cast("int")))
    got = change.numeric_change(steps).orderBy("t").collect()
    assert [(r["ordinal"], r["delta"]) for r in got] == [(2, 10.5), (3, 29.5)]
    assert got[1]["change_confidence"] == 0.95


def test_pause_speakers(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 3.0, 4.0), (1, 2, 6.1, 7.0), (2, 0, 0.0, 1.0)], "media_id int, ordinal bigint, start double, end double")
    got = change.pause_speakers(df).orderBy("media_id", "ordinal").collect()
    assert [r["speaker"] for r in got] == ["Speaker_1", "Speaker_1", "Speaker_2", "Speaker_1"]


@pytest.mark.parametrize("n", [90, 91])
def test_strong_peaks(spark, n):
    rng = random.Random(n)
    peaks = [(1, i, float(i)) for i in range(n)]
    strength = [(1, i, i * 2.0 + 0.5, rng.random()) for i in range(60)]
    p = spark.createDataFrame(peaks, "media_id int, ordinal bigint, t double")
    s = spark.createDataFrame(strength, "media_id int, ordinal bigint, t double, strength double")
    kept = [x[1] for x in peaks]
    if n > 90:
        floor = np.percentile([x[3] for x in strength], 50)
        times = np.array([x[2] for x in strength])
        kept = [x[1] for x in peaks if strength[int(np.argmin(np.abs(times - x[2])))][3] > floor]
    total = min(len(kept), 15) if n > 90 else len(kept)
    for cuts in (NO_CUTS, find_cuts(p, rows=20)):
        by_strength = NO_CUTS if not cuts.hot else find_cuts(s, by=("strength", "ordinal"), rows=20)
        got = change.strong_peaks(p, s, cuts=cuts, strength_cuts=by_strength).orderBy("t").collect()
        assert [(r["ordinal"], r["onset_index"], r["total_onsets"]) for r in got] == [(x, i, total) for i, x in enumerate(kept[:15])]


def test_smoothing(spark):
    def series(media, n, f):
        return [(media, i, float(i), float(f(i))) for i in range(n)]
    rng = np.random.default_rng(1)
    noise = rng.random(130)
    rows = series(1, 51, lambda i: (i * 7) % 5) + series(2, 52, lambda i: i**3 - 4 * i) + series(3, 130, lambda i: noise[i])
    df = spark.createDataFrame(rows, "media_id int, ordinal bigint, t double, value double")
    for cuts in (NO_CUTS, find_cuts(df, rows=40)):
        out = framing.smooth_savgol(df, "value", cuts=cuts).orderBy("media_id", "ordinal").collect()
        by = {m: [r["smoothed"] for r in out if r["media_id"] == m] for m in (1, 2, 3)}
        assert by[1] == [(i * 7) % 5 for i in range(51)]
        assert np.allclose(by[2], [i**3 - 4 * i for i in range(52)], atol=1e-5)
        for i in (0, 10, 25, 60, 104, 105, 129):
            start = min(max(i - 25, 0), 79)
            fit = np.polyfit(np.arange(51), noise[start:start + 51], 3)
            assert abs(by[3][i] - np.polyval(fit, i - start)) < 1e-8


def test_scene_cuts(spark):
    df = spark.createDataFrame([(1, i, s, 25.0) for i, s in enumerate([0, 30, 5, 27, 26])], "media_id int, frame bigint, score int, fps double")
    got = cut_scenes(df, 27).orderBy("scene_id").collect()
    assert [(r["scene_id"], r["start_frame"], r["end_frame"]) for r in got] == [(1, 0, 1), (2, 1, 3), (3, 3, None)]


def test_windows_and_segments(spark):
    media = spark.createDataFrame([(1, 48.0), (2, 60.5), (3, 10.0)], "media_id int, duration double")
    got = framing.window_starts(media, 48.0, 12.0).collect()
    assert sorted((r["media_id"], r["start"]) for r in got) == [(2, 0.0), (2, 12.0)]
    rows = spark.createDataFrame([(2, float(t)) for t in (0, 11, 12, 47, 48, 59, 60)], "media_id int, t double").join(media, "media_id")
    listed = framing.sliding_windows(rows, 48.0, 12.0).collect()
    assert sorted((r["win"], r["t"]) for r in listed) == sorted(
        (w, t) for t in (0.0, 11.0, 12.0, 47.0, 48.0, 59.0, 60.0) for w in (0, 1) if w * 12 <= t < w * 12 + 48)
    lengths = spark.createDataFrame([(i, x) for i, x in enumerate((0.0, 119.0, 120.0, 121.0, 30.5))], "media_id int, duration double")
    fixed = framing.fixed_segments(lengths, 120.0).collect()
    assert sorted((r["media_id"], r["end"]) for r in fixed) == [(1, 119.0), (2, 120.0), (3, 120.0), (3, 121.0), (4, 30.5)]
    whole = framing.fixed_segments(lengths.filter("media_id = 4"), 30.0, truncate=True).collect()
    assert [(r["start"], r["end"]) for r in whole] == [(0.0, 30.0)]
    tail = spark.createDataFrame([(1, 10.5, 11.0), (2, 10.5, 11.5)], "media_id int, t double, duration double")
    assert [r["media_id"] for r in framing.tumbling_segments(tail, 10.0, 1.0).collect()] == [2]


def test_waveform_features(spark):
    rate = 8000.0
    x = np.arange(1600) / rate
    wave = [(1, np.sin(2 * np.pi * 200 * x).tolist()), (2, np.sin(2 * np.pi * 1000 * x).tolist()), (3, [0.0] * 64)]
    df = spark.createDataFrame(wave, "media_id int, samples array<double>")
    got = {r["media_id"]: r for r in df.select("media_id", framing.spectral_features(rate)("samples").alias("s"), framing.f0_autocorr(rate)("samples").alias("f0")).collect()}
    assert abs(got[1]["f0"] - 200) < 1e-9 and got[3]["f0"] == 0.0
    assert abs(got[2]["s"]["centroid"] - 1000) < 1 and abs(got[2]["s"]["rolloff"] - 1000) < 10 and got[3]["s"]["centroid"] == 0.0
    odd = spark.createDataFrame([(1, [float(v) for v in np.random.default_rng(1).normal(size=64)]), (2, [1.0] * 7), (3, [0.5]), (4, []), (5, [0.0] * 64)], "media_id int, samples array<double>")
    short = {r["media_id"]: r for r in framing.short_f0(framing.short_spectral_features(odd, "samples", rate), "samples", rate, 300, 2000).collect()}
    long = {r["media_id"]: r for r in odd.select("media_id", framing.spectral_features(rate)("samples").alias("s"), framing.f0_autocorr(rate, 300, 2000)("samples").alias("f0")).collect()}
    for m in long:
        assert np.allclose([*short[m]["s"], short[m]["f0"]], [*long[m]["s"], long[m]["f0"]], atol=1e-3), (m, short[m], long[m])
    pcm = spark.createDataFrame([(1, "int16", [16384, -16384, 32767, 1]), (2, "uint8", [0, 128, 255, 1])], "id int, dtype string, s array<int>")
    mono = {r["id"]: r["m"] for r in pcm.select("id", framing.normalise("s", "dtype", 2).alias("m")).collect()}
    assert mono[1] == [0.0, 0.5] and mono[2][0] == -0.5
