"""Interval and nearest joins against every pair, on data with a hot media and a hot instant."""

import random

import pytest
from pyspark.sql import functions as F

from mediatimeline.operators import intervals
from mediatimeline.operators.joins import events_in_spans, nearest, overlaps
from mediatimeline.operators.ordered import NO_CUTS, find_cuts
from tests.conftest import plan_of


def make(seed=3):
    rng = random.Random(seed)
    pick = lambda: 1 if rng.random() < 0.5 else rng.randint(2, 5)
    events = [(pick(), i, 20.0 if rng.random() < 0.3 else float(rng.randint(-20, 120)) / 2) for i in range(250)]
    spans = []
    for i in range(80):
        start = float(rng.randint(-20, 120)) / 2
        spans.append((pick(), i, start, start + rng.choice([0.0, 0.5, 3.0, 30.0, 500.0, 9000.0])))
    return events, spans


@pytest.fixture(scope="module", params=["plain", "cut"])
def data(request, spark):
    events, spans = make()
    e = spark.createDataFrame(events, "media_id int, ordinal bigint, t double")
    s = spark.createDataFrame(spans, "media_id int, span_ordinal bigint, start double, end double")
    return e, s, events, spans, NO_CUTS if request.param == "plain" else find_cuts(e, rows=12)


@pytest.mark.parametrize("longest", [None, 9000.0, 1.0])
def test_events_in_spans(data, longest):
    e, s, events, spans, cuts = data
    rows = events_in_spans(e, s, 2.0, cuts=cuts, longest=longest).select("ordinal", "span_ordinal").collect() if longest != 1.0 else \
        events_in_spans(e, s.filter("end - start < 50"), 2.0, cuts=cuts, longest=longest).select("ordinal", "span_ordinal").collect()
    want = sorted((a[1], b[1]) for a in events for b in spans
                  if a[0] == b[0] and b[2] <= a[2] <= b[3] and (longest != 1.0 or b[3] - b[2] < 50))
    assert sorted((r[0], r[1]) for r in rows) == want
    found = events_in_spans(e, s, 2.0, how="left_semi", cuts=cuts)
    assert sorted(r["ordinal"] for r in found.collect()) == sorted({a[1] for a in events for b in spans if a[0] == b[0] and b[2] <= a[2] <= b[3]})


def test_overlaps(data):
    _, s, _, spans, _ = data
    r = s.select("media_id", F.col("span_ordinal").alias("other"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    want = sorted((a[1], b[1]) for a in spans for b in spans if a[0] == b[0] and min(a[3], b[3]) - max(a[2], b[2]) > 0)
    for longest in (None, 9000.0):
        got = sorted((x["span_ordinal"], x["other"]) for x in overlaps(s, r, 4.0, longest=longest).collect())
        assert got == want


def test_nearest(data, spark):
    e, _, events, _, cuts = data
    others = [(m, i, t) for m, i, t in make(9)[0] if m != 3][:60]
    o = spark.createDataFrame(others, "media_id int, ordinal bigint, t double")
    got = {r["ordinal"]: (r["distance"], r["who"]) for r in nearest(e, o, cuts=cuts, payload={"who": F.col("ordinal")}).collect()}
    assert len(got) == len(events)
    for m, i, t in events:
        mine = [(abs(t - x[2]), x[2], x[1]) for x in others if x[0] == m]
        best = min(mine) if mine else (None, None, None)
        assert got[i] == (best[0], best[2])


def test_no_products(data):
    e, s, _, _, cuts = data
    for df in (events_in_spans(e, s, 2.0, cuts=cuts, longest=9000.0), nearest(e, e, cuts=cuts)):
        plan = plan_of(df)
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_later_span_wins(data):
    e, s, events, spans, cuts = data
    pairs = events_in_spans(e, s, 2.0, cuts=cuts)
    for by in ("time", "event"):
        best = {}
        for a in events:
            for b in spans:
                if a[0] == b[0] and b[2] <= a[2] <= b[3]:
                    k = (a[0], a[2]) if by == "time" else (a[0], a[2], a[1])
                    best[k] = max(best.get(k, (-1e9, 0, 0)), (b[2], b[1], a[1]))
        got = intervals.later_span_wins(pairs, by).collect()
        assert sorted((r["media_id"], r["t"], r["span_ordinal"], r["ordinal"]) for r in got) == sorted((k[0], k[1], v[1], v[2]) for k, v in best.items())


def test_assign_by_overlap_ties_and_fallback(spark):
    segs = spark.createDataFrame([(1, 0, 0.0, 2.0), (1, 1, 2.0, 4.0), (1, 2, 10.0, 11.0), (1, 3, 12.0, 13.0)],
                                 "media_id int, ordinal bigint, start double, end double")
    turns = spark.createDataFrame([(1, 0, 0.0, 1.0, "A"), (1, 1, 1.0, 2.0, "B"), (1, 2, 2.5, 4.0, "C"), (1, 3, 2.0, 2.5, "D")],
                                  "media_id int, ordinal bigint, start double, end double, speaker string")
    got = {r["ordinal"]: r["speaker"] for r in intervals.assign_by_overlap(segs, turns, 1.0).collect()}
    assert got == {0: "A", 1: "C", 2: "Speaker_1", 3: "Speaker_2"}
    plain = intervals.assign_by_overlap(segs, turns, 1.0, alternate=False).filter("ordinal = 3").first()
    assert plain["speaker"] == "Unknown"


def test_filter_artifacts_order_of_rules(spark):
    events = [  # t, text, kept?
        (0.4, "Musical Onset", True),      # near the start of the media
        (10.5, "Musical Onset", True),     # exactly .5 from a segment edge
        (12.0, "Musical Onset", False),    # in speech, close to a reference
        (12.0, "Tempo Change", True),      # in speech, but a tempo change
        (15.0, "Musical Onset", True),     # farther than .7 from every reference
        (30.0, "Musical Onset", True),     # outside speech
    ]
    e = spark.createDataFrame([(1, i, t, d) for i, (t, d, _) in enumerate(events)], "media_id int, ordinal bigint, t double, description string")
    speech = spark.createDataFrame([(1, 0, 10.0, 20.0)], "media_id int, ordinal bigint, start double, end double")
    ref = spark.createDataFrame([(1, 0, 12.5), (1, 1, 30.0), (1, 2, 10.5), (1, 3, 0.4)], "media_id int, ordinal bigint, t double")
    dur = spark.createDataFrame([(1, 40.0)], "media_id int, duration double")
    got = {r["ordinal"] for r in intervals.filter_artifacts(e, speech, ref, dur, 5.0).collect()}
    assert got == {i for i, x in enumerate(events) if x[2]}
    # Without any reference event that rule is skipped.
    none = intervals.filter_artifacts(e, speech, ref.limit(0), dur, 5.0)
    assert {r["ordinal"] for r in none.collect()} == {0, 1, 3, 5}


def test_pad_and_trim_and_chunks(spark):
    r = spark.createDataFrame([(1, 0, 0.1, 1.0, 9.0), (1, 1, 1.3, 2.0, 9.0), (1, 2, 4.0, 8.9, 9.0)],
                              "media_id int, ordinal bigint, start double, end double, total double")
    got = [(x["start"], x["end"]) for x in intervals.pad_and_trim(r, gap=3.0).orderBy("ordinal").collect()]
    assert got == [(0.0, 1.5), (1.5, 2.5), (3.8, 9.0)]
    equal = spark.createDataFrame([(1, 0, 0.0, 1.0), (1, 1, 2.0, 3.0), (1, 2, 4.5, 5.0)], "media_id int, ordinal bigint, start double, end double")
    chunks = intervals.chunk_by_gap(equal, gap=1.0).orderBy("chunk_id").collect()
    assert [(c["chunk_id"], c["start"], c["end"], c["regions"]) for c in chunks] == [(0, 0.0, 3.0, 2), (1, 4.5, 5.0, 1)]


def test_sessions_against_loop(spark):
    rng = random.Random(5)
    events = [(rng.randint(1, 3), i, rng.randint(0, 80) / 2) for i in range(90)]
    df = spark.createDataFrame(events, "media_id int, ordinal bigint, t double")
    want = []
    for m in (1, 2, 3):
        ts = sorted(t for a, _, t in events if a == m)
        start = end = ts[0]
        for t in ts[1:] + [None]:
            if t is not None and t - end <= 1.0:
                end = t
                continue
            if end > start:
                want.append((m, start, end))
            start = end = t
    for cuts in (NO_CUTS, find_cuts(df, rows=8)):
        assert sorted((r["media_id"], r["start"], r["end"]) for r in intervals.sessions(df, 1.0, cuts=cuts).collect()) == want


def test_regroup_speech(spark):
    rows = [  # chunk, ordinal, start, end, text, speaker, confidence
        (0, 0, 0.0, 1.0, " one ", "A", 0.5), (0, 1, 1.0, 3.0, "two", "B", 0.8), (0, 2, 3.0, 4.0, "three", "A", 1.0),
        (1, 3, 5.0, 6.0, "  ", "C", 0.9), (2, 4, 7.0, 8.0, "four", "B", 0.7)]
    df = spark.createDataFrame([(1, *r) for r in rows], "media_id int, chunk_id bigint, ordinal bigint, start double, end double, text string, speaker string, confidence double")
    got = intervals.regroup_speech(df).orderBy("chunk_id").collect()
    assert [(r["chunk_id"], r["text"], r["speaker"], r["prev_speaker"], round(r["confidence"], 6)) for r in got] == [
        (0, "one two three", "A", None, round((0.5 + 1.6 + 1.0) / 4, 6)), (2, "four", "B", "A", 0.7)]
    parts = intervals.regroup_speech(df, part_rows=2).filter("chunk_id = 0").orderBy("part").collect()
    assert [p["text"] for p in parts] == ["one two", "three"]
    words = [("a", 0.2, 0.9, None), ("b", 3.9, 0.29, None), ("c", 4.5, 0.9, None), ("d", 1.0, None, 0.3), (" ", 1.0, 0.9, None)]
    first = df.filter("ordinal = 0").crossJoin(spark.createDataFrame([(words,)], "words array<struct<word:string,start:double,confidence:double,probability:double>>"))
    rest = df.filter("ordinal <> 0").withColumn("words", F.array().cast("array<struct<word:string,start:double,confidence:double,probability:double>>"))
    events = intervals.speech_events(first.unionByName(rest), intervals.regroup_speech(df)).orderBy("t").collect()
    assert [(e["description"], e["word"], e["speaker"], e["prev_speaker"]) for e in events] == [
        ("Word", "a", "A", None), ("Word", "d", "A", None), ("Speaker Change", None, "B", "A")]


def test_overlaps_split_along_cuts(spark):
    """A hot media's intervals are spread over segments; every pair comes out once, wherever the cuts lie."""
    rng = random.Random(8)
    left = [(m, i, s, s + rng.choice([0.0, 0.5, 3.0, 40.0])) for m in (1, 2) for i, s in enumerate(rng.choice([5.0, rng.uniform(0, 60)]) for _ in range(120 if m == 1 else 6))]
    right = [(m, i, s, s + rng.choice([0.0, 1.0, 9.0])) for m in (1, 2, 3) for i, s in enumerate(rng.choice([5.0, 6.0, rng.uniform(0, 60)]) for _ in range(90))]
    a = spark.createDataFrame(left, "media_id int, ordinal bigint, start double, end double")
    b = spark.createDataFrame(right, "media_id int, turn bigint, r_start double, r_end double")
    want = sorted((m, i, j) for m, i, s, e in left for n, j, x, y in right if m == n and s < e and x < y and s < y and x < e)
    cuts = find_cuts(a, by=("start", "ordinal"), rows=12)
    assert cuts.hot
    for longest in (None, 40.0):
        for given in (NO_CUTS, cuts):
            got = overlaps(a, b, 2.0, longest=longest, cuts=given)
            assert sorted((r["media_id"], r["ordinal"], r["turn"]) for r in got.collect()) == want
    assert "_s" not in overlaps(a, b, 2.0, cuts=cuts).columns
    assert len(overlaps(a, b, 2.0, longest=40.0, cuts=cuts).columns) == 7
