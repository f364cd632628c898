"""Ordered scans against plain Python, with one media that holds most rows and an instant with many."""

import random

import pytest
from pyspark.sql import functions as F

from mediatimeline.operators.ordered import NO_CUTS, Cuts, Track, attach, find_cuts, islands, pack


def make_rows(seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        media = 1 if rng.random() < 0.6 else rng.randint(2, 6)
        t = 5.0 if rng.random() < 0.3 else round(rng.random() * 10, 2)
        rows.append((media, i, t, rng.choice("abc") if rng.random() < 0.7 else None, rng.randint(0, 9)))
    return rows


@pytest.fixture(scope="module", params=["plain", "cut"])
def case(request, spark):
    rows = make_rows()
    df = spark.createDataFrame(rows, "media_id int, ordinal bigint, t double, label string, v int")
    cuts = NO_CUTS if request.param == "plain" else find_cuts(df, rows=12)
    assert cuts.hot == (request.param == "cut")
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        groups.setdefault(r[0], []).append(r)
    return df, cuts, groups


def got(df, *names):
    return {r["ordinal"]: tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()}


def test_hot_instant_is_cut(spark):
    df = spark.createDataFrame(make_rows(), "media_id int, ordinal bigint, t double, label string, v int")
    cuts = find_cuts(df, rows=12)
    sizes = Track(df, cuts=cuts)._df.groupBy("media_id", "_seg").count().collect()
    assert max(r["count"] for r in sizes) < 80
    at_five = Track(df, cuts=cuts)._df.filter("media_id = 1 and t = 5.0").select("_seg").distinct().count()
    assert at_five > 2


def test_neighbours(case):
    df, cuts, groups = case
    track = Track(df, cuts=cuts).previous(p=F.col("label"), pv=F.col("v")).following(n=F.col("v"))
    out = got(track.df, "p", "pv", "n")
    assert len(out) == 400
    for rows in groups.values():
        for i, r in enumerate(rows):
            before = rows[i - 1] if i else (None,) * 5
            after = rows[i + 1] if i + 1 < len(rows) else (None,) * 5
            assert out[r[1]] == (before[3], before[4], after[4])


def test_running_and_numbers(case):
    df, cuts, groups = case
    track = Track(df, cuts=cuts).running(s=F.col("v")).running(backward=True, b=F.col("v")).number("n").overall(total=F.sum("v"))
    out = got(track.df, "s", "b", "n", "total")
    for rows in groups.values():
        values = [r[4] for r in rows]
        for i, r in enumerate(rows):
            assert out[r[1]] == (sum(values[: i + 1]), sum(values[i:]), i + 1, sum(values))


@pytest.mark.parametrize("backward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_last_known(case, backward, strict):
    df, cuts, groups = case
    out = got(Track(df, cuts=cuts).last_known(backward=backward, strict=strict, k=F.col("label")).df, "k")
    for rows in groups.values():
        rows = rows[::-1] if backward else rows
        last = None
        for r in rows:
            seen = last
            last = r[3] if r[3] is not None else last
            assert out[r[1]] == (seen if strict else last)


def test_islands_and_attach(case):
    df, cuts, groups = case
    out = got(islands(Track(df, cuts=cuts), F.col("v") > 6).df, "island")
    for rows in groups.values():
        n = 0
        for r in rows:
            n += r[4] > 6
            assert out[r[1]] == n
    table = df.groupBy("media_id").agg(F.max("v").alias("top"))
    attached = got(attach(df, table, cuts=cuts), "top")
    assert len(attached) == 400
    for rows in groups.values():
        assert {attached[r[1]] for r in rows} == {max(r[4] for r in rows)}


def test_pack_keeps_everything_in_order(case):
    df, cuts, groups = case
    parts = pack(df, ("media_id",), ("t", "ordinal"), F.col("ordinal"), "items", cuts, part_rows=7).collect()
    assert max(len(p["items"]) for p in parts) <= 7
    for media, rows in groups.items():
        mine = sorted((p["part"], p["items"]) for p in parts if p["media_id"] == media)
        assert [x for _, items in mine for x in items] == [r[1] for r in rows]


def test_empty_input(spark):
    df = spark.createDataFrame([], "media_id int, ordinal bigint, t double, v int")
    assert not find_cuts(df, rows=5).hot
    assert Track(df).previous(p=F.col("v")).df.count() == 0
