"""Interval and nearest joins as equi-joins: no cross product inside a media."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediatimeline.operators.ordered import NO_CUTS, Cuts, Track, with_segment


STEP = 8  # widths of neighbouring levels differ by this factor
TOP = 20


def _level(start: str, end: str, width: float, top: int = TOP) -> Column:
    """Smallest level whose buckets are at least an eighth of the interval's length."""
    ratio = F.greatest((F.col(end) - F.col(start)) / F.lit(float(width) * STEP), F.lit(1.0))
    return F.least(F.lit(top), F.ceil(F.log(float(STEP), ratio))).cast("int")


def _levels(df: DataFrame, width: float, start: str, end: str, longest: float | None) -> list[int]:
    """Levels in use: one for a known `longest` interval of up to 8 widths, else those that occur.

    At most 21 numbers come to the driver. Longer intervals than promised only touch more buckets.
    """
    if longest is not None:
        return list(range(max(0, math.ceil(math.log(max(longest / (width * STEP), 1.0), STEP))) + 1))
    return sorted(r[0] for r in df.select(_level(start, end, width)).distinct().collect())


def _width_at(level: Column, width: float, levels: list[int]) -> Column:
    if levels == [0]:
        return F.lit(float(width))
    return F.lit(float(width)) * F.pow(F.lit(float(STEP)), level)


def _bucket(value: str, width: Column) -> Column:
    return F.floor(F.col(value) / width).cast("bigint")


def _in_buckets(df: DataFrame, start: str, end: str, width: Column) -> DataFrame:
    """One row per bucket an interval touches at its level `_l`: at most about ten, however long it is."""
    return df.withColumn("_b", F.explode(F.sequence(_bucket(start, width), _bucket(end, width))))


def _on_levels(df: DataFrame, levels: list[int]) -> DataFrame:
    if len(levels) == 1:
        return df.withColumn("_l", F.lit(levels[0]))
    return df.withColumn("_l", F.explode(F.array(*[F.lit(n) for n in levels])))


def events_in_spans(events: DataFrame, spans: DataFrame, width: float, key: str = "media_id",
                    how: str = "inner", cuts: Cuts = NO_CUTS, longest: float | None = None) -> DataFrame:
    """Pair each event with every span that holds its time, both ends inclusive.

    Time is cut into buckets of `width`, and of 8, 64 ... times `width` for longer spans. A span is
    listed under the few buckets it touches at the level of its length, an event under the one
    that holds it at each level in use (mostly one), so the join is an equi-join on (key, level,
    bucket) followed by the exact check. For hot groups (`cuts`) the event's segment joins the
    key: a bucket, or even one instant, with a large part of all events is spread over many tasks.

    `longest` is the length of the longest span if known; else the spans are looked through once.
    `events` has (key, t, ordinal, ...), `spans` has (key, start, end, ...); other column names
    must not clash. `how` is inner or left_semi (then (key, t, ordinal) must be unique).
    """
    spans_ok = spans.filter(F.col("start") <= F.col("end"))
    levels = _levels(spans_ok, width, "start", "end", longest) or [0]
    size = _width_at(F.col("_l"), width, levels)
    left = _on_levels(events, levels).withColumn("_b", _bucket("t", size))
    level = _level("start", "end", width, levels[-1]) if levels != [0] else F.lit(0)
    right = _in_buckets(spans_ok.withColumn("_l", level), "start", "end", size)
    on = [key, "_b"] if len(levels) == 1 else [key, "_l", "_b"]
    if cuts.hot:
        left = with_segment(left, cuts, _s=("t", "ordinal")).drop("_cuts", "_coarse")
        right = right.withColumn("_w", size)
        right = with_segment(right, cuts, _lo=("greatest(start, _b * _w)", str(-(2**63))),
                             _hi=("least(end, (_b + 1) * _w)", str(2**63 - 1)))
        # Widen by one segment each way: bucket edges are computed in floating point.
        reach = F.expr("sequence(greatest(_lo - 1, 0), least(_hi + 1, if(_cuts is null, 0, size(_cuts))))")
        right = right.withColumn("_s", F.explode(reach)).drop("_cuts", "_coarse", "_lo", "_hi", "_w")
        on = on + ["_s"]
    condition = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on]
    condition += [F.col("l.t") >= F.col("r.start"), F.col("l.t") <= F.col("r.end")]
    joined = left.alias("l").join(right.alias("r"), condition, how)
    event_columns = [F.col(f"l.{c}") for c in events.columns]
    if how == "left_semi":
        found = joined.select(*event_columns)
        # An event may be found at several levels.
        return found if len(levels) == 1 else found.dropDuplicates([key, "t", "ordinal"])
    span_columns = [F.col(f"r.{c}") for c in spans.columns if c != key]
    return joined.select(*event_columns, *span_columns)


def overlaps(left: DataFrame, right: DataFrame, width: float, key: str = "media_id",
             longest: float | None = None, cuts: Cuts = NO_CUTS) -> DataFrame:
    """Pairs of intervals of the same key that overlap by more than a point.

    Each interval is listed under the buckets it touches at the levels in use from its own
    upwards. A pair meets at the higher of its two levels, and is reported only in the bucket
    where its common part begins: it appears once and needs no duplicate removal. A bucket with
    very many intervals is split by adaptive execution, on either side.
    Left has (start, end), right has (r_start, r_end); `longest` is as in `events_in_spans`. For hot groups (`cuts`, along
    time) an interval is also listed under the segments that it reaches inside a bucket, and a pair is reported in the segment
    where its common part begins.
    """
    a = left.filter(F.col("start") < F.col("end"))
    b = right.filter(F.col("r_start") < F.col("r_end"))
    if longest is None:
        levels = sorted({*_levels(a, width, "start", "end", None), *_levels(b, width, "r_start", "r_end", None)}) or [0]
    else:
        levels = _levels(a, width, "start", "end", longest)
    size = _width_at(F.col("_l"), width, levels)

    def listed(df: DataFrame, start: str, end: str, own: str) -> DataFrame:
        if levels == [0]:
            df = df.withColumns({own: F.lit(0), "_l": F.lit(0)})
        else:
            df = _on_levels(df.withColumn(own, _level(start, end, width, levels[-1])), levels)
        df = _in_buckets(df.filter(F.col("_l") >= F.col(own)), start, end, size)
        if not cuts.hot:
            return df
        first, last = str(-(2**63)), str(2**63 - 1)
        df = with_segment(df.withColumn("_w", size), cuts, **{
            f"{own}s": (start, first), "_lo": (f"greatest({start}, _b * _w)", first), "_hi": (f"least({end}, (_b + 1) * _w)", last)})
        # Widen by one segment each way: bucket edges are computed in floating point.
        reach = F.expr("sequence(greatest(_lo - 1, 0), least(_hi + 1, if(_cuts is null, 0, size(_cuts))))")
        return df.withColumn("_s", F.explode(reach)).drop("_cuts", "_coarse", "_lo", "_hi", "_w")

    on = ([key, "_b"] if len(levels) == 1 else [key, "_l", "_b"]) + (["_s"] if cuts.hot else [])
    right_side = listed(b, "r_start", "r_end", "_lb")
    pairs = listed(a, "start", "end", "_la").join(right_side if "_l" in on else right_side.drop("_l"), on)
    if cuts.hot:
        pairs = pairs.filter(F.col("_s") == F.when(F.col("start") >= F.col("r_start"), F.col("_las")).otherwise(F.col("_lbs"))).drop("_s", "_las", "_lbs")
    return pairs.filter(
        (F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end"))
        & (F.col("_l") == F.greatest("_la", "_lb"))
        & (F.col("_b") == F.floor(F.greatest("start", "r_start") / size))).drop("_l", "_b", "_la", "_lb")


def nearest(points: DataFrame, others: DataFrame, key: str = "media_id", cuts: Cuts = NO_CUTS,
            payload: dict[str, Column] | None = None) -> DataFrame:
    """Nearest row of `others` for each row of `points`: adds `nearest_t`, `distance` and payload.

    Union of both sides, one ordered scan each way; no join. The earlier of two equally near
    rows wins. No row in `others`: nulls. Both sides have (key, t, ordinal).
    """
    payload = payload or {}
    other = F.struct(F.col("t").alias("t"), *[c.alias(n) for n, c in payload.items()])
    marked = others.select(key, "t", "ordinal", other.alias("_other"))
    if payload or cuts.hot:
        # Equal times are equally near: keep the first, so an instant with many rows is one row.
        marked = marked.groupBy(key, "t").agg(F.min_by("_other", "ordinal").alias("_other"))
    kept = points.columns
    # At one instant the other side sorts first, so a distance of zero is found looking back.
    first = F.lit(-(2**63)).cast("bigint")
    both = points.withColumns({"_order": F.col("ordinal").cast("bigint"), "_is_point": F.lit(1)}).unionByName(
        marked.select(key, "t", "_other", first.alias("_order"), F.lit(0).alias("_is_point")), allowMissingColumns=True)
    track = Track(both, (key,), ("t", "_order"), cuts)
    track = track.last_known(_back=F.col("_other")).last_known(backward=True, _ahead=F.col("_other"))
    back, ahead = F.col("t") - F.col("_back.t"), F.col("_ahead.t") - F.col("t")
    best = F.when(F.col("_ahead").isNull() | (back <= ahead), F.col("_back")).otherwise(F.col("_ahead"))
    found = track.df.filter(F.col("_is_point") == 1).withColumn("_best", best)
    return found.select(
        *kept, F.col("_best.t").alias("nearest_t"), F.abs(F.col("t") - F.col("_best.t")).alias("distance"),
        *[F.col(f"_best.{n}").alias(n) for n in payload])
