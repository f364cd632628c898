"""Ordered scans over groups of any size.

`lag`, running totals and "last known value" need rows in order, and a plain window puts a
whole group into one task. Here a group with more rows than one task should hold is cut into
segments along its order. Each segment is scanned on its own, and what a segment needs from
the ones before it (its last row, its total, its last known value) comes from a summary of
one row per segment. Cut points affect balance only, never results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediatimeline.session import ensure_checkpoint_dir, rows_per_task

SAMPLE_PER_CUT = 16
FANOUT = 64
MAX_CUTS = FANOUT * FANOUT


@dataclass(frozen=True)
class Cuts:
    """Cut points of the hot groups of one key: (key, cuts, coarse), one row per hot group.

    A group is hot when it has more than `rows` rows, so there are fewer than total/rows hot
    groups with total/rows cut points among them: small enough to broadcast at any scale.
    `table` is None when no group is hot.
    """

    key: str
    table: DataFrame | None = None

    @property
    def hot(self) -> bool:
        return self.table is not None


NO_CUTS = Cuts("media_id")


def find_cuts(df: DataFrame, key: str = "media_id", by: tuple[str, str] = ("t", "ordinal"),
              rows: int | None = None) -> Cuts:
    """Count rows per group and cut the hot ones at evenly spaced sample points.

    The sample is chosen by a hash of the order columns. The cuts are written to the checkpoint
    folder, so every branch of a later plan, and a task run again, sees the same few rows.
    """
    rows = rows or rows_per_task(df.sparkSession)
    hot = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows)
    if hot.isEmpty():
        return Cuts(key)
    stride = max(1, rows // SAMPLE_PER_CUT)
    point = F.struct(F.col(by[0]).cast("double").alias("a"), F.col(by[1]).cast("bigint").alias("b"))
    sample = (
        df.join(F.broadcast(hot), key)
        .filter(F.pmod(F.xxhash64(*by), F.lit(stride)) == 0)
        .select(key, "_n", point.alias("point"))
    )
    ranked = Window.partitionBy(key).orderBy("point")
    every = F.greatest(F.lit(min(SAMPLE_PER_CUT, rows)), F.ceil(F.count(F.lit(1)).over(Window.partitionBy(key)) / MAX_CUTS))
    table = (
        sample.withColumn("_every", every)
        .withColumn("_rank", F.row_number().over(ranked))
        .filter(F.col("_rank") % F.col("_every") == 0)
        .groupBy(key)
        .agg(F.array_sort(F.collect_set("point")).alias("_cuts"))
        .withColumn("_coarse", F.expr(f"filter(_cuts, (c, i) -> (i + 1) % {FANOUT} = 0)"))
    )
    ensure_checkpoint_dir(df.sparkSession)
    return Cuts(key, table.checkpoint())


def _segment_sql(point: str) -> str:
    """Number of cut points at or before `point`, found in two short searches."""
    coarse = f"size(filter(_coarse, c -> c <= {point}))"
    fine = f"size(filter(slice(_cuts, {coarse} * {FANOUT} + 1, {FANOUT}), c -> c <= {point}))"
    return f"coalesce({coarse} * {FANOUT} + {fine}, 0)"


def with_segment(df: DataFrame, cuts: Cuts, **points: tuple[str, str]) -> DataFrame:
    """Add one segment number per named (order column, ordinal) pair of SQL expressions."""
    joined = df.join(F.broadcast(cuts.table), cuts.key, "left")
    for name, (first, second) in points.items():
        point = f"named_struct('a', cast({first} as double), 'b', cast({second} as bigint))"
        joined = joined.withColumn(name, F.expr(f"if(_cuts is null, 0, {_segment_sql(point)})"))
    return joined


class Track:
    """Rows of `df`, grouped by `keys` and ordered by `by`, open to ordered scans.

    Every method returns a new Track whose `df` has the extra columns.
    """

    def __init__(self, df: DataFrame, keys: tuple[str, ...] = ("media_id",), by: tuple[str, ...] = ("t", "ordinal"),
                 cuts: Cuts = NO_CUTS, _segmented: bool = False):
        self.keys, self.by, self.cuts = tuple(keys), tuple(by), cuts
        if cuts.hot and not _segmented:
            df = with_segment(df, cuts, _seg=(by[0], by[1])).drop("_cuts", "_coarse")
        self._df = df

    @property
    def df(self) -> DataFrame:
        return self._df.drop("_seg")

    def _next(self, df: DataFrame) -> "Track":
        return Track(df, self.keys, self.by, self.cuts, _segmented=True)

    def with_columns(self, **columns: Column) -> "Track":
        return self._next(self._df.withColumns(columns))

    def filter(self, condition: Column) -> "Track":
        return self._next(self._df.filter(condition))

    def window(self, backward: bool = False):
        order = [F.col(c).desc() if backward else F.col(c).asc() for c in self.by]
        part = self.keys + (("_seg",) if self.cuts.hot else ())
        return Window.partitionBy(*part).orderBy(*order)

    def _across(self, backward: bool):
        """Window over the one-row-per-segment summary of each group."""
        order = F.col("_seg").desc() if backward else F.col("_seg").asc()
        return Window.partitionBy(*self.keys).orderBy(order)

    def _edges(self, **aggs: Column) -> DataFrame:
        return self._df.groupBy(*self.keys, "_seg").agg(*[c.alias(n) for n, c in aggs.items()])

    def _attach(self, carry: DataFrame, names: list[str]) -> DataFrame:
        return self._df.join(carry.select(*self.keys, "_seg", *names), [*self.keys, "_seg"], "left")

    def neighbour(self, backward: bool = False, **columns: Column) -> "Track":
        """Value of each expression on the previous row (the next row if `backward`)."""
        w = self.window(backward)
        if not self.cuts.hot:
            return self._next(self._df.withColumns({n: F.lag(c).over(w) for n, c in columns.items()}))
        last = F.struct(*[c.alias(n) for n, c in columns.items()])
        pick = F.min_by if backward else F.max_by
        edges = self._edges(_edge=pick(last, F.struct(*self.by)))
        carry = edges.withColumn("_carry", F.lag("_edge").over(self._across(backward)))
        df = self._attach(carry, ["_carry"]).withColumn("_rn", F.row_number().over(w))
        df = df.withColumns({
            n: F.when(F.col("_rn") == 1, F.col("_carry")[n]).otherwise(F.lag(c).over(w)) for n, c in columns.items()
        })
        return self._next(df.drop("_carry", "_rn"))

    def previous(self, **columns: Column) -> "Track":
        return self.neighbour(False, **columns)

    def following(self, **columns: Column) -> "Track":
        return self.neighbour(True, **columns)

    def running(self, backward: bool = False, **columns: Column) -> "Track":
        """Running sum of each expression up to and including the row (null counts as nothing)."""
        w = self.window(backward).rowsBetween(Window.unboundedPreceding, 0)
        if not self.cuts.hot:
            return self._next(self._df.withColumns({n: F.sum(c).over(w) for n, c in columns.items()}))
        edges = self._edges(**{f"_e_{n}": F.sum(c) for n, c in columns.items()})
        before = self._across(backward).rowsBetween(Window.unboundedPreceding, -1)
        carry = edges.select(*self.keys, "_seg", *[F.sum(f"_e_{n}").over(before).alias(f"_c_{n}") for n in columns])
        df = self._attach(carry, [f"_c_{n}" for n in columns])
        df = df.withColumns({
            n: F.coalesce(F.sum(c).over(w) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)), F.col(f"_c_{n}"))
            for n, c in columns.items()
        })
        return self._next(df.drop(*[f"_c_{n}" for n in columns]))

    def last_known(self, backward: bool = False, strict: bool = False, **columns: Column) -> "Track":
        """Latest non-null value of each expression at or before the row (after, if `backward`).

        `strict` leaves the row itself out.
        """
        w = self.window(backward).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
        local = {n: F.last(c, ignorenulls=True).over(w) for n, c in columns.items()}
        if not self.cuts.hot:
            return self._next(self._df.withColumns(local))
        pick = F.min_by if backward else F.max_by
        edges = self._edges(**{
            f"_e_{n}": pick(c, F.when(c.isNotNull(), F.struct(*self.by))) for n, c in columns.items()
        })
        before = self._across(backward).rowsBetween(Window.unboundedPreceding, -1)
        carry = edges.select(
            *self.keys, "_seg", *[F.last(f"_e_{n}", ignorenulls=True).over(before).alias(f"_c_{n}") for n in columns]
        )
        df = self._attach(carry, [f"_c_{n}" for n in columns])
        df = df.withColumns({n: F.coalesce(v, F.col(f"_c_{n}")) for n, v in local.items()})
        return self._next(df.drop(*[f"_c_{n}" for n in columns]))

    def number(self, name: str) -> "Track":
        """1-based position of the row in its group."""
        if not self.cuts.hot:
            return self._next(self._df.withColumn(name, F.row_number().over(self.window()).cast("bigint")))
        return self.running(**{name: F.lit(1).cast("bigint")})

    def overall(self, **aggs: Column) -> "Track":
        """Aggregates of the whole group on each of its rows."""
        if not self.cuts.hot:
            w = Window.partitionBy(*self.keys)
            return self._next(self._df.withColumns({n: c.over(w) for n, c in aggs.items()}))
        totals = self._df.groupBy(*self.keys).agg(*[c.alias(n) for n, c in aggs.items()])
        # One copy of the totals per segment, so the join spreads a hot group like the scan does.
        per_segment = self._df.select(*self.keys, "_seg").distinct().join(totals, list(self.keys))
        return self._next(self._df.join(per_segment, [*self.keys, "_seg"]))


def attach(df: DataFrame, table: DataFrame, key: str = "media_id", by: tuple[str, str] = ("t", "ordinal"),
           cuts: Cuts = NO_CUTS, how: str = "left") -> DataFrame:
    """Join the one row per group of `table` to the group's rows.

    The row of a hot group is repeated for each of its segments and joined on (key, segment), so the
    rows of the group stay spread over many tasks.
    """
    if not cuts.hot:
        return df.join(table, key, how)
    left = with_segment(df, cuts, _seg=by).drop("_cuts", "_coarse")
    spread = table.join(F.broadcast(cuts.table), key, "left").withColumn(
        "_seg", F.explode(F.expr("sequence(0, if(_cuts is null, 0, size(_cuts)))"))).drop("_cuts", "_coarse")
    return left.join(spread, [key, "_seg"], how).drop("_seg")


def islands(track: Track, starts: Column, name: str = "island") -> Track:
    """Number the runs of a group: a row where `starts` holds opens the next run."""
    return track.running(**{name: F.when(starts, 1).otherwise(0).cast("bigint")})


def pack(df: DataFrame, keys: tuple[str, ...], by: tuple[str, ...], value: Column, name: str,
         cuts: Cuts = NO_CUTS, part_rows: int = 10_000, has_maps: bool = False) -> DataFrame:
    """Ordered array of `value` per group, in parts of at most `part_rows` rows.

    A group of usual size gives one row (`part` 0); a larger one gives as many parts as it
    needs, so no task ever gathers an unbounded group and nothing is dropped. `has_maps`: the
    value holds maps, which have no order, so positions are compared explicitly.
    """
    numbered = Track(df, keys, by, cuts).number("_pos").df
    item = F.struct(F.col("_pos"), value.alias("v"))
    items = F.collect_list(item)
    ordered = F.array_sort(items, lambda a, b: F.signum(a["_pos"] - b["_pos"]).cast("int")) if has_maps else F.sort_array(items)
    return (
        numbered.withColumn("part", F.floor((F.col("_pos") - 1) / part_rows))
        .groupBy(*keys, "part")
        .agg(ordered.alias("_items"))
        .select(*keys, "part", F.transform("_items", lambda i: i["v"]).alias(name))
    )
