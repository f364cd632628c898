"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mediatimeline.llm.common import hash_unit, whole_rows
from mediatimeline.session import settle

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
ROUNDS = 60
TOLERANCE = 1e-7
BUCKET_ROWS = 2_000
OFFSETS = 64  # places from which the rounding may start


def source_key(source: Column) -> Column:
    """A key that is never null and sorts by code point with null last."""
    return F.when(source.isNull(), F.lit("t")).otherwise(F.concat(F.lit("s"), source))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """Source key, size in words, and the row's own number in [0, 1)."""
    text = docs[text_col].cast("string")
    return [source_key(docs[source_col].cast("string")).alias("mix_source"), words(text).alias("mix_size"),
            hash_unit(docs[id_col], text).alias("mix_draw")]


def targets(cells: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """mix_source, source_size, source_rows and target of every source.

    The sources, in order of their keys, take turns at the weights and share `share` times all words. A target stops at
    `cap` times its source; what is over is shared again by weight until no target is above. That is a water level:
    sources sorted by cap per weight are full up to the first one that the level left by the full ones doesn't reach.
    """
    sums = cells.groupBy("mix_source").agg(F.sum(F.col("n") * F.col("mix_size")).alias("source_size"), F.sum("n").alias("source_rows"))
    turn = (F.row_number().over(Window.orderBy("mix_source")) - 1) % len(weights)
    weighted = sums.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    most = weighted.withColumn("most", F.col("source_size") * cap)
    order = Window.orderBy(F.col("most") / F.col("weight"), "mix_source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = most.withColumn("budget", F.sum("source_size").over(everything) * share).withColumn(
        "level", (F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    open_level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("level"))))
    chosen = level.withColumn("water", open_level.over(everything)["level"])
    return chosen.select("mix_source", "source_size", "source_rows",
                         F.coalesce(F.least("most", F.col("water") * F.col("weight")), F.col("most")).alias("target"))


def tilt(cells: DataFrame, sources: DataFrame, cap: float = CAP, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """sources with `lam`, the solution of the dual: sum of min(cap, exp(lam * size / mean)) * size = target per source.

    Newton steps run for all sources at once; a step is one join of the cells with the state and one sum per source. Steps
    that leave the bracket known so far become bisections, which the kinks at the cap ask for. Sources whose target is all
    they have, or nothing, are settled from the start.
    """
    scale = F.greatest(F.col("source_size") / F.col("source_rows"), F.lit(1.0))
    full = F.col("target") >= F.col("source_size") * cap * (1 - 1e-9)
    state = sources.select(
        "mix_source", "source_size", "source_rows", "target", scale.alias("scale"), full.alias("full"),
        F.when(full, F.lit(0.0)).otherwise(F.log(F.greatest(F.col("target") / F.greatest("source_size", F.lit(1)), F.lit(1e-300)))).alias("lam"),
        (scale * -700.0).alias("low"), (scale * math.log(cap)).alias("high"), F.when(full, 0.0).otherwise(1.0).alias("miss"))
    state = settle(state)
    for _ in range(rounds):
        joined = cells.join(state.where(~F.col("full")), "mix_source")
        x = F.col("mix_size") / F.col("scale")
        capped = F.col("lam") * x >= math.log(cap)
        weight = F.when(capped, cap).otherwise(F.exp(F.col("lam") * x))
        mass = F.col("n") * F.col("mix_size") * weight
        sums = joined.groupBy("mix_source").agg(F.sum(mass).alias("mass"), F.sum(F.when(capped, 0.0).otherwise(mass * x)).alias("slope"))
        over = F.coalesce(F.col("mass"), F.lit(0.0)) - F.col("target")
        miss = F.abs(over) / F.greatest("target", F.lit(1.0))
        low = F.when(over < 0, F.greatest("low", "lam")).otherwise(F.col("low"))
        high = F.when(over > 0, F.least("high", "lam")).otherwise(F.col("high"))
        newton = F.col("lam") - over / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high)
        moved = F.when(F.col("full") | (miss <= tolerance), F.col("lam")).otherwise(F.when(inside, newton).otherwise((low + high) / 2))
        kept = ["mix_source", "source_size", "source_rows", "target", "scale", "full"]
        state = settle(state.join(sums, "mix_source", "left").select(
            *kept, moved.alias("lam"), low.alias("low"), high.alias("high"), F.when(F.col("full"), 0.0).otherwise(miss).alias("miss")))
        worst = state.agg(F.max("miss")).first()[0]
        if worst is None or worst <= tolerance:
            break
    return state


def plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """What the mix does with every (source, size): mix_source, mix_size, source_size, target, rate, whole, limit.

    A row of such a cell gets `whole` copies and one more if its own number mix_draw is at most `limit` (null: none). Rates
    become copies by systematic rounding: along the sizes of a source the sum of fractions is cut at whole numbers, so the
    words taken miss the target by at most one longest document, and by less after the best of OFFSETS starts is picked. Inside a cell the rows with the smallest numbers get the
    extra copy; `limit` is found in buckets of about `bucket_rows`, so that no cell, however hot, is sorted in one task.
    """
    cells = settle(rows.groupBy("mix_source", "mix_size").agg(F.count("*").alias("n")))
    solved = tilt(cells, settle(targets(cells, weights, share, cap)), cap)
    x = F.col("lam") * F.col("mix_size") / F.col("scale")
    rate = F.when(F.col("full") | (x >= math.log(cap)), F.lit(float(cap))).otherwise(F.exp(x))
    whole = F.floor("rate")
    along = Window.partitionBy("mix_source").orderBy("mix_size").rowsBetween(Window.unboundedPreceding, 0)
    part = F.col("n") * (F.col("rate") - whole)
    rated = cells.join(solved, "mix_source").withColumn("rate", rate).withColumn("end", F.sum(part).over(along))
    # The start of the rounding is free: per source, take the one whose words come nearest to the target.
    def rounded(offset: Column) -> Column:
        return F.least(F.floor(F.col("end") + offset) - F.floor(F.col("end") - part + offset), F.col("n"))

    size, starts = F.col("mix_size"), [F.lit((i + 0.5) / OFFSETS) for i in range(OFFSETS)]
    misses = rated.groupBy("mix_source").agg(
        (F.first("target") - F.sum(F.col("n") * whole * size)).alias("open"), *[F.sum(rounded(v) * size).alias(f"at{i}") for i, v in enumerate(starts)])
    nearest = F.array_min(F.array(*[F.struct(F.abs(F.col("open") - F.col(f"at{i}")).alias("miss"), v.alias("offset")) for i, v in enumerate(starts)]))
    rated = rated.join(misses.select("mix_source", nearest["offset"].alias("offset")), "mix_source")
    extra = rounded(F.col("offset"))
    rated = settle(rated.select("mix_source", "mix_size", "source_size", "target", "n", "rate", whole.alias("whole"),
                                extra.alias("extra"), F.ceil(F.col("n") / bucket_rows).alias("buckets")))
    cell = ["mix_source", "mix_size"]
    some = rated.where("extra > 0 and extra < n").select(*cell, "extra", "buckets")
    drawn = rows.join(some, cell).withColumn("bucket", F.floor(F.col("mix_draw") * F.col("buckets")))
    counts = drawn.groupBy(*cell, "bucket").agg(F.count("*").alias("m"), F.first("extra").alias("extra"))
    before = F.sum("m").over(Window.partitionBy(*cell).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")
    edge = counts.withColumn("before", before).where("before < extra and extra <= before + m")
    edge = edge.select(*cell, "bucket", (F.col("extra") - F.col("before")).alias("take"))
    place = F.row_number().over(Window.partitionBy(*cell, "bucket").orderBy("mix_draw"))
    limits = drawn.select(*cell, "bucket", "mix_draw").join(edge, [*cell, "bucket"]).withColumn("place", place)
    limits = limits.where("place = take").select(*cell, F.col("mix_draw").alias("limit"))
    every = F.when(F.col("extra") >= F.col("n"), F.lit(1.0)).otherwise(F.col("limit"))
    return settle(rated.join(limits, cell, "left").select(*cell, "source_size", "target", "rate", "whole", every.alias("limit")))


def copies() -> Column:
    return (F.col("whole") + F.when(F.col("mix_draw") <= F.col("limit"), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """`id_col`, size, source_size, target, rate, copies and taken (words, repeats counted) of every row.

    Document rates are exp(lam * size / mean size of the source), at most `cap`: among all rates that give each source its
    target of words they stay closest, in entropy, to taking every document once. Documents of one source and size have one
    rate, so the Newton steps run over counts per (source, size). A hot source or a hot group of copies is a count there;
    draws inside a cell are cut into buckets.

    Sizes are words; a null text has none and is never worth a copy, so any rate holds for it. A null source is a source of
    its own, the last in order. Repeated rows count as many rows; rows alike in id and text share one draw, so they get
    equal copies. An empty table gives an empty result. Other columns are not read. Reruns give the same rows.
    """
    rows = settle(docs.select(docs[id_col].alias("id"), *keyed(docs, id_col, text_col, source_col)))
    cells = plan(rows.drop("id"), weights, share, cap)
    n = copies()
    return rows.join(cells, ["mix_source", "mix_size"]).select(
        F.col("id").alias(id_col), F.col("mix_size").alias("size"), "source_size", "target", "rate", n.alias("copies"),
        (n * F.col("mix_size")).alias("taken"))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """The rows of `docs`, with all their columns, as often as the mix takes them."""
    mine = keyed(docs, id_col, text_col, source_col)
    cells = plan(settle(docs.select(*mine)), weights, share, cap)
    taken = docs.select(whole_rows(docs), *mine).join(cells.drop("source_size", "target", "rate"), ["mix_source", "mix_size"])
    repeated = taken.where(copies() > 0).withColumn("mix_copy", F.explode(F.array_repeat(F.lit(1), copies().cast("int"))))
    return repeated.select("row.*")
