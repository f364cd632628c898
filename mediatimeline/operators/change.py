"""Change detection and run-length spans over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediatimeline.functions.render import cosine
from mediatimeline.operators.joins import nearest
from mediatimeline.operators.ordered import NO_CUTS, Cuts, Track, attach, islands

KEYS = ("media_id",)
BY = ("t", "ordinal")


def numeric_change(df: DataFrame, value: str = "value", threshold: float = 10.0, keys=KEYS, by=BY,
                   cuts: Cuts = NO_CUTS) -> DataFrame:
    """Rows whose value moved by more than `threshold` since the previous row."""
    out = Track(df, keys, by, cuts).previous(prev_value=F.col(value)).df
    delta = F.abs(F.col(value) - F.col("prev_value"))
    return out.withColumn("delta", delta).filter(F.col("delta") > threshold).withColumn(
        "change_confidence", F.least(F.lit(0.95), 0.6 + F.col("delta") / 20.0))


def label_change(df: DataFrame, label: str = "label", index: str | None = None, keys=KEYS, by=BY,
                 cuts: Cuts = NO_CUTS) -> DataFrame:
    """Rows whose label differs from the previous row's; the first row never counts."""
    wanted = {"prev_label": F.col(label)}
    if index:
        wanted["_prev_index"] = F.col(index)
    out = Track(df, keys, by, cuts).previous(**wanted).df.filter(F.col(label) != F.col("prev_label"))
    if index:
        out = out.withColumn("index_change", F.col(index) - F.col("_prev_index")).drop("_prev_index")
    return out.withColumn("change_confidence", F.lit(0.65))


def adaptive_change(df: DataFrame, value: str = "value", k: float = 0.5, keys=KEYS, by=BY,
                    cuts: Cuts = NO_CUTS) -> DataFrame:
    """Steps larger than k population standard deviations of the whole group."""
    track = Track(df, keys, by, cuts).previous(prev_value=F.col(value)).overall(_std=F.stddev_pop(value))
    delta = F.abs(F.col(value) - F.col("prev_value"))
    out = track.df.withColumn("delta", delta).filter(F.col("delta") > F.col("_std") * k)
    direction = F.when(F.col(value) > F.col("prev_value"), "energy_increase").otherwise("energy_decrease")
    return out.withColumns({"kind": direction, "change_confidence": F.lit(0.7)}).drop("_std")


def gated_label_change(df: DataFrame, label: str = "label", confidence: str = "confidence", above: float = 0.6,
                       keys=KEYS, by=BY, cuts: Cuts = NO_CUTS) -> DataFrame:
    """Rows over the confidence gate whose label differs from the last one let through.

    Rows under the gate never change the remembered label, so dropping them first and looking one
    row back gives the same rows as carrying the label in state.
    """
    passed = df.filter(F.col(confidence) > above)
    out = Track(passed, keys, by, cuts).previous(prev_label=F.col(label)).df
    return out.filter(~F.col(label).eqNullSafe(F.col("prev_label")))


def label_change_after_filter(df: DataFrame, keep: Column, label: str = "label", keys=KEYS, by=BY,
                              cuts: Cuts = NO_CUTS) -> DataFrame:
    """Changes among the kept rows, with each row's 0-based index and the number of kept rows."""
    track = Track(df.filter(keep), keys, by, cuts).number("_n").previous(prev_label=F.col(label))
    out = track.overall(total_detections=F.count(F.lit(1))).df
    out = out.filter(~F.col(label).eqNullSafe(F.col("prev_label")))
    return out.withColumn("window_index", F.col("_n") - 1).drop("_n")


def multi_facet_change(df: DataFrame, facets: dict[str, tuple[str, str]], above: float = 0.4, keys=KEYS, by=BY,
                       cuts: Cuts = NO_CUTS) -> DataFrame:
    """Gated changes per facet; `facets` names the (label, confidence) columns of each."""
    pieces = F.array(*[
        F.struct(F.lit(name).alias("facet"), F.col(label).alias("label"), F.col(conf).alias("confidence"))
        for name, (label, conf) in facets.items()])
    rows = df.select(*keys, *by, F.explode(pieces).alias("f")).select(*keys, *by, "f.*")
    out = gated_label_change(rows, above=above, keys=(*keys, "facet"), by=by, cuts=cuts)
    return out.withColumn("transition", F.concat(F.coalesce("prev_label", F.lit("[start]")), F.lit(" → "), F.col("label")))


def run_spans(df: DataFrame, label: str = "label", confidence: str = "confidence", min_confidence: float = 0.6,
              duration: str = "duration", keys=KEYS, by=BY, cuts: Cuts = NO_CUTS,
              features: dict[str, str] | None = None, category: str | None = None) -> DataFrame:
    """Spans of equal labels, broken also by any row under the confidence floor.

    A span ends where the next one starts and the last one at the media's duration. Its confidence
    is the mean over all rows of that label in the media up to the span's last row; the last span
    takes its last row's confidence. `features` (output -> column) are averaged over the span and
    `category` becomes its most frequent value, the first seen on a tie.
    """
    first, second = by
    rows = Track(df, keys, by, cuts).previous(_prev=F.struct(F.col(label).alias("v")))
    start = F.col("_prev").isNull() | ~F.col(label).eqNullSafe(F.col("_prev.v")) | (F.col(confidence) < min_confidence)
    rows = islands(rows, start, "span_no")
    # A missing label is a label of its own; joins of segment summaries need a value for it.
    named = rows.df.withColumn("_label", F.coalesce(F.col(label).cast("string"), F.lit("\x00")))
    rows = Track(named, (*keys, "_label"), by, cuts).running(_sum=F.col(confidence), _count=F.lit(1).cast("bigint")).df
    features = features or {}
    place = [F.col(first).alias("t"), F.col(second).alias("o")]
    # Two levels of one aggregate, by category and then over the categories: no join for the commonest one.
    parts = rows.groupBy(*keys, "span_no", *([category] if category else [])).agg(
        F.min(F.struct(*place, F.col(label).alias("label"))).alias("_first"),
        F.max(F.struct(*place, (F.col("_sum") / F.col("_count")).alias("mean"), F.col(confidence).alias("own"))).alias("_last"),
        F.max(duration).alias("_duration"), F.count(F.lit(1)).alias("rows"),
        *[x for n, column in features.items() for x in (F.sum(column).alias(f"_s_{n}"), F.count(column).alias(f"_n_{n}"))])
    winner = [F.min_by(category, F.struct((-F.col("rows")).alias("n"), F.col("_first.t"), F.col("_first.o"))).alias(category)] if category else []
    spans = parts.groupBy(*keys, "span_no").agg(
        F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.max("_duration").alias("_duration"),
        F.sum("rows").alias("rows"), *winner,
        *[(F.sum(f"_s_{n}") / F.sum(f"_n_{n}")).alias(n) for n in features])
    spans = spans.withColumns({"label": F.col("_first.label"), "start": F.col("_first.t"), "ordinal": F.col("_first.o")}).drop("_first")
    spans = Track(spans, keys, ("start", "ordinal"), cuts).following(_next=F.col("start")).df
    return spans.withColumns({
        "end": F.coalesce("_next", "_duration"),
        "confidence": F.when(F.col("_next").isNull(), F.col("_last.own")).otherwise(F.col("_last.mean")),
    }).drop("_last", "_duration", "_next")


def vector_change(df: DataFrame, vector: str = "embedding", above: float = 0.5, keys=KEYS, by=BY,
                  cuts: Cuts = NO_CUTS) -> DataFrame:
    """Rows whose vector is farther than `above` (1 - cosine) from the previous row's."""
    out = Track(df, keys, by, cuts).previous(_prev=F.col(vector)).df
    out = out.withColumn("distance", 1.0 - cosine(F.col("_prev"), F.col(vector))).filter(F.col("distance") > above)
    return out.withColumn("change_confidence", F.least(F.lit(0.9), 0.5 + F.col("distance"))).drop("_prev")


def exact_percentile(df: DataFrame, value: str, p: float, name: str, key: str = "media_id", ordinal: str = "ordinal",
                     cuts: Cuts = NO_CUTS) -> DataFrame:
    """Linear-interpolated percentile of each group.

    The built-in aggregate keeps every distinct value of a group in one buffer, so hot groups
    (cut along `value`) are numbered by an ordered scan and the one or two middle rows picked out.
    """
    if not cuts.hot:
        return df.groupBy(key).agg(F.percentile(value, p).alias(name))
    ranked = Track(df.filter(F.col(value).isNotNull()), (key,), (value, ordinal), cuts).number("_n")
    ranked = ranked.overall(_size=F.count(F.lit(1))).df.withColumn("_at", (F.col("_size") - 1) * p + 1)
    low, high = F.floor("_at"), F.ceil("_at")
    picked = ranked.filter((F.col("_n") == low) | (F.col("_n") == high)).groupBy(key).agg(
        F.min(value).alias("_low"), F.max(value).alias("_high"), F.max(F.col("_at") - low).alias("_part"))
    return picked.select(key, (F.col("_low") + F.col("_part") * (F.col("_high") - F.col("_low"))).alias(name))


def strong_peaks(peaks: DataFrame, strength: DataFrame, many: int = 90, level: float = 0.5, first: int = 15,
                 key: str = "media_id", cuts: Cuts = NO_CUTS, strength_cuts: Cuts = NO_CUTS) -> DataFrame:
    """The first `first` peaks in time of each media, after a strength filter where there are many.

    With more than `many` peaks, one stays only if its nearest strength sample is over the
    (1 - level) percentile of the media's strengths; no more than `first` are then counted.
    `cuts` follow time, `strength_cuts` follow (strength, ordinal).
    """
    floor = exact_percentile(strength, "strength", 1.0 - level, "_floor", key, cuts=strength_cuts)
    near = nearest(peaks, strength, key, cuts, payload={"near_strength": F.col("strength")})
    counted = Track(near, (key,), BY, cuts).overall(_peaks=F.count(F.lit(1))).df
    rows = attach(counted, floor, key, cuts=cuts)
    kept = rows.filter((F.col("_peaks") <= many) | (F.col("near_strength") > F.col("_floor")))
    track = Track(kept, (key,), BY, cuts).number("_n").overall(_kept=F.count(F.lit(1)))
    total = F.when(F.col("_peaks") > many, F.least(F.col("_kept"), F.lit(first))).otherwise(F.col("_kept"))
    return track.df.filter(F.col("_n") <= first).select(
        *peaks.columns, (F.col("_n") - 1).alias("onset_index"), total.alias("total_onsets"))


def previous_time(df: DataFrame, keys=KEYS, by=BY, cuts: Cuts = NO_CUTS) -> DataFrame:
    """Greatest strictly earlier time in the group: rows at the same instant share it."""
    track = Track(df, keys, by, cuts).previous(_prev=F.col(by[0]))
    earlier = F.when(F.col("_prev") < F.col(by[0]), F.col("_prev"))
    return track.with_columns(_earlier=earlier).last_known(prev_t=F.col("_earlier")).df.drop("_prev", "_earlier")


def pause_speakers(segments: DataFrame, pause: float = 2.0, keys=KEYS, by=("start", "ordinal"),
                   cuts: Cuts = NO_CUTS) -> DataFrame:
    """Two alternating speakers: the speaker changes after each pause longer than `pause`."""
    track = Track(segments, keys, by, cuts).previous(_end=F.col("end"))
    track = islands(track, F.col("start") - F.col("_end") > pause, "_turns")
    speaker = F.when(F.col("_turns") % 2 == 0, "Speaker_1").otherwise("Speaker_2")
    return track.df.withColumn("speaker", speaker).drop("_end", "_turns")


def circuit_breaker(items: DataFrame, failed: Column, limit: int = 3, keys=("batch_id",), by=("seq", "item"),
                    cuts: Cuts = NO_CUTS) -> DataFrame:
    """Failure streak of each item, and whether it still runs before the breaker stops the batch.

    `stopped` items come after the first streak of `limit` failures and stay pending.
    """
    track = Track(items, keys, by, cuts).with_columns(_failed=F.coalesce(failed, F.lit(False)).cast("int"))
    track = islands(track, F.col("_failed") == 0, "_run")
    streaked = Track(track.df, (*keys, "_run"), by, cuts).running(streak=F.col("_failed").cast("bigint")).df
    tripped = F.when(F.col("streak") >= limit, 1).otherwise(0)
    trips = Track(streaked, keys, by, cuts).with_columns(_trip=tripped).running(_trips=F.col("_trip").cast("bigint"))
    out = trips.df.withColumns({
        "tripped": F.col("_trip") == 1,
        "stopped": F.col("_trips") - F.col("_trip") > 0,
    })
    return out.drop("_failed", "_run", "_trip", "_trips")
