"""Merging timelines of several detectors and assembling the documents of a media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediatimeline.functions.render import event_line
from mediatimeline.functions.rows import exclude_sources, is_salient
from mediatimeline.operators.joins import events_in_spans
from mediatimeline.operators.ordered import NO_CUTS, Cuts, Track, pack

EVENT_COLUMNS = ("media_id", "ordinal", "t", "description", "source", "confidence", "details")
SPAN_COLUMNS = ("media_id", "ordinal", "start", "end", "description", "source", "confidence", "details")


def combine_timelines(events: list[DataFrame], spans: list[DataFrame] = ()) -> tuple[DataFrame, DataFrame]:
    """One timeline from several: every span, and the standalone events worth keeping.

    A bag union: no duplicate is removed. `timeline` is the rank of the input a row comes from,
    and (time, timeline, ordinal) is the order of the merged timeline.
    """
    if not events and not spans:
        raise ValueError("no timelines to merge")

    def stack(frames, columns):
        out = None
        for rank, df in enumerate(frames):
            part = df.select(*columns, F.lit(rank).alias("timeline"))
            out = part if out is None else out.unionByName(part)
        return out
    kept = [e.filter(is_salient()) for e in events]
    return stack(kept, EVENT_COLUMNS), stack(spans, SPAN_COLUMNS)


def all_events(span_events: DataFrame, standalone: DataFrame, video: DataFrame | None = None) -> DataFrame:
    """Events inside spans, standalone events and video events, with the rank of each group."""
    parts = [p for p in (span_events, standalone, video) if p is not None]
    out = parts[0].withColumn("origin", F.lit(0))
    for rank, part in enumerate(parts[1:], start=1):
        out = out.unionByName(part.withColumn("origin", F.lit(rank)))
    return out


def source_union(timelines: DataFrame, column: str = "source", key: str = "media_id") -> DataFrame:
    return timelines.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(column)), ",").alias("sources"))


def transcript_priority(timelines: DataFrame, source: str = "whisper", key: str = "media_id") -> DataFrame:
    """Transcript and language of the first timeline of `source` that has a transcript."""
    usable = timelines.filter((F.col("source") == source) & (F.col("transcript") != ""))
    return usable.groupBy(key).agg(F.min_by(F.struct("transcript", "language"), "ordinal").alias("_t")).select(key, "_t.*")


def chronological(df: DataFrame, *by: str, key: str = "media_id") -> DataFrame:
    """Global order by media, time and the tie columns: a range exchange, so any media size is fine."""
    return df.orderBy(key, *by)


def knowledge_lines(events: DataFrame, captions: bool = True, with_speaker: bool = True, cuts: Cuts = NO_CUTS) -> DataFrame:
    """Numbered lines of the event part of each document; events that are not shown are left out.

    Sorting is by (t, ordinal); put the origin of stacked inputs into `ordinal` beforehand.
    """
    lines = events.withColumn("line", event_line(with_speaker=with_speaker, captions=captions)).filter(
        F.col("line").isNotNull())
    return Track(lines.select("media_id", "t", "ordinal", "line"), ("media_id",), ("t", "ordinal"), cuts).number(
        "line_no").df


def knowledge_document(events: DataFrame, media: DataFrame, part_rows: int = 10_000, cuts: Cuts = NO_CUTS) -> DataFrame:
    """The Markdown document of each media: title, transcript if any, event lines in time order.

    Media: (media_id, name, transcript). A document with more than `part_rows` event lines comes
    in several parts, in order; only the first has the head.
    """
    lines = events.withColumn("line", event_line()).filter(F.col("line").isNotNull())
    body = pack(lines, ("media_id",), ("t", "ordinal"), F.col("line"), "lines", cuts, part_rows)
    # Events without a media row keep their document, under their own id.
    heads = media.select("media_id", "name", "transcript").join(
        body.groupBy("media_id").agg(F.max("part").alias("_parts")), "media_id", "full").withColumn(
        "name", F.coalesce("name", F.col("media_id").cast("string")))
    said = F.when(F.coalesce("transcript", F.lit("")) != "",
                  F.concat(F.lit("## Full Transcript\n"), F.col("transcript"), F.lit("\n\n"))).otherwise("")
    head = F.concat(F.lit("# Summary for video: "), F.col("name"), F.lit(".mp4\n\n"), said,
                    F.lit("## Detailed Event Timeline\n"))
    # One row per media and part, also for media without events.
    parts = heads.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(0)))))
    joined = parts.join(body, ["media_id", "part"], "left")
    text = F.array_join(F.col("lines"), "\n")
    whole = F.when(F.col("part") > 0, text).when(F.col("lines").isNull(), head).otherwise(F.concat(head, F.lit("\n"), text))
    return joined.select("media_id", "part", whole.alias("document"))


def context_document(events: DataFrame, media: DataFrame, part_rows: int = 10_000, cuts: Cuts = NO_CUTS) -> DataFrame:
    """Plain-text context for captioning: no music or voice analysis, words without speaker."""
    lines = exclude_sources(events).withColumn("line", event_line(with_speaker=False, captions=False)).filter(
        F.col("line").isNotNull())
    body = pack(lines, ("media_id",), ("t", "ordinal"), F.col("line"), "lines", cuts, part_rows)
    head = F.concat(F.lit("Full Transcript: "), F.coalesce("transcript", F.lit("")), F.lit("\n"))
    joined = media.select("media_id", "transcript").join(body, "media_id", "full").withColumn("part", F.coalesce("part", F.lit(0)))
    text = F.array_join("lines", "\n")
    whole = F.when(F.col("part") > 0, text).when(F.col("lines").isNull(), head).otherwise(F.concat(head, F.lit("\n"), text))
    return joined.select("media_id", "part", whole.alias("context"))


def _seconds(t: Column) -> Column:
    """Shortest text of a time with up to two decimals and at least one."""
    return F.regexp_replace(F.format_string("%.2f", t), r"(\.\d)0$", "$1")


def time_range_segments(spans: DataFrame, events: DataFrame, width: float, cuts: Cuts = NO_CUTS,
                        longest: float | None = None) -> DataFrame:
    """Contributions of each elementary interval ("a-bs") between span edges, and of each instant ("ts").

    One row per contribution, so an interval under very many spans is no problem.
    Spans and events: (media_id, ordinal, start, end | t, source, description, category).
    """
    edges = spans.select("media_id", F.explode(F.array("start", "end")).alias("t")).distinct()
    edges = edges.withColumn("ordinal", F.lit(0).cast("bigint"))
    pieces = Track(edges, ("media_id",), ("t", "ordinal"), cuts).following(_next=F.col("t")).df.filter(
        F.col("_next").isNotNull()).withColumnRenamed("t", "a").withColumnRenamed("_next", "b")
    middles = pieces.select("media_id", ((F.col("a") + F.col("b")) / 2).alias("t"), "ordinal", "a", "b")
    covered = events_in_spans(
        middles, spans.select("media_id", F.col("ordinal").alias("span_ordinal"), "start", "end", "source", "description", "category"),
        width, cuts=cuts, longest=longest)
    ranges = covered.select(
        "media_id", F.col("a").alias("at"), F.concat(_seconds(F.col("a")), F.lit("-"), _seconds(F.col("b")), F.lit("s")).alias("time_range"),
        "source", "description", "category", F.col("span_ordinal").alias("ordinal"))
    instants = events.select(
        "media_id", F.col("t").alias("at"), F.concat(_seconds(F.col("t")), F.lit("s")).alias("time_range"),
        "source", "description", "category", "ordinal")
    return ranges.unionByName(instants)


def audit_export(events: DataFrame, spans: DataFrame, span_events: DataFrame, key: str = "media_id") -> DataFrame:
    """Flat rows of every event (with its snake-case type) and span (with its number of events)."""
    none = F.lit(None)
    counts = span_events.groupBy(key, "span_ordinal").agg(F.count(F.lit(1)).alias("events_count"))
    flat = events.select(
        key, "ordinal", F.lit("event").alias("row_type"), F.col("t").alias("start"), none.cast("double").alias("end"),
        "description", F.lower(F.replace("description", F.lit(" "), F.lit("_"))).alias("event_type"), "source", "confidence",
        none.cast("bigint").alias("events_count"))
    sides = spans.join(counts.withColumnRenamed("span_ordinal", "ordinal"), [key, "ordinal"], "left")
    return flat.unionByName(sides.select(
        key, "ordinal", F.lit("span").alias("row_type"), "start", "end", "description", none.cast("string").alias("event_type"),
        "source", "confidence", F.coalesce("events_count", F.lit(0)).cast("bigint").alias("events_count")))
