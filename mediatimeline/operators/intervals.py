"""Speech regions, chunks, sessions, scenes, and the joins between spans and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediatimeline.functions.rows import keep_words, valid_segments
from mediatimeline.functions.rules import is_artifact_text
from mediatimeline.operators.joins import events_in_spans, nearest, overlaps
from mediatimeline.operators.ordered import NO_CUTS, Cuts, Track, attach, islands, pack

KEYS = ("media_id",)
SPAN_BY = ("start", "ordinal")


def later_span_wins(assigned: DataFrame, by: str = "time", key: str = "media_id") -> DataFrame:
    """Keep one span per instant (or per event): the one that starts last.

    `assigned` has (key, t, ordinal, start, span_ordinal, ...). An aggregate with map-side
    combining picks the winner, so an instant with many rows does not gather in one task.
    """
    group = [key, "t"] if by == "time" else [key, "t", "ordinal"]
    order = [c for c in ("start", "span_ordinal", "ordinal") if c not in group]
    others = [c for c in assigned.columns if c not in group and c not in order]
    rank = F.struct(*order)
    # Where the order is all there is to a row, its greatest value is the row: half as much to move.
    best = assigned.groupBy(*group).agg((F.max_by(F.struct(*order, *others), rank) if others else F.max(rank)).alias("_best"))
    return best.select(*group, "_best.*").select(*assigned.columns)


def assign_by_overlap(segments: DataFrame, turns: DataFrame, width: float, key: str = "media_id",
                      alternate: bool = True, cuts: Cuts = NO_CUTS, longest: float | None = None) -> DataFrame:
    """Label each segment with the turn it overlaps most; the first turn wins a tie.

    Without any overlap the label is Speaker_1 / Speaker_2 by the segment's index (or Unknown).
    Segments: (key, ordinal, start, end, ...); turns: (key, ordinal, start, end, speaker).
    """
    right = turns.select(key, F.col("ordinal").alias("turn"), F.col("start").alias("r_start"),
                         F.col("end").alias("r_end"), F.col("speaker").alias("turn_speaker"))
    pairs = overlaps(segments.select(key, "ordinal", "start", "end"), right, width, key, longest, cuts)
    shared = F.least("end", "r_end") - F.greatest("start", "r_start")
    # max_by on (overlap, -turn): the earliest turn among equals.
    best = pairs.groupBy(key, "ordinal").agg(F.max_by(
        F.struct("turn_speaker"), F.struct(shared.alias("o"), (-F.col("turn")).alias("n"))).alias("_best"))
    numbered = Track(segments, (key,), SPAN_BY, cuts).number("_n").df
    joined = numbered.join(best, [key, "ordinal"], "left")
    fallback = F.concat(F.lit("Speaker_"), ((F.col("_n") - 1) % 2 + 1).cast("string")) if alternate else F.lit("Unknown")
    return joined.withColumn("speaker", F.coalesce("_best.turn_speaker", fallback)).drop("_best", "_n")


def pad_and_trim(regions: DataFrame, gap: float = 1.0, head: float = 0.2, longest_tail: float = 0.5,
                 total: str = "total", keys=KEYS, by=SPAN_BY, cuts: Cuts = NO_CUTS) -> DataFrame:
    """Pad each region, inside the media, and start it no earlier than the padded end before it."""
    tail = min(longest_tail, gap * 0.4)
    padded = regions.withColumns({
        "_start": F.greatest(F.lit(0.0), F.col("start") - head),
        "_end": F.least(F.col(total), F.col("end") + tail)})
    out = Track(padded, keys, by, cuts).previous(_before=F.col("_end")).df
    return out.withColumns({
        "start": F.greatest("_start", F.coalesce("_before", "_start")), "end": F.col("_end"),
    }).drop("_start", "_end", "_before")


def number_chunks(regions: DataFrame, gap: float, keys=KEYS, by=SPAN_BY, cuts: Cuts = NO_CUTS) -> DataFrame:
    """0-based chunk of each region: a silence longer than `gap` opens the next chunk."""
    track = Track(regions, keys, by, cuts).previous(_end=F.col("end"))
    opens = F.col("_end").isNull() | (F.col("start") > F.col("_end") + gap)
    track = islands(track, opens, "_chunk")
    return track.df.withColumn("chunk_id", F.col("_chunk") - 1).drop("_end", "_chunk")


def chunk_by_gap(regions: DataFrame, gap: float = 3.0, keys=KEYS, by=SPAN_BY, cuts: Cuts = NO_CUTS) -> DataFrame:
    """Chunks: first start, last end, duration and number of regions.

    The member regions stay rows (`number_chunks`), so a long chunk is never gathered.
    """
    at = F.struct(*by)
    return (
        number_chunks(regions, gap, keys, by, cuts).groupBy(*keys, "chunk_id")
        .agg(F.min_by("start", at).alias("start"), F.max_by("end", at).alias("end"), F.count(F.lit(1)).alias("regions"))
        .withColumn("duration", F.col("end") - F.col("start")))


def sessions(events: DataFrame, gap: float = 1.0, keys=KEYS, by=("t", "ordinal"), cuts: Cuts = NO_CUTS) -> DataFrame:
    """Runs of events at most `gap` apart; runs of zero length are dropped."""
    track = Track(events, keys, by, cuts).previous(_prev=F.col(by[0]))
    track = islands(track, F.col("_prev").isNull() | (F.col(by[0]) - F.col("_prev") > gap), "session")
    return (
        track.df.groupBy(*keys, "session")
        .agg(F.min(by[0]).alias("start"), F.max(by[0]).alias("end"), F.count(F.lit(1)).alias("events"))
        .filter(F.col("end") > F.col("start")))


def near_boundary(events: DataFrame, boundaries: DataFrame, duration: DataFrame, distance: float = 0.5,
                  key: str = "media_id", cuts: Cuts = NO_CUTS) -> DataFrame:
    """Flag `near_edge`: within `distance` of the media's start or end or of a boundary.

    `boundaries` has (key, t, ordinal), `duration` has (key, duration).
    """
    found = nearest(events, boundaries, key, cuts).withColumnRenamed("distance", "_d").drop("nearest_t")
    joined = attach(found, duration.select(key, "duration"), key, cuts=cuts)
    near = (F.col("t") <= distance) | (F.col("duration") - F.col("t") <= distance) | (F.col("_d") <= distance)
    return joined.withColumn("near_edge", F.coalesce(near, F.lit(False))).drop("_d", "duration")


def span_edges(spans: DataFrame, key: str = "media_id") -> DataFrame:
    """Both ends of each span as (key, t, ordinal)."""
    ends = F.array("start", "end")
    return spans.select(key, F.posexplode(ends).alias("_side", "t"), "ordinal").select(
        key, "t", (F.col("ordinal") * 2 + F.col("_side")).alias("ordinal"))


def filter_artifacts(events: DataFrame, speech: DataFrame, reference: DataFrame, duration: DataFrame, width: float,
                     edge: float = 0.5, apart: float = 0.7, key: str = "media_id", cuts: Cuts = NO_CUTS,
                     longest: float | None = None) -> DataFrame:
    """Drop music events that are likely artifacts of speech.

    In this order: an event near an edge stays; one farther than `apart` from every reference
    event stays; one inside speech is judged by its text; any other stays. Adds the three flags.
    `events` has unique (key, t, ordinal).
    """
    flagged = near_boundary(events, span_edges(speech, key), duration, edge, key, cuts)
    flagged = nearest(flagged, reference, key, cuts).withColumn("apart", F.coalesce(F.col("distance") > apart, F.lit(False)))
    flagged = flagged.drop("distance", "nearest_t")
    inside = events_in_spans(events.select(key, "t", "ordinal"), speech.select(key, "start", "end"), width, key,
                             "left_semi", cuts, longest).withColumn("in_speech", F.lit(True))
    flagged = flagged.join(inside, [key, "t", "ordinal"], "left").withColumn("in_speech", F.coalesce("in_speech", F.lit(False)))
    drop = ~F.col("near_edge") & ~F.col("apart") & F.col("in_speech") & is_artifact_text("description")
    return flagged.filter(~drop)


def unified_spans(base: DataFrame, other: DataFrame, events: DataFrame, width: float, key: str = "media_id",
                  cuts: Cuts = NO_CUTS, longest: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Common spans of two detectors, and the events of both inside them.

    A media without spans in `base` uses those in `other`. Events stay rows of (span, event), so
    a span with very many events is no problem; `write_timelines` nests them.
    """
    spans = base.unionByName(other.join(base.select(key).distinct(), key, "left_anti"))
    label = F.format_string("Audio Analysis Segment (%.1fs)", F.col("end") - F.col("start"))
    spans = spans.select(key, "ordinal", "start", "end", label.alias("description"),
                         F.lit("librosa/pyaudio").alias("source"), "confidence",
                         (F.col("end") - F.col("start")).alias("duration"))
    span_side = spans.select(key, F.col("ordinal").alias("span_ordinal"), "start", "end")
    return spans, events_in_spans(events, span_side, width, key, "inner", cuts, longest)


def rebase_times(segments: DataFrame, chunks: DataFrame, key: str = "media_id") -> DataFrame:
    """Chunk-relative times become media times, in segments and their words.

    Segments: (key, chunk_id, start, end, words, ...); chunks: (key, chunk_id, start).
    """
    shift = chunks.select(key, "chunk_id", F.col("start").alias("_shift"))
    joined = segments.join(shift, [key, "chunk_id"])
    out = joined.withColumns({"start": F.col("start") + F.col("_shift"), "end": F.col("end") + F.col("_shift")})
    if "words" in segments.columns:
        out = out.withColumn("words", F.transform("words", lambda w: w.withField("start", w["start"] + F.col("_shift"))
                                                  .withField("end", w["end"] + F.col("_shift"))))
    return out.withColumn("duration", F.col("end") - F.col("start")).drop("_shift")


def regroup_speech(segments: DataFrame, key: str = "media_id", part_rows: int = 10_000,
                   cuts: Cuts = NO_CUTS) -> DataFrame:
    """One speech span per chunk from its transcript segments.

    Text in order, outer times, duration-weighted confidence, the speaker who talks longest (the
    first seen on a tie) and the previous chunk's speaker. Segments: (key, chunk_id, ordinal,
    start, end, text, speaker, confidence). Chunks with more than `part_rows` segments give
    several rows, one per `part` of the text.
    """
    rows = valid_segments(segments)
    length = F.col("end") - F.col("start")
    group = [key, "chunk_id"]
    stats = rows.groupBy(*group).agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        (F.sum(F.col("confidence") * length) / F.sum(length)).alias("confidence"))
    talk = rows.groupBy(*group, "speaker").agg(F.sum(length).alias("_talk"), F.min("ordinal").alias("_seen"))
    primary = talk.groupBy(*group).agg(
        F.max_by("speaker", F.struct(F.round("_talk", 9).alias("a"), (-F.col("_seen")).alias("b"))).alias("speaker"))
    spans = stats.join(primary, group)
    spans = Track(spans, (key,), ("chunk_id", "start"), cuts).previous(prev_speaker=F.col("speaker")).df
    text = pack(rows, (key, "chunk_id"), ("start", "ordinal"), F.trim("text"), "_texts", cuts, part_rows)
    return spans.join(text, group).withColumn("text", F.array_join("_texts", " ")).drop("_texts")


def speech_events(segments: DataFrame, spans: DataFrame, key: str = "media_id", threshold: float = 0.3) -> DataFrame:
    """Word events inside their chunk's rounded span, and an event where the speaker changes.

    `spans` is the first part of each chunk from `regroup_speech`.
    """
    first = spans.filter(F.col("part") == 0)
    span = first.select(key, "chunk_id", F.round("start", 2).alias("_s"), F.round("end", 2).alias("_e"),
                        F.col("speaker").alias("_primary"))
    words = keep_words(valid_segments(segments), threshold).join(span, [key, "chunk_id"])
    at = F.round("word_t", 2)
    words = words.filter((at >= F.col("_s")) & (at <= F.col("_e"))).select(
        key, "chunk_id", F.col("ordinal"), F.col("word_no").cast("bigint").alias("word_no"), at.alias("t"),
        F.lit("Word").alias("description"), F.round("word_confidence", 2).alias("confidence"),
        F.col("word"), F.col("_primary").alias("speaker"), F.lit(None).cast("string").alias("prev_speaker"))
    changes = first.filter(F.col("prev_speaker").isNotNull() & (F.col("speaker") != F.col("prev_speaker"))).select(
        key, "chunk_id", F.lit(None).cast("bigint").alias("ordinal"), F.lit(None).cast("bigint").alias("word_no"),
        F.round("start", 2).alias("t"), F.lit("Speaker Change").alias("description"), F.lit(0.85).alias("confidence"),
        F.lit(None).cast("string").alias("word"), "speaker", "prev_speaker")
    return words.unionByName(changes)


def cut_scenes(frames: DataFrame, threshold: float, keys=KEYS, frame: str = "frame", score: str = "score",
               fps: str = "fps", cuts: Cuts = NO_CUTS) -> DataFrame:
    """Scenes between the frames whose difference score reaches the threshold; last end is null."""
    ordered = frames.withColumn("_o", F.lit(0).cast("bigint"))
    track = islands(Track(ordered, keys, (frame, "_o"), cuts), F.coalesce(F.col(score) >= threshold, F.lit(False)), "_cut")
    scenes = track.df.groupBy(*keys, "_cut").agg(F.min(frame).alias("start_frame"), F.max(fps).alias("fps"))
    out = Track(scenes, keys, ("start_frame", "_cut"), cuts).number("scene_id").following(end_frame=F.col("start_frame"))
    return out.df.withColumns({
        "start": F.col("start_frame") / F.col("fps"), "end": F.col("end_frame") / F.col("fps")}).drop("_cut")


def representative_frame(start_frame="start_frame", end_frame="end_frame", fps="fps") -> Column:
    s, e = F.col(start_frame), F.col(end_frame)
    return F.floor(F.when(e.isNull(), s + 3 * F.col(fps)).otherwise(s + (e - s) / 2)).cast("bigint")


def three_points(scenes: DataFrame, key: str = "media_id") -> DataFrame:
    """First, middle and last point of each scene; an open scene lasts five seconds."""
    end = F.when(F.col("end").isNull() | (F.col("end") == 0), F.col("start") + 5.0).otherwise(F.col("end"))
    span = end - F.col("start")

    def point(name, at, kind):
        path = F.format_string(f"scene_%03d_{name}.jpg", F.col("scene_id"))
        return F.struct(F.lit(name).alias("frame"), at.alias("t"), path.alias("path"), F.lit(kind).alias("type"))

    points = F.array(point("first", F.col("start"), "scene_start"),
                     point("representative", F.col("start") + span / 2, "scene_middle"),
                     point("last", end - 0.1, "scene_end"))
    return scenes.withColumn("_span", span).select(
        key, "scene_id", F.col("_span").alias("scene_duration"), F.explode(points).alias("p")).select(
        key, "scene_id", "scene_duration", "p.*")


def scene_events(points: DataFrame, descriptions: DataFrame | None = None, key: str = "media_id") -> DataFrame:
    """One event per scene at its first point, carrying the middle point's file and the scene's end."""
    def pick(name, column):
        return F.max(F.when(F.col("frame") == name, F.col(column)))
    scenes = points.groupBy(key, "scene_id").agg(
        pick("first", "t").alias("t"), pick("representative", "path").alias("representative_frame_path"),
        pick("representative", "t").alias("representative_frame_timestamp"),
        F.max("scene_duration").alias("scene_duration"), pick("last", "t").alias("scene_end_timestamp"))
    if descriptions is not None:
        scenes = scenes.join(descriptions.select(key, "scene_id", "description"), [key, "scene_id"])
    return scenes.withColumns({"source": F.lit("internvl3"), "confidence": F.lit(0.8)})


def copy_names(points: DataFrame, key: str = "media_id") -> DataFrame:
    """File name of each representative frame and its time-stamped copy."""
    minutes = F.floor(F.col("t") / 60).cast("bigint")
    name = F.format_string("%02dm%05.2fs.jpg", minutes, F.col("t") - minutes * 60.0)
    return points.filter(F.col("frame") == "representative").select(key, "scene_id", "path", name.alias("copy_name"))
