"""Aggregates over timelines, batches, failures and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mediatimeline.functions.rules import failure_status
from mediatimeline.operators.change import circuit_breaker
from mediatimeline.operators.ordered import NO_CUTS, Cuts, Track, pack

STATUSES = ("pending", "in_progress", "completed", "failed")


def timeline_totals(spans: DataFrame, span_events: DataFrame, events: DataFrame, key: str = "media_id") -> DataFrame:
    """Spans, events in spans, standalone events and sources of each media.

    The three inputs are stacked before one aggregate, so there is one shuffle and no join.
    """
    def part(df, kind):
        return df.select(key, F.lit(kind).alias("_kind"), "source")
    rows = part(spans, "span").unionByName(part(span_events, "inner")).unionByName(part(events, "single"))

    def count(*kinds):
        return F.count_if(F.col("_kind").isin(*kinds))
    return rows.groupBy(key).agg(
        count("span").alias("total_spans"), count("inner", "single").alias("total_events"),
        count("inner").alias("span_events"), count("single").alias("standalone_events"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources_used"))


def merge_metadata(timelines: DataFrame, key: str = "media_id", label: str = "demucs_combined", part_rows: int = 10_000,
                   cuts: Cuts = NO_CUTS, whole: bool = False) -> DataFrame:
    """Combined speakers, sources, notes and transcript of the timelines of each media.

    Timelines: (key, ordinal, source, transcript, speakers, notes). A media has a handful of them, so
    one row; transcripts and notes of more than `part_rows` timelines come in parts. `whole` puts the parts of a media into
    one row all the same: its transcript must stay under 2 GB, the most a value can hold, and a task needs a few times that.
    """
    if whole:
        # Rows go straight from their tasks to the one of their media, which holds them and the text made of them, once each:
        # parts, a join or a projection behind the aggregate would each hold the text again.
        def gathered(name: str, there: Column) -> Column:
            return F.sort_array(F.collect_list(F.when(there, F.struct("ordinal", name))))[name]

        speakers = F.array_compact(F.flatten(F.collect_set("speakers")))
        notes = F.transform("notes", lambda n: F.concat(F.lit("["), F.col("source"), F.lit("] "), n))
        return timelines.withColumn("_notes", notes).groupBy(key).agg(
            F.array_sort(F.array_distinct(speakers)).alias("speakers"),
            F.concat(F.array(F.lit(label)), F.array_sort(F.collect_set("source"))).alias("sources_used"),
            F.lit(0).cast("bigint").alias("part"), F.concat_ws(" ", gathered("transcript", F.col("transcript") != "")).alias("transcript"),
            F.flatten(gathered("_notes", F.col("_notes").isNotNull())).alias("notes"))
    sets = timelines.withColumn("_speaker", F.explode_outer("speakers")).groupBy(key).agg(
        F.array_sort(F.collect_set("_speaker")).alias("speakers"),
        F.concat(F.array(F.lit(label)), F.array_sort(F.collect_set("source"))).alias("sources_used"))
    notes = F.transform("notes", lambda n: F.concat(F.lit("["), F.col("source"), F.lit("] "), n))
    value = F.struct("transcript", F.coalesce(notes, F.array().cast("array<string>")).alias("notes"))
    texts = pack(timelines, (key,), ("ordinal", "ordinal"), value, "_texts", cuts, part_rows)
    spoken = F.filter(F.transform("_texts", lambda x: x["transcript"]), lambda x: x != "")
    texts = texts.select(key, "part", F.array_join(spoken, " ").alias("transcript"),
                         F.flatten(F.transform("_texts", lambda x: x["notes"])).alias("notes"))
    return sets.join(texts, key)


def transcript_stats(segments: DataFrame, chunks: DataFrame, key: str = "media_id") -> DataFrame:
    """Speakers, speech duration and segment averages per media; the text comes from `transcript`."""
    speaker = F.when(F.col("speaker") != "Unknown", F.col("speaker"))
    length = F.col("end") - F.col("start")
    stats = segments.groupBy(key).agg(
        F.array_sort(F.collect_set(speaker)).alias("_speakers"), F.count(F.lit(1)).alias("segments_count"),
        F.avg(length).alias("average_segment_duration"), F.avg("confidence").alias("average_confidence"),
        F.max("end").alias("duration"))
    speech = chunks.groupBy(key).agg(
        F.sum("duration").alias("total_speech_duration"), F.count(F.lit(1)).alias("total_chunks"))
    speakers = F.when(F.size("_speakers") == 0, F.array(F.lit("Speaker_1"))).otherwise(F.col("_speakers"))
    return stats.join(speech, key, "left").withColumn("speakers", speakers).withColumn(
        "speaker_count", F.size("speakers")).drop("_speakers")


def transcript(segments: DataFrame, key: str = "media_id", part_rows: int = 10_000, cuts: Cuts = NO_CUTS) -> DataFrame:
    """Non-empty segment texts joined in order, in parts of bounded size."""
    rows = segments.filter(F.trim("text") != "")
    texts = pack(rows, (key,), ("start", "ordinal"), F.col("text"), "_texts", cuts, part_rows)
    return texts.withColumn("transcript", F.array_join("_texts", " ")).drop("_texts")


def batch_summary(items: DataFrame, key: str = "batch_id") -> DataFrame:
    """Counts by status, and the batch's own state: active until nothing is left to run."""
    counts = [F.count_if(F.col("status") == s).alias(f"{s}_count") for s in STATUSES]
    out = items.groupBy(key).agg(F.count(F.lit(1)).alias("total_videos"), *counts)
    open_items = F.col("pending_count") + F.col("in_progress_count")
    return out.withColumn("state", F.when(open_items > 0, "active").otherwise("completed"))


def failure_stats(items: DataFrame, failed: Column, at: str, limit: int = 3, keys=("batch_id",), by=("seq", "item"),
                  cuts: Cuts = NO_CUTS) -> DataFrame:
    """Totals, success rate, last failure, current streak and the resulting status."""
    first, second = by
    order = F.struct(first, second)
    bad = F.coalesce(failed, F.lit(False)).cast("int")
    streaks = circuit_breaker(items, failed, limit, keys, by, cuts)
    out = streaks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_processed"), F.sum(bad).alias("total_failures"),
        F.max(F.when(failed, F.col(at))).alias("last_failure"), F.max_by("streak", order).alias("consecutive_failures"))
    rate = (F.col("total_processed") - F.col("total_failures")) * 100.0 / F.col("total_processed")
    out = out.withColumns({"success_rate": rate, "is_tripped": F.col("consecutive_failures") >= limit})
    return out.withColumn("status", failure_status("is_tripped", "total_processed", "total_failures",
                                                   "consecutive_failures", limit))


def error_summary(errors: DataFrame, now: Column, hours: float = 24, at: str = "timestamp", kind: str = "error_type") -> DataFrame:
    """Errors per type since `now` - `hours`."""
    recent = errors.filter(F.col(at) >= now - F.make_dt_interval(secs=F.lit(hours * 3600)))
    return recent.groupBy(F.coalesce(kind, F.lit("unknown")).alias(kind)).agg(F.count(F.lit(1)).alias("errors"))


# Advice rules (fixed values): error types, more than, issue, solution, setting, priority.
ADVICE = (
    (("gpu_memory", "gpu_error"), 2, "Frequent GPU memory errors",
     "Reduce batch size or enable CPU fallback for GPU tools",
     "Set gpu_pipeline.max_gpu_memory_usage = 0.7", "high"),
    (("ffmpeg_format", "ffmpeg_error"), 1, "Video format compatibility issues",
     "Enable automatic format conversion in FFmpeg settings",
     "Set ffmpeg.enable_format_fallback = true", "medium"),
    (("scene_no_detection", "scene_error"), 1, "Scene detection failures",
     "Adjust scene detection threshold or enable time-based fallback",
     "Set scene_detection.fallback_to_time_based = true", "medium"),
)


def error_suggestions(summary: DataFrame, kind: str = "error_type") -> DataFrame:
    """Advice for error types that come up too often."""
    spark = summary.sparkSession
    rules = spark.createDataFrame(
        [(k, m, *rest) for kinds, m, *rest in ADVICE for k in kinds],
        "rule_type string, more_than bigint, issue string, solution string, config_change string, priority string")
    hit = summary.join(F.broadcast(rules), F.col(kind) == F.col("rule_type"))
    return hit.filter(F.col("errors") > F.col("more_than")).drop("rule_type", "more_than")


def batch_report(items: DataFrame, key: str = "batch_id") -> DataFrame:
    """Totals and success rate per batch; the failed items are `failed_items`, one row each."""
    good = F.count_if(F.col("status") == "completed")
    out = items.groupBy(key).agg(F.count(F.lit(1)).alias("total_videos"), good.alias("successful"))
    return out.withColumns({
        "failed": F.col("total_videos") - F.col("successful"),
        "success_rate": F.when(F.col("total_videos") > 0, F.round(F.col("successful") * 100.0 / F.col("total_videos"), 1)),
    })


def failed_items(items: DataFrame, key: str = "batch_id") -> DataFrame:
    name, error = F.coalesce("filename", F.lit("Unknown")), F.coalesce("error", F.lit("Unknown error"))
    return items.filter(F.col("status") != "completed").select(key, "item", F.concat(name, F.lit(": "), error).alias("line"))


def combine_scene_results(speech: DataFrame, music: DataFrame, visual: DataFrame, keys=("media_id", "scene_id")) -> DataFrame:
    """Speech, music and visual results of each scene in one row; people are objects of class person.

    Speech: transcript, speakers. Music: features, classification. Visual: objects
    array<struct<class,...>>, text_content.
    """
    joined = speech.join(music, list(keys), "full").join(visual, list(keys), "full")
    objects = F.coalesce(F.col("objects"), F.filter("objects", lambda o: F.lit(False)))
    people = F.coalesce(F.size(F.filter("objects", lambda o: o["class"] == "person")), F.lit(0))
    return joined.withColumns({
        "transcript": F.coalesce("transcript", F.lit("")), "speakers": F.coalesce("speakers", F.array().cast("array<string>")),
        "people_count": F.when(F.col("objects").isNull(), 0).otherwise(people), "objects": objects,
        "text_content": F.coalesce("text_content", F.array().cast("array<string>"))})


def processing_summary(stages: DataFrame, errors: DataFrame, scenes: DataFrame, key: str = "media_id") -> DataFrame:
    """Stages seen, errors and scenes of each media: three inputs stacked under one aggregate."""
    none = F.lit(None).cast("string")
    rows = (stages.select(key, F.lit("stage").alias("_kind"), "stage")
            .unionByName(errors.select(key, F.lit("error").alias("_kind"), none.alias("stage")))
            .unionByName(scenes.select(key, F.lit("scene").alias("_kind"), none.alias("stage"))))
    return rows.groupBy(key).agg(
        F.count_if(F.col("_kind") == "scene").alias("scene_count"),
        F.array_join(F.array_sort(F.collect_set("stage")), ",").alias("processing_stages"),
        F.count_if(F.col("_kind") == "error").alias("error_count"))


def library_estimate(files: DataFrame, minutes_each: float = 10.0, length: str = "length") -> DataFrame:
    return files.agg(F.count(F.lit(1)).alias("files"), F.round(F.sum(length) / 1048576.0, 1).alias("total_mb")).withColumn(
        "estimated_minutes", F.col("files") * minutes_each)


def parse_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """Time, outcome, minutes and error of each log line that starts with a time."""
    v = F.col(line)
    at = F.regexp_extract(v, r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1)
    kind = (F.when(v.contains("Processing completed successfully"), "success")
            .when(v.contains("Processing failed"), "failure").when(v.contains("Starting processing:"), "start"))
    minutes = F.nullif(F.regexp_extract(v, r"Processing time: (\d+\.?\d*) minutes", 1), F.lit("")).cast("double")
    error = F.nullif(F.split(F.regexp_extract(v, r"Error: (.+)", 1), ":")[0], F.lit(""))
    rows = lines.filter(at != "").select(at.cast("timestamp_ntz").alias("at"), kind.alias("kind"), minutes.alias("minutes"),
                                         error.alias("error"))
    return rows.filter(F.col("kind").isNotNull()).withColumns({
        "minutes": F.when(F.col("kind") == "success", F.col("minutes")),
        "error": F.when(F.col("kind") == "failure", F.col("error"))})


def log_report(log: DataFrame) -> DataFrame:
    """Runs, outcomes, success rate and minutes per day, and over all days (null day)."""
    out = log.withColumn("day", F.date_format("at", "yyyy-MM-dd")).rollup("day").agg(
        F.count_if(F.col("kind") == "start").alias("started"), F.count_if(F.col("kind") == "success").alias("successful"),
        F.count_if(F.col("kind") == "failure").alias("failed"), F.avg("minutes").alias("mean_minutes"),
        F.min("minutes").alias("min_minutes"), F.max("minutes").alias("max_minutes"))
    rate = F.when(F.col("started") > 0, F.round(F.col("successful") * 100.0 / F.col("started"), 1)).otherwise(0.0)
    return out.withColumn("success_rate", rate)


def top_errors(log: DataFrame, k: int = 5) -> DataFrame:
    counts = log.filter(F.col("error").isNotNull()).groupBy("error").agg(F.count(F.lit(1)).alias("occurrences"))
    return counts.orderBy(F.desc("occurrences"), "error").limit(k)


# Alert rules (fixed values): metric, warning, critical; "below" alerts when the value is under.
ALERTS = (
    ("disk_free_gb", 50.0, 20.0, "below"),
    ("memory_percent", 80.0, 95.0, "above"),
    ("gpu_celsius", 80.0, 90.0, "above"),
    ("error_rate_percent", 10.0, 25.0, "above"),
)


def alert_level(metric: Column, value: Column, rules=ALERTS) -> Column:
    """critical, warning or null, by the rule of the metric; the rules are constants of the expression, not a table to join."""
    level = F.lit(None).cast("string")
    for rule, warning, critical, side in rules:
        sign = -1.0 if side == "below" else 1.0
        own = F.when(value * sign >= critical * sign, "critical").when(value * sign >= warning * sign, "warning")
        level = F.when(metric == rule, own).otherwise(level)
    return level


def threshold_alerts(metrics: DataFrame, rules=ALERTS, metric: str = "metric", value: str = "value") -> DataFrame:
    """Warning or critical rows of (metric, value)."""
    return metrics.withColumn("level", alert_level(F.col(metric), F.col(value), rules)).filter(F.col("level").isNotNull())


def consecutive_failures(rows: DataFrame, failed: Column, limit: int = 3, minutes: float = 60.0, keys=("media_id",),
                         by=("t", "ordinal"), cuts: Cuts = NO_CUTS) -> DataFrame:
    """Rows at which `limit` rows in a row have failed within `minutes`, with the time of the first of them (`since`)."""
    track = Track(rows.withColumn("_bad", F.coalesce(failed, F.lit(False))), keys, by, cuts)
    here = F.struct(F.col(by[0]).alias("t"), F.col("_bad").alias("bad"))
    for back in range(1, limit):
        track = track.previous(**{f"_b{back}": here if back == 1 else F.col(f"_b{back - 1}")})
    first = F.col(f"_b{limit - 1}")["t"] if limit > 1 else F.col(by[0])
    all_bad = F.col("_bad")
    for back in range(1, limit):
        all_bad = all_bad & F.coalesce(F.col(f"_b{back}")["bad"], F.lit(False))
    found = track.df.withColumn("since", first).where(all_bad & (F.col(by[0]) - F.col("since") <= minutes * 60))
    return found.drop("_bad", *[f"_b{back}" for back in range(1, limit)])


def error_rate_alerts(rows: DataFrame, failed: Column, hours: int = 24, pane: float = 3600.0, t: str = "t", keys: tuple[str, ...] = (),
                      rules=ALERTS) -> DataFrame:
    """One alert for each rise of the failure percentage of the last `hours` to warning, or from warning to critical.

    Rows are counted in panes of one hour (`pane` seconds), and a range frame adds up the last `hours` panes at every pane
    that has rows, so a burst counts whole wherever it lies. A pane is no rise if the window before it had the same level or
    a higher one; after `hours` panes without rows nothing is left of the window before. Columns: keys, pane (its
    number), rows, value (percentage), level. After the first count only panes are moved: one row per key and hour.
    """
    panes = rows.groupBy(*keys, F.floor(F.col(t) / pane).cast("bigint").alias("pane")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(failed).alias("_bad"))
    along = Window.partitionBy(*keys).orderBy("pane")
    back = along.rangeBetween(-(hours - 1), 0)
    value = F.col("_f") * 100.0 / F.col("rows")
    seen = panes.withColumns({"rows": F.sum("_n").over(back), "_f": F.sum("_bad").over(back)}).withColumn("value", value)
    rated = seen.withColumn("level", alert_level(F.lit("error_rate_percent"), F.col("value"), rules))
    rank = F.when(F.col("level") == "critical", 2).when(F.col("level") == "warning", 1).otherwise(0)
    ranked = rated.withColumn("_rank", rank)
    before = F.when(F.col("pane") - F.lag("pane").over(along) < hours, F.lag("_rank").over(along)).otherwise(0)
    return ranked.withColumn("_before", before).filter(F.col("_rank") > F.col("_before")).select(*keys, "pane", "rows", "value", "level")


def apply_updates(items: DataFrame, updates: DataFrame, fields: tuple[str, ...], keys=("batch_id", "item")) -> DataFrame:
    """Last value of each updated field wins; fields without an update stay.

    Updates: (keys, seq, fields...), null where the update does not touch the field.
    """
    latest = updates.groupBy(*keys).agg(*[
        F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"_{f}") for f in fields])
    joined = items.join(latest, list(keys), "left")
    return joined.withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])


def retry_failed(items: DataFrame, clear: tuple[str, ...] = ("current_stage", "started_at", "completed_at",
                                                              "processing_time", "error")) -> DataFrame:
    """Failed items become pending with their run fields cleared."""
    failed = F.col("status") == "failed"
    cleared = {c: F.when(~failed, F.col(c)) for c in clear if c in items.columns}
    return items.withColumns({**cleared, "status": F.when(failed, "pending").otherwise(F.col("status"))})


def recover_interrupted(items: DataFrame, batches: DataFrame, key: str = "batch_id") -> tuple[DataFrame, DataFrame]:
    """Batches left processing become paused, and their items in progress become pending."""
    hit = batches.filter(F.col("status") == "processing").select(key, F.lit(True).alias("_hit"))
    joined = items.join(hit, key, "left")
    reset = F.coalesce(F.col("_hit"), F.lit(False)) & (F.col("status") == "in_progress")
    fixed = joined.withColumns({
        "status": F.when(reset, "pending").otherwise(F.col("status")),
        **({"current_stage": F.when(~reset, F.col("current_stage"))} if "current_stage" in items.columns else {}),
    }).drop("_hit")
    paused = batches.withColumn("status", F.when(F.col("status") == "processing", "paused").otherwise(F.col("status")))
    return fixed, paused


def pending_work(items: DataFrame, results: DataFrame, keys=("batch_id", "item")) -> DataFrame:
    """Items without a completed result."""
    return items.join(results.filter(F.col("status") == "completed").select(*keys).distinct(), list(keys), "left_anti")


def _ranked(probabilities: Column) -> Column:
    """Entries of a map that sort by falling probability, then by their place in the map."""
    return F.transform(F.map_entries(probabilities), lambda e, i: F.struct(
        (-e["value"]).alias("n"), i.alias("place"), e["key"].alias("label")))


def top_labels(df: DataFrame, probabilities: str = "probabilities", k: int = 5, floor: float = 0.1) -> DataFrame:
    """The k most likely labels over the floor, and the best one (background at the floor if none); of equals the first seen."""
    entries = F.array_sort(_ranked(F.col(probabilities)))
    top = F.filter(F.slice(entries, 1, k), lambda e: -e["n"] > floor)
    best = F.when(F.size("_top") > 0, F.struct(F.col("_top")[0]["label"].alias("label"),
                                               (-F.col("_top")[0]["n"]).alias("confidence"))).otherwise(
        F.struct(F.lit("background").alias("label"), F.lit(floor).alias("confidence")))
    return (df.withColumn("_top", top).withColumn("_best", best)
            .withColumns({"label": F.col("_best.label"), "confidence": F.col("_best.confidence"),
                          "top": F.transform("_top", lambda e: e["label"])}).drop("_top", "_best"))


def argmax_label(probabilities: Column | str) -> Column:
    p = F.col(probabilities) if isinstance(probabilities, str) else probabilities
    return F.array_min(_ranked(p))["label"]
