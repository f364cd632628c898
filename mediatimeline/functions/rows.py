"""Row constructors, cleaning and filters for events and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Display names of event and span types (fixed values); others are title-cased.
TITLES = {
    "tempo_change": "Tempo Change",
    "musical_onset": "Musical Onset",
    "harmonic_shift": "Harmonic Shift",
    "energy_increase": "Energy Increase",
    "energy_decrease": "Energy Decrease",
    "structural_segment": "Structural Segment",
    "opening": "Opening Section",
    "middle": "Middle Section",
    "closing": "Closing Section",
    "speaker_change": "Speaker Change",
    "emotion_change": "Emotion Change",
    "sound_effect": "Sound Effect",
    "audio_transition": "Audio Transition",
    "car_horn": "Car Horn",
    "applause": "Applause",
    "door_slam": "Door Slam",
    "speech": "Speech",
    "music": "Music",
    "environment": "Environment Span",
}

# Phrases a transcriber makes up over silence (fixed values).
INVENTED_PHRASES = (
    "thank you", "thanks for", "subscribe", "like and", "bye", "bye bye", "please sub", "the end",
    "my channel", "the channel", "for watching", "thank you for watching", "see you next", "full video",
)


def title(kind: Column | str) -> Column:
    kind = F.col(kind) if isinstance(kind, str) else kind
    names = F.create_map(*[F.lit(x) for pair in TITLES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, kind), F.initcap(F.translate(kind, "_", " ")))


def stored_confidence(confidence: Column | str) -> Column:
    """Two decimals; exactly 1.0 is stored as null."""
    c = F.col(confidence) if isinstance(confidence, str) else confidence
    return F.when(c != 1.0, F.round(c, 2))


def no_details() -> Column:
    return F.create_map().cast("map<string,string>")


def make_events(df: DataFrame, source: Column | str, kind: Column | str = "kind", details: Column | None = None,
                key: str = "media_id") -> DataFrame:
    """Event rows from (key, ordinal, t, kind, confidence)."""
    source = F.lit(source) if isinstance(source, str) else source
    return df.select(
        key, "ordinal", F.round("t", 2).alias("t"), title(kind).alias("description"), source.alias("source"),
        stored_confidence("confidence").alias("confidence"),
        (no_details() if details is None else details).alias("details"))


def make_spans(df: DataFrame, source: Column | str, kind: Column | str = "kind", details: Column | None = None,
               key: str = "media_id") -> DataFrame:
    """Span rows from (key, ordinal, start, end, kind, confidence)."""
    source = F.lit(source) if isinstance(source, str) else source
    return df.select(
        key, "ordinal", F.round("start", 2).alias("start"), F.round("end", 2).alias("end"),
        title(kind).alias("description"), source.alias("source"),
        stored_confidence("confidence").alias("confidence"),
        (no_details() if details is None else details).alias("details"))


def clean_details(details: Column | str) -> Column:
    """Drop null, empty and zero-valued entries, as the stored documents do ("false" counts as zero)."""
    details = F.col(details) if isinstance(details, str) else details
    return F.map_filter(
        details,
        lambda k, v: v.isNotNull() & (v != "") & (F.lower(v) != "false")
        & ~F.coalesce(v.try_cast("double") == 0.0, F.lit(False)))


def is_valid_object(df: DataFrame) -> Column:
    """Required fields of a stored event or span, by its type."""
    def present(*names):
        ok = F.lit(True)
        for n in names:
            ok = ok & F.col(n).isNotNull()
        return ok
    common = present("type", "description", "category", "source", "confidence")
    by_type = F.when(F.col("type") == "event", present("timestamp")).when(
        F.col("type") == "span", present("start", "end", "duration")).otherwise(F.lit(False))
    return common & F.coalesce(by_type, F.lit(False))


def validate_objects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rows for quarantine)."""
    ok = is_valid_object(df)
    return df.filter(ok), df.filter(~ok)


def check_source(rows: DataFrame, timelines: DataFrame, key: str = "media_id") -> DataFrame:
    """Rows whose source differs from the source of their timeline (key, timeline_source)."""
    joined = rows.join(timelines.select(key, "timeline_source"), key)
    return joined.filter(~F.col("source").eqNullSafe(F.col("timeline_source")))


def is_salient(description="description", source="source") -> Column:
    """Standalone events worth keeping in a merged timeline."""
    d = F.col(description)
    return d.contains("Harmonic Shift") | d.contains("Tempo Change") | (F.col(source) == "whisper_voice")


def is_invented(text="text", no_speech_prob="no_speech_prob", avg_logprob="avg_logprob",
                phrases: tuple[str, ...] = INVENTED_PHRASES) -> Column:
    """Is this transcript segment likely made up by the transcriber?

    Every listed phrase in the text lowers the confidence, long ones more; the order of the
    phrases does not matter because the total only has to pass below one half.
    """
    low = F.lower(F.trim(F.coalesce(F.col(text), F.lit(""))))
    confidence = 1.0 - F.coalesce(F.col(no_speech_prob), F.lit(0.0))
    hit = [(low.contains(p), 0.35 if len(p) > 10 else 0.15) for p in phrases]
    penalty = sum((F.when(found, cost).otherwise(0.0) for found, cost in hit), F.lit(0.0))
    any_hit = F.lit(False)
    for found, _ in hit:
        any_hit = any_hit | found
    return (confidence < 0.3) | (F.coalesce(F.col(avg_logprob), F.lit(0.0)) < -1.0) | (
        any_hit & (confidence - penalty < 0.5))


def drop_invented(df: DataFrame, **columns) -> DataFrame:
    return df.filter(~is_invented(**columns))


def keep_words(segments: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per spoken word worth an event, from `words array<struct<word,start,end,confidence,...>>`."""
    fields = segments.select(F.explode("words").alias("w")).select("w.*").columns
    sure = [F.col(f"w.{c}") for c in ("confidence", "probability") if c in fields]
    exploded = segments.select("*", F.posexplode("words").alias("word_no", "w"))
    return (
        exploded.withColumn("word", F.trim("w.word"))
        .withColumn("word_t", F.coalesce(F.col("w.start"), F.lit(0.0)))
        .withColumn("word_confidence", F.coalesce(*sure, F.lit(1.0)))
        .filter((F.col("word") != "") & (F.col("word_confidence") >= threshold))
        .drop("w", "words"))


def drop_background(df: DataFrame, label="label", confidence: str | None = None, above: float | None = None) -> DataFrame:
    kept = df.filter(F.col(label) != "background")
    return kept if above is None else kept.filter(F.col(confidence or "confidence") > above)


def exclude_sources(events: DataFrame, sources: tuple[str, ...] = ("pyaudio_voice", "pyaudio_music", "librosa_music")):
    return events.filter(~F.col("source").isin(*sources))


def valid_segments(segments: DataFrame) -> DataFrame:
    return segments.filter((F.trim("text") != "") & (F.col("start") < F.col("end")))


def enabled(flags: dict[str, bool], analyses: dict):
    """The sub-plans to build: an analysis without a flag is on."""
    return {name: plan for name, plan in analyses.items() if flags.get(name, True)}
