"""Reading and writing media listings, timelines, manifests, results and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediatimeline.operators.ordered import NO_CUTS, Cuts, pack

# File types of the media catalog (fixed values).
MEDIA_EXTENSIONS = ("mp4", "avi", "mov", "mkv", "webm", "wmv", "flv", "m4v", "mpg", "mpeg", "3gp", "ts")

EVENT = "struct<t:double,description:string,source:string,confidence:double,details:map<string,string>>"
SPAN = ("struct<start:double,end:double,description:string,source:string,confidence:double,"
        f"details:map<string,string>,ordinal:bigint,span_part:bigint,events:array<{EVENT}>>")
TIMELINE = f"media_id string, part bigint, duration double, spans array<{SPAN}>, events array<{EVENT}>"

ERROR_LOG = ("timestamp timestamp, video_path string, video_name string, error_stage string, tool_name string, "
             "error_type string, error_message string, recovery_attempts array<struct<success:boolean,action:string,"
             "message:string,timestamp:timestamp>>, final_action string")
RESULTS = ("filename string, success boolean, processing_time double, output_path string, error string, "
           "completed_at timestamp, failed_at timestamp")


def media_catalog(spark: SparkSession, path: str, extensions: tuple[str, ...] = MEDIA_EXTENSIONS,
                  smallest: int = 1024) -> DataFrame:
    """Media files under a folder: path, length and time only, the content is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        "path", "length", "modificationTime")
    return files.filter(F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*extensions) & (F.col("length") >= smallest))


def media_info(files: DataFrame) -> DataFrame:
    """Name, size in MiB, time and lower-case extension of each file."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select(
        "path", name.alias("name"), F.col("length").alias("size_bytes"), F.round(F.col("length") / 1048576.0, 1).alias("size_mb"),
        F.col("modificationTime").alias("modified"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("extension"))


def browse_order(entries: DataFrame, is_dir: str = "is_dir", name: str = "name") -> DataFrame:
    """Folders first, then by name without case."""
    return entries.orderBy(F.col(is_dir).desc(), F.lower(name), name)


def nest_timelines(media: DataFrame, spans: DataFrame, span_events: DataFrame, events: DataFrame,
                   part_rows: int = 10_000, cuts: Cuts = NO_CUTS) -> DataFrame:
    """Nested timeline rows: spans with their events by time, standalone events by time.

    `span_events` are event rows with `span_ordinal`. Media, or spans, with more than `part_rows`
    members are written in several parts, so no row or task grows without bound. A span split over
    parts repeats its head with the same ordinal and the next span_part; `flatten_timelines` counts it
    once. Media with rows but without a media row stay, with a null duration.
    """
    event = F.struct("t", "description", "source", "confidence", "details")
    inner = pack(span_events, ("media_id", "span_ordinal"), ("t", "ordinal"), event, "_events", cuts, part_rows, has_maps=True)
    inner = inner.withColumnsRenamed({"span_ordinal": "ordinal", "part": "_span_part"})
    whole = spans.join(inner, ["media_id", "ordinal"], "left").withColumn("_span_part", F.coalesce("_span_part", F.lit(0).cast("bigint")))
    none = F.array().cast(f"array<{EVENT}>")
    span = F.struct("start", "end", "description", "source", "confidence", "details", "ordinal",
                    F.col("_span_part").alias("span_part"), F.coalesce("_events", none).alias("events"))
    span_parts = pack(whole, ("media_id",), ("start", "ordinal", "_span_part"), span, "spans", cuts, part_rows, has_maps=True)
    event_parts = pack(events, ("media_id",), ("t", "ordinal"), event, "events", cuts, part_rows, has_maps=True)
    # Stacked, not joined: parts of a media are in one task already, and joins on (media_id, part) would move them all again.
    first = media.select("media_id", F.lit(0).cast("bigint").alias("part"), "duration")
    stacked = span_parts.unionByName(event_parts, allowMissingColumns=True).unionByName(first, allowMissingColumns=True)
    keyed = stacked.groupBy("media_id", "part").agg(
        F.any_value("spans", True).alias("spans"), F.any_value("events", True).alias("events"), F.max("duration").alias("_duration"))
    return keyed.select(
        F.col("media_id").cast("string").alias("media_id"), "part", F.max("_duration").over(Window.partitionBy("media_id")).alias("duration"),
        F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"),
        F.coalesce("events", none).alias("events"))


def write_timelines(timelines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, compressed: field names and equal texts come with every event."""
    timelines.write.mode(mode).option("ignoreNullFields", False).option("compression", "gzip").json(path)


def read_timelines(spark: SparkSession, *paths: str) -> DataFrame:
    """Nested timeline rows from JSON; files that vanish while reading are skipped."""
    return spark.read.schema(TIMELINE).option("ignoreMissingFiles", True).json(list(paths))


def flatten_timelines(timelines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spans, events inside spans, standalone events) rows of nested timelines."""
    spans = timelines.select("media_id", "part", F.explode("spans").alias("s"))
    heads = spans.where("s.span_part = 0").select("media_id", "part", "s.ordinal", "s.start", "s.end", "s.description", "s.source",
                                                  "s.confidence", "s.details")
    inner = spans.select("media_id", "part", "s.ordinal", "s.span_part", F.posexplode("s.events").alias("event_no", "e")).select(
        "media_id", "part", F.col("ordinal").alias("span_ordinal"), "span_part", "event_no", "e.*")
    single = timelines.select("media_id", "part", F.posexplode("events").alias("event_no", "e")).select(
        "media_id", "part", "event_no", "e.*")
    return heads, inner, single


def frame_metadata(points: DataFrame, key: str = "media_id") -> DataFrame:
    """Map "scene_003" -> {first, representative, last} of each media's scene points, 1000 scenes a row, entries in order."""
    frame = F.struct("frame", F.struct("t", "path", "type").alias("v"))
    entry = F.struct("scene_id", F.sort_array(F.collect_list(frame)).alias("frames"))
    scenes = points.groupBy(key, "scene_id").agg(entry.alias("entry"))
    named = F.transform(F.sort_array(F.collect_list("entry")), lambda e: F.struct(
        F.format_string("scene_%03d", e["scene_id"]).alias("k"), F.map_from_entries(e["frames"]).alias("v")))
    return scenes.groupBy(key, F.floor((F.col("scene_id") - 1) / 1000).alias("part")).agg(F.map_from_entries(named).alias("scenes"))


def scene_offsets(scenes: DataFrame) -> DataFrame:
    """Clip file, original times, duration and middle of each scene; open scenes use three seconds."""
    length = F.col("end") - F.col("start")
    return scenes.withColumns({
        "clip": F.format_string("scene_%03d.mp4", "scene_id"), "duration_seconds": length,
        "representative_timestamp": F.coalesce(F.col("start") + length / 2, F.col("start") + 3.0)})


def latest_per_family(files: DataFrame, order: tuple[str, ...] = ("contextual", "noncontextual", "legacy"),
                      key: str = "media_id") -> DataFrame:
    """Newest file of each family, and the first family present. Files: (key, family, path, mtime)."""
    newest = [F.max_by(F.when(F.col("family") == f, F.col("path")),
                       F.when(F.col("family") == f, F.struct("mtime", "path"))).alias(f) for f in order]
    out = files.groupBy(key).agg(*newest)
    others = [F.col(f).isNotNull() for f in order[:-1]]
    covered = others[0]
    for o in others[1:]:
        covered = covered | o
    return out.withColumn("chosen", F.coalesce(*order)).withColumn(order[-1], F.when(~covered, F.col(order[-1])))


def read_error_log(spark: SparkSession, path: str) -> DataFrame:
    """Error rows; lines that are not valid rows are skipped."""
    return spark.read.schema(ERROR_LOG).option("mode", "DROPMALFORMED").json(path)


def append_rows(rows: DataFrame, path: str) -> None:
    """Append to a JSON-lines folder (results and error logs)."""
    rows.write.mode("append").json(path)


def write_manifest(items: DataFrame, root: str, version: int) -> str:
    """Write a batch manifest as a new version; earlier versions stay readable."""
    path = f"{root.rstrip('/')}/version={version}"
    items.write.mode("overwrite").parquet(path)
    return path
