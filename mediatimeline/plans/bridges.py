"""The driver's tables read as timeline rows, in Spark and, for the check, in SQL.

Each method of `Tables` has a SQL text of the same name that computes the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediatimeline.functions.render import word_count
from mediatimeline.operators.ordered import Cuts, Track, find_cuts
from mediatimeline.session import rows_per_task, tune

_ROWS: dict[str, int] = {}


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def rows(self, table: str) -> int:
        """Rows of a table, from its file footers. A stale number could only change the balance, so it is kept."""
        name = f"{self.folder}/{table}"
        if name not in _ROWS:
            _ROWS[name] = self.table(table).count()
        return _ROWS[name]

    def cuts(self, table: str, rows: DataFrame, key: str = "media_id", by=("t", "ordinal"), copies: int = 1) -> Cuts:
        """Cuts of the groups of `rows`, which come from `table`; a small table needs no look.

        `copies` bounds how many rows one row of the table can give.
        """
        if self.rows(table) * copies <= rows_per_task(self.spark):
            return Cuts(key)
        return find_cuts(rows, key, by)

    # events as detector rows ------------------------------------------------------------------

    @cached_property
    def ev(self) -> DataFrame:
        t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("double") / 3.6e9
        k = F.get_json_object("props", "$.k").cast("int")
        label = F.when(F.col("event_type") == "view", "background").otherwise(F.col("event_type"))
        return self.table("events").select(
            F.col("user_id").alias("media_id"), F.col("event_id").alias("ordinal"), t.alias("t"), label.alias("label"),
            k.alias("k"), (k / 100.0).alias("confidence"), "value")

    @cached_property
    def ev_cuts(self) -> Cuts:
        return self.cuts("events", self.ev)

    @cached_property
    def feat(self) -> DataFrame:
        """Window features made of the event columns."""
        return self.ev.withColumns({
            "energy": F.col("k") / 200.0, "zcr": (F.col("ordinal") % 21) / 100.0, "centroid": F.col("value") * 10.0,
            "rolloff": F.col("value") * 12.0, "f0": F.col("value"), "tempo": F.col("k") + 60.0,
            "harmonic_ratio": F.col("k") / 100.0})

    @cached_property
    def ev_media(self) -> DataFrame:
        """One row per media with its duration."""
        return self.ev.groupBy("media_id").agg((F.max("t") + 1.0).alias("duration"))

    # orders and line items as spans and events ------------------------------------------------

    @cached_property
    def ol_spans(self) -> DataFrame:
        day = F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("double")
        return self.table("orders").select(
            F.col("o_custkey").alias("media_id"), F.col("o_orderkey").alias("ordinal"), day.alias("start"),
            (day + 30.0).alias("end"), (F.col("o_orderkey") % 100 / 100.0).alias("confidence"),
            F.col("o_orderpriority").alias("description"))

    @cached_property
    def ol_events(self) -> DataFrame:
        day = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date")).cast("double")
        # (order, line, part, supplier) is unique; one number out of it orders the events.
        number = ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")
        owner = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("media_id"))
        # Computed before the join: one number is moved instead of the four that it is made of.
        lines = self.table("lineitem").select("l_orderkey", number.alias("ordinal"), day.alias("t"), F.col("l_returnflag").alias("source"),
                                              F.col("l_quantity").alias("quantity"))
        return lines.join(owner, "l_orderkey").select("media_id", "ordinal", "t", "source", "quantity")

    @cached_property
    def ol_cuts(self) -> Cuts:
        return self.cuts("lineitem", self.ol_events)

    # conversations as speech -------------------------------------------------------------------

    @cached_property
    def cv(self) -> DataFrame:
        words = word_count("text")
        base = self.table("conversations").select(
            F.col("conv_id").alias("media_id"), F.col("turn").alias("ordinal"), F.col("role").alias("speaker"), "text",
            words.alias("words"), (words * 4).alias("_d"), ((7 * F.col("turn") % 5) * 6).alias("_g"),
            (F.col("turn") % 10 / 10.0).alias("no_speech_prob"), (1.0 - F.col("turn") % 10 / 10.0).alias("confidence"))
        # Times are whole tenths of a second, summed as integers.
        track = Track(base, ("media_id",), ("ordinal", "ordinal"), self.cv_cuts).running(
            _until=(F.col("_d") + F.col("_g")).cast("bigint"))
        return track.df.withColumns({
            "duration": F.col("_d") / 10.0, "gap": F.col("_g") / 10.0, "end": F.col("_until") / 10.0,
            "start": (F.col("_until") - F.col("_d")) / 10.0}).drop("_until", "_d", "_g")

    @cached_property
    def cv_cuts(self) -> Cuts:
        turns = self.table("conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("ordinal"))
        return self.cuts("conversations", turns, by=("ordinal", "ordinal"))

    @cached_property
    def cv_time_cuts(self) -> Cuts:
        return self.cuts("conversations", self.cv, by=("start", "ordinal"))

    # documents -----------------------------------------------------------------------------------

    @cached_property
    def dc(self) -> DataFrame:
        return self.table("documents")

    # embeddings as frames ------------------------------------------------------------------------

    @cached_property
    def em(self) -> DataFrame:
        scene = F.col("vec_id") % 50
        return self.table("embeddings").select(
            F.floor(F.col("vec_id") / 50).cast("bigint").alias("media_id"), (scene + 1).alias("scene_id"),
            (scene * 2.0).alias("start"), (scene * 2.0 + 2.0).alias("end"), (scene * 2.0 + 1.0).alias("t"),
            scene.alias("ordinal"), "embedding", "label")

    @cached_property
    def em_cuts(self) -> Cuts:
        return self.cuts("embeddings", self.em)

    @cached_property
    def em_scenes(self) -> DataFrame:
        return self.em.select(
            "media_id", "scene_id", "start", "end", (F.col("scene_id") % 10 / 10.0).alias("confidence"),
            F.lit("normal").alias("semantic_type"), F.lit(0).alias("merge_count"), F.lit(0).alias("split_count"))

    # orders as batch items -----------------------------------------------------------------------

    @cached_property
    def items(self) -> DataFrame:
        status = (F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "failed")
                  .otherwise("completed"))
        return self.table("orders").select(
            F.col("o_custkey").alias("batch_id"), F.col("o_orderkey").alias("item"), status.alias("status"),
            F.datediff("o_orderdate", F.lit("1992-01-01").cast("date")).cast("bigint").alias("seq"),
            F.concat(F.lit("video_"), F.col("o_orderkey").cast("string")).alias("filename"),
            F.when(status == "failed", F.col("o_orderpriority")).alias("error"),
            F.col("o_totalprice").alias("processing_time"))

    @cached_property
    def item_cuts(self) -> Cuts:
        return self.cuts("orders", self.items, "batch_id", ("seq", "item"))


SQL = {
    "ev": """ev AS (
  SELECT user_id AS media_id, event_id AS ordinal,
         CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) / CAST(3600000000 AS DOUBLE) AS t,
         CASE WHEN event_type = 'view' THEN 'background' ELSE event_type END AS label,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
         CAST(json_extract_string(props, '$.k') AS INTEGER) / CAST(100 AS DOUBLE) AS confidence, value
  FROM events)""",
    "feat": """feat AS (
  SELECT *, k / CAST(200 AS DOUBLE) AS energy, (ordinal % 21) / CAST(100 AS DOUBLE) AS zcr,
         value * CAST(10 AS DOUBLE) AS centroid, value * CAST(12 AS DOUBLE) AS rolloff, value AS f0,
         k + CAST(60 AS DOUBLE) AS tempo, k / CAST(100 AS DOUBLE) AS harmonic_ratio FROM ev)""",
    "ev_media": """ev_media AS (SELECT media_id, max(t) + CAST(1 AS DOUBLE) AS duration FROM ev GROUP BY media_id)""",
    "ol_spans": """ol_spans AS (
  SELECT o_custkey AS media_id, o_orderkey AS ordinal,
         CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS "start",
         CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) + 30 AS "end",
         (o_orderkey % 100) / CAST(100 AS DOUBLE) AS confidence, o_orderpriority AS description FROM orders)""",
    "ol_events": """ol_events AS (
  SELECT o_custkey AS media_id,
         ((l_orderkey * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS ordinal,
         CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS t,
         l_returnflag AS source, l_quantity AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "cv": """cv0 AS (
  SELECT conv_id AS media_id, turn AS ordinal, role AS speaker, text,
         CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0
              ELSE len(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) END AS words,
         (7 * turn % 5) AS g, (turn % 10) / CAST(10 AS DOUBLE) AS no_speech_prob,
         CAST(1 AS DOUBLE) - (turn % 10) / CAST(10 AS DOUBLE) AS confidence FROM conversations),
cv1 AS (
  SELECT *, words * 4 AS d10, g * 6 AS g10,
         CAST(sum(words * 4 + g * 6) OVER (PARTITION BY media_id ORDER BY ordinal) AS BIGINT) AS until FROM cv0),
cv AS (
  SELECT media_id, ordinal, speaker, text, words, d10 / CAST(10 AS DOUBLE) AS duration, g10 / CAST(10 AS DOUBLE) AS gap,
         no_speech_prob, confidence, until / CAST(10 AS DOUBLE) AS "end", (until - d10) / CAST(10 AS DOUBLE) AS "start" FROM cv1)""",
    "em": """em AS (
  SELECT CAST(floor(vec_id / 50) AS BIGINT) AS media_id, (vec_id % 50) + 1 AS scene_id,
         (vec_id % 50) * CAST(2 AS DOUBLE) AS "start", (vec_id % 50) * CAST(2 AS DOUBLE) + 2 AS "end",
         (vec_id % 50) * CAST(2 AS DOUBLE) + 1 AS t, vec_id % 50 AS ordinal, embedding, label FROM embeddings)""",
    "items": """items AS (
  SELECT o_custkey AS batch_id, o_orderkey AS item,
         CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'failed' ELSE 'completed' END AS status,
         CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS seq,
         'video_' || o_orderkey AS filename,
         CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS error, o_totalprice AS processing_time FROM orders)""",
}


def with_sql(*names: str) -> str:
    """WITH clause of the named row sets; a query body follows, or ", more AS (...)"."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
