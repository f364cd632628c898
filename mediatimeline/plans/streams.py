"""The streaming operators run over the events table as a stream, and the model hooks."""

import uuid

import pandas as pd
from pyspark.sql import functions as F

from mediatimeline.functions import detectors
from mediatimeline.plans.bridges import with_sql
from mediatimeline.plans.registry import query
from mediatimeline.session import ensure_checkpoint_dir
from mediatimeline.streaming import ops

LATE = "2 hours"


def _stream(c):
    """The events table as a stream of files."""
    schema = c.table("events").schema
    raw = c.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(c.folder)
    return raw.select(
        F.col("user_id").alias("media_id"), F.col("event_id").alias("ordinal"), F.col("ts").cast("timestamp").alias("ts"),
        "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))


def _folder(c) -> str:
    ensure_checkpoint_dir(c.spark)
    return f"{c.spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


LIMIT = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 HOUR FROM events)"


@query("SELECT user_id AS media_id, max_by(event_type, event_id) AS stage, max(event_id) AS seq FROM events GROUP BY user_id")
def stream_latest_stage(c):
    out = ops.run_to_folder(ops.latest_stage(_stream(c), ("media_id",), "ordinal", "event_type"), _folder(c), "update")
    # Update mode gives a row per change; the last one is the current state.
    return out.groupBy("media_id").agg(F.max_by("stage", "seq").alias("stage"), F.max("seq").alias("seq"))


@query(f"""WITH g AS (SELECT user_id AS media_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY ts, event_id) AS n FROM g)
SELECT media_id, CAST(min(ts) AS VARCHAR) AS "start", CAST(max(ts) AS VARCHAR) AS "end", count(*) AS events FROM s GROUP BY media_id, n HAVING max(ts) > min(ts) AND max(ts) + INTERVAL 12 HOUR <= {LIMIT}""")
def stream_sessions(c):
    out = ops.run_to_folder(ops.sessions(_stream(c), "ts", "12 hours", LATE), _folder(c))
    return out.withColumns({"start": F.col("start").cast("string"), "end": F.col("end").cast("string")})


@query(f"""WITH w AS (SELECT *, unnest([0, 1, 2, 3]) AS j FROM events), s AS (SELECT user_id AS media_id, time_bucket(INTERVAL 12 HOUR, ts) - j * INTERVAL 12 HOUR AS st, value FROM w)
SELECT media_id, CAST(st AS VARCHAR) AS "start", CAST(st + INTERVAL 48 HOUR AS VARCHAR) AS "end", count(*) AS samples, round(sqrt(avg(value * value)), 4) AS rms FROM s GROUP BY ALL HAVING st + INTERVAL 48 HOUR <= {LIMIT}""")
def stream_windows(c):
    aggs = {"samples": F.count(F.lit(1)), "rms": F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 4)}
    out = ops.run_to_folder(ops.windows(_stream(c), "ts", "48 hours", "12 hours", LATE, aggs), _folder(c))
    return out.withColumns({"start": F.col("start").cast("string"), "end": F.col("end").cast("string")})


@query(f"""SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS "start", count(*) AS "rows", count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') * 100.0 / count(*), 6) AS error_rate
FROM events GROUP BY date_trunc('day', ts) HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= {LIMIT}""")
def stream_error_rate(c):
    out = ops.run_to_folder(ops.error_rate(_stream(c), "ts", F.col("event_type") == "error", "1 day", LATE), _folder(c))
    return out.select(F.col("start").cast("string").alias("start"), "rows", "errors", F.round("error_rate", 6).alias("error_rate"))


@query(with_sql("ev") + f""", e AS (SELECT ev.*, ts FROM ev JOIN events ON event_id = ordinal), x AS (SELECT *, lag(label) OVER (PARTITION BY media_id ORDER BY t, ordinal) AS prev_label FROM e WHERE confidence > 0.6)
SELECT media_id, ordinal, label, prev_label FROM x WHERE label IS DISTINCT FROM prev_label AND ts < (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 HOUR FROM e WHERE confidence > 0.6)""")
def stream_label_changes(c):
    label = F.when(F.col("event_type") == "view", "background").otherwise(F.col("event_type"))
    rows = _stream(c).withColumn("label", label).filter(F.col("k") > 60)
    return ops.run_to_folder(ops.label_changes(rows, "ts", LATE), _folder(c))


@query(with_sql("ev") + f""", a AS (SELECT media_id, ordinal, t, label = 'error' AS failed, sum(CASE WHEN label = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY t, ordinal) AS run FROM ev),
b AS (SELECT *, CAST(sum(failed::INT) OVER (PARTITION BY media_id, run ORDER BY t, ordinal) AS BIGINT) AS streak FROM a),
d AS (SELECT media_id, ordinal, streak, coalesce(max((streak >= 3)::INT) OVER (PARTITION BY media_id ORDER BY t, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS stopped FROM b)
SELECT d.* FROM d JOIN events ON event_id = ordinal WHERE ts < {LIMIT}""")
def stream_breaker(c):
    out = ops.breaker(_stream(c), "ts", LATE, F.col("event_type") == "error", key="media_id")
    return ops.run_to_folder(out, _folder(c))


def _load():
    return {"loud": 0.3, "medium": 0.15}


def _predict(model, batch: pd.DataFrame) -> pd.DataFrame:
    level = pd.Series("quiet", index=batch.index).mask(batch["energy"] > model["medium"], "medium").mask(batch["energy"] > model["loud"], "loud")
    return pd.DataFrame({"label": level, "confidence": batch["energy"] * 2, "probabilities": [{x: 1.0} for x in level]})


@query(with_sql("ev", "feat") + """SELECT media_id, ordinal, CASE WHEN energy > 0.3 THEN 'loud' WHEN energy > 0.15 THEN 'medium' ELSE 'quiet' END AS label, round(energy * 2, 6) AS confidence FROM feat""")
def apply_model(c):
    """A caller's model over Arrow batches; here a threshold on the energy."""
    out = detectors.apply_model(c.feat, _load, _predict, ["energy"], ("media_id", "ordinal"))
    return out.select("media_id", "ordinal", "label", F.round("confidence", 6).alias("confidence"))


def _fragile(model, batch: pd.DataFrame) -> pd.DataFrame:
    """The same model, which cannot read some rows and meets others that are out of its range."""
    if (batch["energy"] > 0.49).any():
        raise OverflowError("energy above 0.49")
    if (batch["k"] % 17 == 3).any():
        raise ValueError("cannot read the window")
    return _predict(model, batch)


def _tried(c):
    return detectors.try_model(c.feat, _load, _fragile, ["energy", "k"], ("media_id", "ordinal"), "energy")


@query(with_sql("ev", "feat") + """SELECT media_id, ordinal, 'energy' AS tool_name, 'predict' AS error_stage, CASE WHEN energy > 0.49 THEN 'OverflowError' ELSE 'ValueError' END AS error_type,
  CASE WHEN energy > 0.49 THEN 'energy above 0.49' ELSE 'cannot read the window' END AS error_message FROM feat WHERE energy > 0.49 OR k % 17 = 3""")
def model_errors(c):
    """Rows on which a model raises, as error rows."""
    return _tried(c)[1]


@query(with_sql("ev", "feat") + """SELECT media_id, ordinal, CASE WHEN energy > 0.3 THEN 'loud' WHEN energy > 0.15 THEN 'medium' ELSE 'quiet' END AS label, round(energy * 2, 6) AS confidence
FROM feat WHERE NOT coalesce(energy > 0.49 OR k % 17 = 3, false)""")
def labels_beside_errors(c):
    """The rows around them, all labelled."""
    return _tried(c)[0].select("media_id", "ordinal", "label", F.round("confidence", 6).alias("confidence"))


class _Over:
    """A detector that marks rows whose column is over a limit."""

    def __init__(self, source: str, column: str, limit: float):
        self.source, self.column, self.limit = source, column, limit

    def detect(self, media):
        return media.where(F.col(self.column) > self.limit).select("media_id", "ordinal", "t", F.lit(self.source).alias("source"))


@query(with_sql("ev", "feat") + """SELECT media_id, ordinal, round(t, 6) AS t, 'loud' AS source FROM feat WHERE energy > 0.4 UNION ALL SELECT media_id, ordinal, round(t, 6), 'bright' FROM feat WHERE centroid > 500""")
def run_detectors(c):
    """Two detectors over the same rows, their events together."""
    found = detectors.run_detectors(c.feat, [_Over("loud", "energy", 0.4), _Over("bright", "centroid", 500.0)])
    return found["loud"].unionByName(found["bright"]).withColumn("t", F.round("t", 6))


@query("""SELECT doc_id AS media_id, CAST(0 AS DOUBLE) AS t, 'Analysis unavailable' AS description, 'internvl3' AS source, CAST(0.1 AS DOUBLE) AS confidence, greatest(CAST(30 AS DOUBLE), n_chars * 1000 / CAST(88000 AS DOUBLE)) AS duration
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def fallback_rows(c):
    """Documents without a label play media whose detector failed."""
    media = c.dc.select(F.col("doc_id").alias("media_id"), (F.col("n_chars") * 1000).alias("size_bytes"))
    return detectors.fallback_rows(media, c.table("labels").select(F.col("doc_id").alias("media_id")), "internvl3")


@query("""WITH m AS (SELECT doc_id, n_chars / CAST(4 AS DOUBLE) AS d FROM documents), s AS (SELECT *, unnest(range(CAST(ceil(d / 300) AS BIGINT))) AS segment FROM m WHERE d > 0)
SELECT doc_id AS media_id, segment, segment * CAST(300 AS DOUBLE) AS "start", least(d, (segment + 1) * CAST(300 AS DOUBLE)) AS "end" FROM s""")
def segments_of(c):
    """The table function called from SQL."""
    detectors.register(c.spark)
    c.dc.createOrReplaceTempView("_documents")
    return c.spark.sql("SELECT doc_id AS media_id, s.* FROM _documents, LATERAL segments_of(n_chars / 4.0D, 300.0D) s")
