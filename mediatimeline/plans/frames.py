"""Windows over media time and signal features."""

from pyspark.sql import functions as F

from mediatimeline.functions import framing
from mediatimeline.operators.ordered import attach
from mediatimeline.plans.bridges import with_sql
from mediatimeline.plans.registry import query

SIZE, STEP = 48.0, 12.0


def signal(c):
    """Events with the duration of their media and a signed sample value."""
    return attach(c.ev, c.ev_media, cuts=c.ev_cuts).withColumn("x", (F.col("k") - 50) / 50.0)


SIGNAL_SQL = """sig AS (SELECT ev.*, duration, (k - 50) / CAST(50 AS DOUBLE) AS x FROM ev JOIN ev_media USING (media_id))"""
WINDOWS_SQL = """win AS (SELECT media_id, duration, unnest(range(CAST(ceil((duration - 48) / 12) AS BIGINT))) AS win FROM ev_media WHERE duration > 48)"""


@query(with_sql("ev", "ev_media") + ", " + SIGNAL_SQL + ", " + WINDOWS_SQL + """
SELECT win.media_id, win, win * CAST(12 AS DOUBLE) AS win_start, count(*) AS samples, round(sqrt(avg(x * x)), 6) AS rms
FROM win JOIN sig ON sig.media_id = win.media_id AND t >= win * 12 AND t < win * 12 + 48 GROUP BY ALL""")
def sliding_windows(c):
    """Root mean square of each sliding window."""
    rows = framing.sliding_windows(signal(c), SIZE, STEP)
    return rows.groupBy("media_id", "win", "win_start").agg(
        F.count(F.lit(1)).alias("samples"), F.round(framing.rms("x"), 6).alias("rms"))


@query(with_sql("ev", "ev_media") + ", " + WINDOWS_SQL + """
SELECT media_id, win, win * CAST(12 AS DOUBLE) AS "start", win * CAST(12 AS DOUBLE) + 48 AS "end" FROM win""")
def window_starts(c):
    return framing.window_starts(c.ev_media, SIZE, STEP).select("media_id", "win", "start", "end")


@query(with_sql("ev", "ev_media") + ", " + SIGNAL_SQL + """
, s AS (SELECT *, CAST(floor(t / 24) AS BIGINT) AS segment FROM sig)
SELECT media_id, segment, count(*) AS samples, round(avg(value), 6) AS mean_value FROM s
WHERE least(duration, (segment + 1) * CAST(24 AS DOUBLE)) - segment * CAST(24 AS DOUBLE) > 2.4 GROUP BY ALL""")
def tumbling_segments(c):
    return framing.tumbling_segments(signal(c), 24.0, 2.4).groupBy("media_id", "segment").agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.avg("value"), 6).alias("mean_value"))


def docs(c):
    return c.dc.select(F.col("doc_id").alias("media_id"), (F.col("n_chars") / 4.0).alias("duration"))


DOCS_SQL = "WITH m AS (SELECT doc_id AS media_id, n_chars / CAST(4 AS DOUBLE) AS duration FROM documents)"


@query(DOCS_SQL + """, s AS (SELECT media_id, duration, unnest(range(CAST(ceil(duration / 120) AS BIGINT))) AS segment FROM m WHERE duration > 0)
SELECT media_id, segment, segment * CAST(120 AS DOUBLE) AS "start", least(duration, (segment + 1) * CAST(120 AS DOUBLE)) AS "end" FROM s""")
def fixed_segments(c):
    return framing.fixed_segments(docs(c), 120.0).select("media_id", "segment", "start", "end")


@query("""WITH s AS (SELECT doc_id, n_chars / CAST(10 AS DOUBLE) AS d, unnest(range(CAST(ceil(n_chars / CAST(10 AS DOUBLE) / 120) AS BIGINT))) AS i FROM documents WHERE n_chars > 0)
SELECT doc_id AS media_id, i + 1 AS scene_id, i * CAST(120 AS DOUBLE) AS "start", least(d, (i + 1) * CAST(120 AS DOUBLE)) AS "end", 'time_based' AS fallback_method FROM s""")
def fallback_scenes(c):
    media = c.table("documents").select(F.col("doc_id").alias("media_id"), (F.col("n_chars") / 10.0).alias("duration"))
    return framing.fallback_scenes(media).select("media_id", "scene_id", "start", "end", "fallback_method")


@query(DOCS_SQL + """, s AS (SELECT media_id, duration, unnest(range(CAST(ceil(floor(duration) / 30) AS BIGINT))) AS segment FROM m WHERE floor(duration) > 0)
SELECT media_id, segment, segment * CAST(30 AS DOUBLE) AS "start", least(duration, (segment + 1) * CAST(30 AS DOUBLE)) AS "end" FROM s""")
def whole_second_segments(c):
    """The thirty-second form: a fraction of a second at the end opens no segment."""
    return framing.fixed_segments(docs(c), 30.0, truncate=True).select("media_id", "segment", "start", "end")


@query("""WITH m AS (SELECT doc_id AS media_id, n_chars AS frames, least(n_chars, 10) AS n FROM documents),
s AS (SELECT *, unnest(range(n)) AS segment FROM m)
SELECT media_id, segment, CAST(floor(segment * frames / n) AS BIGINT) AS start_frame, CAST(floor((segment + 1) * frames / n) AS BIGINT) AS end_frame FROM s""")
def equal_parts(c):
    df = c.dc.select(F.col("doc_id").alias("media_id"), F.col("n_chars").alias("frames"))
    return framing.equal_parts(df, F.least("frames", F.lit(10)), "frames").select(
        "media_id", "segment", "start_frame", "end_frame")


@query("""WITH m AS (SELECT doc_id AS media_id, n_chars AS frames, greatest(3, CAST(floor(n_chars / 4.0 / 30) AS BIGINT)) AS n FROM documents),
s AS (SELECT *, unnest(range(n)) AS segment FROM m)
SELECT media_id, segment, CAST(floor(segment * frames / n) AS BIGINT) AS start_frame, CAST(floor((segment + 1) * frames / n) AS BIGINT) AS end_frame FROM s""")
def structure_parts(c):
    df = docs(c).withColumn("frames", (F.col("duration") * 4).cast("bigint"))
    return framing.equal_parts(df, framing.structure_parts(), "frames").select(
        "media_id", "segment", "start_frame", "end_frame")


@query(with_sql("ev") + """
, s AS (SELECT media_id, CAST(floor(t / 24) AS BIGINT) AS segment, k < 50 AS neg, lag(k < 50) OVER (PARTITION BY media_id, CAST(floor(t / 24) AS BIGINT) ORDER BY t, ordinal) AS before FROM ev)
SELECT media_id, segment, round(count(*) FILTER (before <> neg) / CAST(count(*) AS DOUBLE), 6) AS zcr FROM s GROUP BY ALL""")
def zero_crossing_rate(c):
    rows = c.ev.select("media_id", "t", "ordinal", F.floor(F.col("t") / 24).cast("bigint").alias("segment"), (F.col("k") - 50).alias("x"))
    return framing.zero_crossings(rows, ("media_id", "segment"), cuts=c.ev_cuts).select(
        "media_id", "segment", F.round("zcr", 6).alias("zcr"))


@query("""WITH s AS (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT vec_id, i * CAST(100 AS DOUBLE) AS f, CAST(abs(e) AS DOUBLE) AS m FROM s),
a AS (SELECT vec_id, sum(m) AS s0, sum(m * f) AS s1, sum(m * f * f) AS s2 FROM m GROUP BY vec_id)
SELECT vec_id, round(s1 / s0, 4) AS centroid, round(sqrt(s2 / s0 - (s1 / s0) * (s1 / s0)), 4) AS bandwidth FROM a""")
def spectrum_features(c):
    """Vectors as magnitudes of 100 Hz bands."""
    bands = c.table("embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e")).select(
        "vec_id", ((F.col("i") + 1) * 100.0).alias("f"), F.abs(F.col("e").cast("double")).alias("m"))
    out = framing.spectrum_features(bands, ("vec_id",))
    return out.select("vec_id", F.round("centroid", 4).alias("centroid"), F.round("bandwidth", 4).alias("bandwidth"))


WAVE_SQL = "WITH x AS (SELECT vec_id, len(embedding) AS n, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"


@query(WAVE_SQL + """, m AS (SELECT vec_id, n, k, sqrt(pow(sum(x * cos(2 * pi() * k * i / n)), 2) + pow(sum(x * sin(2 * pi() * k * i / n)), 2)) AS m FROM x, range(32) r(k) GROUP BY vec_id, n, k),
a AS (SELECT vec_id, sum(m) AS s0, sum(m * k * 16000.0 / n) / sum(m) AS c FROM m GROUP BY vec_id),
b AS (SELECT vec_id, n, k, m, k * 16000.0::DOUBLE / n AS f, s0, c, sum(m) OVER (PARTITION BY vec_id ORDER BY k) AS upto FROM m JOIN a USING (vec_id))
SELECT vec_id, round(any_value(c), 3) AS centroid, round(sqrt(sum(m * pow(f - c, 2)) / any_value(s0)), 3) AS bandwidth, round(least(count(*) FILTER (upto < 0.85 * s0), 31) * 16000.0::DOUBLE / any_value(n), 3) AS rolloff FROM b GROUP BY vec_id""")
def spectral_features(c):
    """Fourier features of each vector read as a short window of samples."""
    found = framing.short_spectral_features(c.table("embeddings"), "embedding", 16000.0)
    return found.select("vec_id", *[F.round(f"s.{n}", 3).alias(n) for n in ("centroid", "bandwidth", "rolloff")])


@query(WAVE_SQL + """, p AS (SELECT a.vec_id, b.i - a.i AS lag, sum(a.x * b.x) AS c FROM x a JOIN x b ON a.vec_id = b.vec_id AND b.i - a.i BETWEEN 7 AND 59 GROUP BY ALL)
SELECT vec_id, 3000.0::DOUBLE / arg_max(lag, c) AS f0 FROM p GROUP BY vec_id""")
def f0_autocorr(c):
    return framing.short_f0(c.table("embeddings"), "embedding", 3000.0).select("vec_id", "f0")


@query(with_sql("em") + """
, g AS (SELECT media_id, CAST(floor((scene_id - 1) / 5) AS BIGINT) AS win, scene_id, unnest(embedding) AS v, (generate_subscripts(embedding, 1) - 1) % 12 AS i FROM em),
f AS (SELECT media_id, win, scene_id, i, sum(CAST(v AS DOUBLE)) AS v FROM g GROUP BY ALL),
a AS (SELECT media_id, win, i, avg(v) AS m FROM f GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY media_id, win ORDER BY m DESC, i) AS rn FROM a)
SELECT media_id, win, CAST(i AS INTEGER) AS pitch_class, ['C', 'C#', 'D', 'D#', 'E', 'F', 'F#', 'G', 'G#', 'A', 'A#', 'B'][i + 1] AS key_name FROM b WHERE rn = 1""")
def dominant_pitch(c):
    """The numbers of a vector are folded into twelve classes."""
    classes = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda j: F.aggregate(
        F.filter("embedding", lambda v, i: i % 12 == j), F.lit(0.0), lambda a, v: a + v.cast("double")))
    frames = c.em.select("media_id", F.floor((F.col("scene_id") - 1) / 5).cast("bigint").alias("win"), classes.alias("chroma"))
    return framing.dominant_pitch(frames, ("media_id", "win"))


def savgol_sql() -> str:
    weights = framing.savgol_weights()
    table = ", ".join(f"({p}, {j}, CAST({w!r} AS DOUBLE))" for p, row in enumerate(weights.tolist()) for j, w in enumerate(row))
    return with_sql("ev") + f""", n AS (SELECT media_id, ordinal, value, row_number() OVER (PARTITION BY media_id ORDER BY t, ordinal) AS n,
  count(*) OVER (PARTITION BY media_id) AS size FROM ev),
s AS (SELECT *, greatest(1, least(n - 25, size - 50)) AS first FROM n),
wt(p, j, w) AS (VALUES {table})
SELECT s.media_id, s.ordinal, round(CASE WHEN any_value(s.size) <= 51 THEN any_value(s.value) ELSE sum(o.value * w) END, 4) AS smoothed
FROM s JOIN n o ON o.media_id = s.media_id AND o.n BETWEEN s.first AND s.first + 50
JOIN wt ON wt.p = s.n - s.first AND wt.j = o.n - s.first WHERE s.size > 51 GROUP BY s.media_id, s.ordinal
UNION ALL SELECT media_id, ordinal, round(value, 4) FROM n WHERE size <= 51"""


@query(savgol_sql())
def smooth_savgol(c):
    out = framing.smooth_savgol(c.ev, "value", cuts=c.ev_cuts)
    return out.select("media_id", "ordinal", F.round("smoothed", 4).alias("smoothed"))


@query(with_sql("ev") + "SELECT media_id, ordinal FROM ev WHERE ordinal % 30 = 0")
def every_nth(c):
    return framing.every_nth(c.ev, "ordinal", 30).select("media_id", "ordinal")


@query("SELECT o_orderkey, CAST(floor(o_totalprice / 1000 * CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 3) * CAST(12 AS DOUBLE) ELSE 30 END) AS BIGINT) AS frame FROM orders")
def frame_number(c):
    fps = (F.col("o_orderkey") % 3) * 12.0
    return c.table("orders").select("o_orderkey", framing.frame_number(F.col("o_totalprice") / 1000, fps).alias("frame"))
