"""Change detection, run-length spans and failure streaks."""

from pyspark.sql import functions as F

from mediatimeline.functions import rules
from mediatimeline.operators import change
from mediatimeline.operators.ordered import attach
from mediatimeline.plans.bridges import with_sql
from mediatimeline.plans.registry import query
from mediatimeline.plans.rows import MUSIC_CONF, MUSIC_SQL

W = "OVER (PARTITION BY media_id ORDER BY t, ordinal)"


@query(with_sql("ev") + f""", x AS (SELECT *, lag(value) {W} AS prev_value FROM ev), y AS (SELECT *, abs(value - prev_value) AS delta FROM x)
SELECT media_id, ordinal, round(delta, 6) AS delta, round(least(0.95, 0.6 + delta / 20), 6) AS change_confidence FROM y WHERE delta > 10""")
def numeric_change(c):
    out = change.numeric_change(c.ev, cuts=c.ev_cuts)
    return out.select("media_id", "ordinal", F.round("delta", 6).alias("delta"), F.round("change_confidence", 6).alias("change_confidence"))


@query(with_sql("ev") + f""", x AS (SELECT *, lag(label) {W} AS prev_label, lag(k) {W} AS pk FROM ev)
SELECT media_id, ordinal, prev_label, label, k - pk AS index_change, CAST(0.65 AS DOUBLE) AS change_confidence FROM x WHERE label <> prev_label""")
def label_change(c):
    return change.label_change(c.ev, index="k", cuts=c.ev_cuts).select(
        "media_id", "ordinal", "prev_label", "label", "index_change", "change_confidence")


@query(with_sql("ev") + f""", x AS (SELECT *, lag(value) {W} AS p, stddev_pop(value) OVER (PARTITION BY media_id) AS s FROM ev)
SELECT media_id, ordinal, CASE WHEN value > p THEN 'energy_increase' ELSE 'energy_decrease' END AS kind, round(abs(value - p), 6) AS delta
FROM x WHERE abs(value - p) > s * 0.5""")
def adaptive_change(c):
    return change.adaptive_change(c.ev, cuts=c.ev_cuts).select("media_id", "ordinal", "kind", F.round("delta", 6).alias("delta"))


@query(with_sql("ev") + f""", x AS (SELECT *, lag(label) {W} AS prev_label FROM ev WHERE confidence > 0.6)
SELECT media_id, ordinal, prev_label, label, confidence FROM x WHERE label IS DISTINCT FROM prev_label""")
def gated_label_change(c):
    return change.gated_label_change(c.ev, cuts=c.ev_cuts).select("media_id", "ordinal", "prev_label", "label", "confidence")


@query(with_sql("ev") + f""", x AS (SELECT *, lag(label) {W} AS prev_label, row_number() {W} - 1 AS window_index,
  count(*) OVER (PARTITION BY media_id) AS total_detections FROM ev WHERE label <> 'background')
SELECT media_id, ordinal, label, window_index, total_detections FROM x WHERE label IS DISTINCT FROM prev_label""")
def label_change_after_filter(c):
    out = change.label_change_after_filter(c.ev, F.col("label") != "background", cuts=c.ev_cuts)
    return out.select("media_id", "ordinal", "label", "window_index", "total_detections")


@query(with_sql("ev", "feat") + ", x AS (" + " UNION ALL ".join(
    f"SELECT media_id, t, ordinal, '{f}' AS facet, {MUSIC_SQL[f]} AS label FROM feat" for f in ("genre", "mood", "style")) + """),
y AS (SELECT *, CAST(CASE facet """ + " ".join(f"WHEN '{f}' THEN {MUSIC_CONF[f].format(l='label')}" for f in ("genre", "mood", "style")) + """ END AS DOUBLE) AS confidence FROM x),
z AS (SELECT *, lag(label) OVER (PARTITION BY media_id, facet ORDER BY t, ordinal) AS p FROM y WHERE confidence > 0.4)
SELECT media_id, ordinal, facet, coalesce(p, '[start]') || ' → ' || label AS transition, confidence FROM z WHERE label IS DISTINCT FROM p""")
def multi_facet_change(c):
    df = c.feat.withColumns({f: rules.classify_music(f) for f in ("genre", "mood", "style")})
    out = change.multi_facet_change(df, {f: (f"{f}.label", f"{f}.confidence") for f in ("genre", "mood", "style")}, cuts=c.ev_cuts)
    return out.select("media_id", "ordinal", "facet", "transition", "confidence")


RUN_SQL = """, f AS (SELECT f.*, m.duration, CASE WHEN energy > 0.3 THEN 'high' WHEN energy > 0.1005 THEN 'medium' ELSE 'low' END AS energy_category
  FROM feat f JOIN ev_media m USING (media_id)),
b AS (SELECT *, lag(label) OVER w AS p, row_number() OVER w AS n FROM f WINDOW w AS (PARTITION BY media_id ORDER BY t, ordinal)),
i AS (SELECT *, sum(CASE WHEN n = 1 OR label <> p OR confidence < 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t, ordinal) AS span_no,
  sum(confidence) OVER lw / count(*) OVER lw AS running FROM b WINDOW lw AS (PARTITION BY media_id, label ORDER BY t, ordinal ROWS UNBOUNDED PRECEDING)),
g AS (SELECT media_id, span_no, min_by(label, n) AS label, min(t) AS "start", max_by(running, n) AS mean_c, max_by(confidence, n) AS last_c, max(duration) AS duration,
  count(*) AS n_rows, avg(energy) AS energy, avg(centroid) AS centroid FROM i GROUP BY ALL),
c AS (SELECT media_id, span_no, energy_category, row_number() OVER (PARTITION BY media_id, span_no ORDER BY count(*) DESC, min(n)) AS rk FROM i GROUP BY media_id, span_no, energy_category),
h AS (SELECT *, lead("start") OVER (PARTITION BY media_id ORDER BY span_no) AS nxt FROM g)
SELECT media_id, CAST(span_no AS BIGINT) AS span_no, label, round("start", 6) AS "start", round(coalesce(nxt, duration), 6) AS "end",
  round(CASE WHEN nxt IS NULL THEN last_c ELSE mean_c END, 6) AS confidence, n_rows AS "rows", round(energy, 6) AS energy, round(centroid, 4) AS centroid, energy_category
FROM h JOIN c USING (media_id, span_no) WHERE rk = 1"""


@query(with_sql("ev", "feat", "ev_media") + RUN_SQL)
def run_spans(c):
    """Spans with averaged features and the commonest category (gate .1: most rows pass it)."""
    df = attach(c.feat, c.ev_media, cuts=c.ev_cuts).withColumn("energy_category", rules.energy_category())
    out = change.run_spans(df, min_confidence=0.1, cuts=c.ev_cuts, category="energy_category",
                           features={"energy": "energy", "centroid": "centroid"})
    return out.select("media_id", "span_no", "label", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"),
                      F.round("confidence", 6).alias("confidence"), "rows", F.round("energy", 6).alias("energy"),
                      F.round("centroid", 4).alias("centroid"), "energy_category")


COS = ("list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * "
       "sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))")


@query(with_sql("em") + f""", x AS (SELECT *, lag(embedding) {W} AS p FROM em), y AS (SELECT *, 1 - {COS.format(a='p', b='embedding')} AS distance FROM x WHERE p IS NOT NULL)
SELECT media_id, ordinal, round(distance, 6) AS distance, round(least(0.9, 0.5 + distance), 6) AS change_confidence FROM y WHERE distance > 1.1""")
def vector_change(c):
    out = change.vector_change(c.em, above=1.1, cuts=c.em_cuts)
    return out.select("media_id", "ordinal", F.round("distance", 6).alias("distance"), F.round("change_confidence", 6).alias("change_confidence"))


@query(with_sql("ev") + """, pk AS (SELECT media_id, t, ordinal FROM ev WHERE k % 3 <> 0), st AS (SELECT media_id, t, ordinal, value AS strength FROM ev WHERE k % 3 = 0),
pc AS (SELECT media_id, count(*) AS n FROM pk GROUP BY 1), fl AS (SELECT media_id, quantile_cont(strength, 0.5) AS f FROM st GROUP BY 1),
nr AS (SELECT pk.media_id, pk.t, pk.ordinal, min_by(strength, (abs(pk.t - st.t), st.t, st.ordinal)) AS s FROM pk JOIN st USING (media_id) GROUP BY ALL),
kp AS (SELECT pk.*, n FROM pk JOIN pc USING (media_id) LEFT JOIN fl USING (media_id) LEFT JOIN nr USING (media_id, t, ordinal) WHERE n <= 20 OR s > f),
rk AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY t, ordinal) - 1 AS onset_index, count(*) OVER (PARTITION BY media_id) AS kept FROM kp)
SELECT media_id, ordinal, onset_index, CASE WHEN n > 20 THEN least(kept, 15) ELSE kept END AS total_onsets FROM rk WHERE onset_index < 15""")
def strong_peaks(c):
    """Two thirds of the events play peaks, the rest strength samples."""
    peaks = c.ev.filter(F.col("k") % 3 != 0).select("media_id", "t", "ordinal")
    strength = c.ev.filter(F.col("k") % 3 == 0).select("media_id", "t", "ordinal", F.col("value").alias("strength"))
    by_strength = c.cuts("events", strength, by=("strength", "ordinal"))
    out = change.strong_peaks(peaks, strength, many=20, cuts=c.ev_cuts, strength_cuts=by_strength)
    return out.select("media_id", "ordinal", "onset_index", "total_onsets")


@query(with_sql("ev") + """SELECT media_id, ordinal, round(max(t) OVER (PARTITION BY media_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE TIES), 6) AS prev_t FROM ev WHERE false
UNION ALL SELECT a.media_id, a.ordinal, round(max(b.t), 6) FROM ev a LEFT JOIN ev b ON a.media_id = b.media_id AND b.t < a.t GROUP BY a.media_id, a.ordinal""")
def previous_time(c):
    return change.previous_time(c.ev, cuts=c.ev_cuts).select("media_id", "ordinal", F.round("prev_t", 6).alias("prev_t"))


@query(with_sql("cv") + """, x AS (SELECT *, lag("end") OVER (PARTITION BY media_id ORDER BY "start", ordinal) AS p FROM cv)
SELECT media_id, ordinal, CASE WHEN sum(CASE WHEN "start" - p > 2.0 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY "start", ordinal) % 2 = 0
  THEN 'Speaker_1' ELSE 'Speaker_2' END AS speaker FROM x""")
def pause_speakers(c):
    return change.pause_speakers(c.cv.drop("speaker"), cuts=c.cv_time_cuts).select("media_id", "ordinal", "speaker")


BREAKER_SQL = """, a AS (SELECT media_id, ordinal, t, label = 'error' AS failed, sum(CASE WHEN label = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY t, ordinal) AS run FROM ev),
b AS (SELECT *, CAST(sum(failed::INT) OVER (PARTITION BY media_id, run ORDER BY t, ordinal) AS BIGINT) AS streak FROM a)"""


@query(with_sql("ev") + BREAKER_SQL + """
SELECT media_id, ordinal, streak, streak >= 3 AS tripped, coalesce(max((streak >= 3)::INT) OVER (PARTITION BY media_id ORDER BY t, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS stopped FROM b""")
def circuit_breaker(c):
    out = change.circuit_breaker(c.ev, F.col("label") == "error", keys=("media_id",), by=("t", "ordinal"), cuts=c.ev_cuts)
    return out.select("media_id", "ordinal", "streak", "tripped", "stopped")
