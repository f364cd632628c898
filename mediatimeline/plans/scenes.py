"""Speech merging, scene merging and splitting, structural sections."""

from pyspark.sql import functions as F

from mediatimeline.operators import segments
from mediatimeline.plans.bridges import with_sql
from mediatimeline.plans.change import COS
from mediatimeline.plans.registry import query

NORM = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def words_of(x):
    return f"CASE WHEN {NORM.format(x=x)} = '' THEN 0 ELSE len(string_split({NORM.format(x=x)}, ' ')) END"


MERGE = (f"(f.e - f.s < 2.5 OR src.s - f.e < 0.8 OR (trim(f.text) <> '' AND NOT regexp_matches(trim(f.text), '[.!?:]$') "
         f"AND NOT regexp_matches(trim(src.text), '^(And|But|So|Now|Then|However)')) OR {words_of('f.text')} < 4 OR {words_of('src.text')} < 3)")


def fold_sql():
    base = with_sql("cv").replace("WITH cv0", "WITH RECURSIVE cv0", 1)
    return base + f""", src AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY "start", ordinal) AS i, "start" AS s, "end" AS e, text, confidence FROM cv),
f(media_id, i, g, s, e, text, confidence, parts) AS (
  SELECT media_id, i, i, s, e, text, confidence, CAST(1 AS BIGINT) FROM src WHERE i = 1
  UNION ALL
  SELECT src.media_id, src.i, CASE WHEN {MERGE} THEN f.g ELSE src.i END, CASE WHEN {MERGE} THEN f.s ELSE src.s END, src.e,
    CASE WHEN {MERGE} THEN trim(f.text) || CASE WHEN src.s - f.e < 0.3 THEN ' ' ELSE '... ' END || trim(src.text) ELSE src.text END,
    CASE WHEN {MERGE} THEN CASE WHEN (f.e - f.s) + (src.e - src.s) > 0 THEN (f.confidence * (f.e - f.s) + src.confidence * (src.e - src.s)) / ((f.e - f.s) + (src.e - src.s)) ELSE f.confidence END ELSE src.confidence END,
    CASE WHEN {MERGE} THEN f.parts + 1 ELSE 1 END
  FROM f JOIN src ON src.media_id = f.media_id AND src.i = f.i + 1)
SELECT media_id, round(s, 6) AS "start", round(e, 6) AS "end", round(e - s, 6) AS duration, {NORM.format(x='text')} AS text, round(confidence, 6) AS confidence, parts
FROM (SELECT *, row_number() OVER (PARTITION BY media_id, g ORDER BY i DESC) AS rn FROM f) WHERE rn = 1"""


@query(fold_sql())
def merge_segments(c):
    rows = c.cv.select("media_id", "ordinal", "start", "end", "text", "confidence")
    out = segments.merge_segments(rows, cuts=c.cv_time_cuts)
    return out.select("media_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"),
                      F.round("duration", 6).alias("duration"), "text", F.round("confidence", 6).alias("confidence"), "parts")


ROUND_SQL = with_sql("em") + f"""
, x AS (SELECT *, lead(embedding) OVER w AS nx, row_number() OVER w AS n FROM em WINDOW w AS (PARTITION BY media_id ORDER BY scene_id)),
a AS (SELECT *, coalesce({COS.format(a='embedding', b='nx')} > 0.1, FALSE) AS alike FROM x),
r AS (SELECT *, coalesce(max(CASE WHEN NOT alike THEN n END) OVER (PARTITION BY media_id ORDER BY n), 0) AS stop FROM a),
j AS (SELECT *, alike AND (n - stop) % 2 = 1 AS joins FROM r),
k AS (SELECT *, coalesce(lag(joins) OVER (PARTITION BY media_id ORDER BY n), FALSE) AS taken FROM j)
SELECT media_id, n - taken::INT AS scene_id, min("start") AS "start", max("end") AS "end", min((scene_id % 10) / CAST(10 AS DOUBLE)) AS confidence,
  CASE WHEN bool_or(joins OR taken) THEN 'merged' ELSE 'normal' END AS semantic_type, max((joins OR taken)::INT) AS merge_count, 0 AS split_count, bool_or(joins OR taken) AS merged FROM k GROUP BY media_id, n - taken::INT"""


@query(ROUND_SQL)
def merge_round(c):
    """One pass at .1: neighbouring vectors of the table are far apart."""
    return segments.merge_round(c.em_scenes, c.em.select("media_id", "t", "ordinal", "embedding"), 0.1, cuts=c.em_cuts)


def rounds_sql(rounds: int = 5) -> str:
    """All rounds for all media; a media that has settled stays as it is, and its round is the first one without a join."""
    steps = [with_sql("em") + """, s0 AS (SELECT media_id, scene_id AS id, "start" AS s, "end" AS e, (scene_id % 10) / CAST(10 AS DOUBLE) AS c, 'normal' AS kind, 0 AS mc FROM em)"""]
    for i in range(rounds):
        steps.append(f"""
v{i} AS (SELECT p.media_id, id, s, e, c, kind, mc, min_by(embedding, (abs(em.t - (s + e) / 2), em.t)) AS v FROM s{i} p JOIN em ON em.media_id = p.media_id GROUP BY ALL),
x{i} AS (SELECT *, lead(v) OVER w AS nx, row_number() OVER w AS n FROM v{i} WINDOW w AS (PARTITION BY media_id ORDER BY s, id)),
a{i} AS (SELECT *, coalesce({COS.format(a='v', b='nx')} > 0.1, FALSE) AS alike FROM x{i}),
r{i} AS (SELECT *, coalesce(max(CASE WHEN NOT alike THEN n END) OVER (PARTITION BY media_id ORDER BY n), 0) AS stop FROM a{i}),
j{i} AS (SELECT *, alike AND (n - stop) % 2 = 1 AS joins FROM r{i}),
k{i} AS (SELECT *, coalesce(lag(joins) OVER (PARTITION BY media_id ORDER BY n), FALSE) AS taken FROM j{i}),
m{i} AS (SELECT media_id FROM j{i} GROUP BY media_id HAVING bool_or(joins)),
s{i + 1} AS MATERIALIZED (SELECT media_id, n - taken::INT AS id, min(s) AS s, max(e) AS e, min(c) AS c, CASE WHEN bool_or(joins OR taken) THEN 'merged' ELSE min_by(kind, n) END AS kind,
  CAST(sum(mc) + max((joins OR taken)::INT) AS INTEGER) AS mc FROM k{i} GROUP BY media_id, n - taken::INT)""")
    changed = " UNION ALL ".join(f"SELECT media_id FROM m{i}" for i in range(rounds))
    return ",".join(steps) + f""", ch AS (SELECT media_id, count(*) AS times FROM ({changed}) GROUP BY media_id)
SELECT f.media_id, id AS scene_id, s AS "start", e AS "end", c AS confidence, kind AS semantic_type, mc AS merge_count, 0 AS split_count,
  CAST(least({rounds}, coalesce(times, 0) + 1) AS INTEGER) AS stability_iterations FROM s{rounds} f LEFT JOIN ch USING (media_id)"""


@query(rounds_sql())
def merge_similar(c):
    return segments.merge_similar(c.em_scenes, c.em.select("media_id", "t", "ordinal", "embedding"), 0.1, cuts=c.em_cuts)


def _long_scenes(c):
    """Ten-second scenes over the same vectors."""
    number = F.floor((F.col("scene_id") - 1) / 5).cast("bigint")
    return c.em.groupBy("media_id", (number + 1).alias("scene_id")).agg(F.min("start").alias("start"), F.max("end").alias("end")).withColumns({
        "semantic_type": F.lit("normal"), "split_count": F.lit(0)})


@query(with_sql("em") + f"""
, sc AS (SELECT media_id, CAST(floor((scene_id - 1) / 5) AS BIGINT) + 1 AS scene_id, min("start") AS s, max("end") AS e FROM em GROUP BY ALL),
iv AS (SELECT *, greatest(1.0, (e - s) / 5) AS h FROM sc WHERE e - s >= 4),
sm AS (SELECT media_id, scene_id, s, e, 0 AS k, s + h AS t, h FROM iv UNION ALL SELECT media_id, scene_id, s, e, 1, s + h + h, h FROM iv
  UNION ALL SELECT media_id, scene_id, s, e, 2, s + h + h + h, h FROM iv UNION ALL SELECT media_id, scene_id, s, e, 3, s + h + h + h + h, h FROM iv),
sn AS (SELECT sm.media_id, sm.scene_id, s, e, k, sm.t, min_by(embedding, (abs(em.t - sm.t), em.t)) AS v FROM sm JOIN em ON em.media_id = sm.media_id WHERE sm.t < e - h GROUP BY ALL),
lg AS (SELECT *, lag(v) OVER (PARTITION BY media_id, scene_id ORDER BY k) AS p FROM sn),
sp AS (SELECT media_id, scene_id, t FROM lg WHERE p IS NOT NULL AND {COS.format(a='p', b='v')} < 0.1 AND t - s >= 2 AND e - t >= 2),
st AS (SELECT media_id, scene_id, s AS b FROM sc UNION ALL SELECT media_id, scene_id, t FROM sp),
ed AS (SELECT st.media_id, st.scene_id, row_number() OVER w - 1 AS piece, b AS "start", coalesce(lead(b) OVER w, e) AS "end", count(*) OVER (PARTITION BY st.media_id, st.scene_id) > 1 AS cut
  FROM st JOIN sc USING (media_id, scene_id) WINDOW w AS (PARTITION BY st.media_id, st.scene_id ORDER BY b))
SELECT media_id, scene_id, CAST(piece AS INTEGER) AS piece, "start", "end", CASE WHEN cut AND "end" - "start" < 1 THEN 'rapid_cut' WHEN cut THEN 'split' ELSE 'normal' END AS semantic_type, cut::INT AS split_count FROM ed""")
def split_dissimilar(c):
    out = segments.split_dissimilar(_long_scenes(c), c.em.select("media_id", "t", "ordinal", "embedding"), 0.1, cuts=c.em_cuts)
    return out.select("media_id", "scene_id", "piece", "start", "end", "semantic_type", "split_count")


@query(with_sql("cv") + """SELECT media_id, ordinal, CASE WHEN "end" - "start" < 10 THEN 'rapid_cut' ELSE speaker END AS semantic_type FROM cv""")
def mark_rapid(c):
    return segments.mark_rapid(c.cv.withColumn("semantic_type", F.col("speaker")), 10.0).select("media_id", "ordinal", "semantic_type")


@query()
def structural_segments(c):
    durations = c.em.groupBy("media_id").agg(F.max("end").alias("duration"))
    return segments.structural_segments(c.em.select("media_id", "t", "ordinal", "embedding"), durations, cuts=c.em_cuts)
