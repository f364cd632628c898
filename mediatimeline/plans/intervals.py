"""Speech regions, sessions, scenes and the joins between spans and events."""

from pyspark.sql import functions as F

from mediatimeline.operators import intervals, joins
from mediatimeline.operators.ordered import Track
from mediatimeline.plans.bridges import with_sql
from mediatimeline.plans.registry import query
from mediatimeline.plans.rows import WORDS_SQL, with_words
from mediatimeline.sources import io

WIDTH = 30.0


def _spans(c):
    return c.ol_spans.select("media_id", F.col("ordinal").alias("span_ordinal"), "start", "end")


@query(with_sql("ol_spans", "ol_events") + """
SELECT e.media_id, e.ordinal, s.ordinal AS span_ordinal, t, "start" FROM ol_events e JOIN ol_spans s ON e.media_id = s.media_id AND t >= "start" AND t <= "end" """)
def events_in_spans(c):
    out = joins.events_in_spans(c.ol_events, _spans(c), WIDTH, cuts=c.ol_cuts, longest=30.0)
    return out.select("media_id", "ordinal", "span_ordinal", "t", "start")


def winner_sql(group):
    return with_sql("ol_spans", "ol_events") + f""", j AS (SELECT e.media_id, e.ordinal, s.ordinal AS span_ordinal, t, "start",
  row_number() OVER (PARTITION BY {group} ORDER BY "start" DESC, s.ordinal DESC, e.ordinal DESC) AS rn
  FROM ol_events e JOIN ol_spans s ON e.media_id = s.media_id AND t >= "start" AND t <= "end")
SELECT media_id, ordinal, span_ordinal, t, "start" FROM j WHERE rn = 1"""


@query(winner_sql("e.media_id, t"))
def later_span_wins(c):
    return intervals.later_span_wins(events_in_spans(c))


@query(winner_sql("e.media_id, t, e.ordinal"))
def later_span_wins_per_event(c):
    return intervals.later_span_wins(events_in_spans(c), by="event")


def _turns(c):
    """Line items as speaker turns of their customer: ship date plus quantity / 4 days."""
    return c.ol_events.select("media_id", "ordinal", F.col("t").alias("start"), (F.col("t") + F.col("quantity") / 4.0).alias("end"),
                              F.col("source").alias("speaker"))


@query(with_sql("ol_spans", "ol_events") + """, tr AS (SELECT media_id, ordinal, t AS s, t + quantity / CAST(4 AS DOUBLE) AS e, source AS speaker FROM ol_events),
o AS (SELECT g.media_id, g.ordinal, tr.speaker, row_number() OVER (PARTITION BY g.media_id, g.ordinal ORDER BY least("end", e) - greatest("start", s) DESC, tr.ordinal) AS rn
  FROM ol_spans g JOIN tr ON g.media_id = tr.media_id AND least("end", e) - greatest("start", s) > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY "start", ordinal) - 1 AS i FROM ol_spans)
SELECT n.media_id, n.ordinal, coalesce(o.speaker, 'Speaker_' || (i % 2 + 1)) AS speaker FROM n LEFT JOIN o ON n.media_id = o.media_id AND n.ordinal = o.ordinal AND rn = 1""")
def assign_by_overlap(c):
    span_cuts = c.cuts("orders", c.ol_spans, by=("start", "ordinal"))
    return intervals.assign_by_overlap(c.ol_spans, _turns(c), WIDTH, cuts=span_cuts, longest=30.0).select("media_id", "ordinal", "speaker")


PAD_SQL = """, tot AS (SELECT media_id, max("end") + 0.3 AS total FROM cv GROUP BY 1),
pd AS (SELECT cv.media_id, ordinal, greatest(0, "start" - 0.2) AS s0, least(total, "end" + {tail}) AS e, "start" AS s_raw FROM cv JOIN tot USING (media_id)),
pt AS (SELECT *, greatest(s0, coalesce(lag(e) OVER (PARTITION BY media_id ORDER BY s_raw, ordinal), s0)) AS s FROM pd)"""


def _regions(c):
    total = c.cv.groupBy("media_id").agg((F.max("end") + 0.3).alias("total"))
    return c.cv.select("media_id", "ordinal", "start", "end").join(total, "media_id")


@query(with_sql("cv") + PAD_SQL.format(tail="CAST(0.4 AS DOUBLE)") + """SELECT media_id, ordinal, round(s, 6) AS "start", round(e, 6) AS "end" FROM pt""")
def pad_and_trim(c):
    out = intervals.pad_and_trim(_regions(c), gap=1.0, cuts=c.cv_time_cuts)
    return out.select("media_id", "ordinal", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


CHUNK_SQL = """, g AS (SELECT *, lag("end") OVER (PARTITION BY media_id ORDER BY "start", ordinal) AS p FROM cv),
ch AS (SELECT *, CAST(sum(CASE WHEN p IS NULL OR "start" > p + 1.0 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY "start", ordinal) - 1 AS BIGINT) AS chunk_id FROM g)"""


@query(with_sql("cv") + CHUNK_SQL + """SELECT media_id, chunk_id, min_by("start", ("start", ordinal)) AS "start", max_by("end", ("start", ordinal)) AS "end",
  count(*) AS regions, round(max_by("end", ("start", ordinal)) - min("start"), 6) AS duration FROM ch GROUP BY media_id, chunk_id""")
def chunk_by_gap(c):
    out = intervals.chunk_by_gap(c.cv, gap=1.0, cuts=c.cv_time_cuts)
    return out.withColumn("duration", F.round("duration", 6)).select("media_id", "chunk_id", "start", "end", "regions", "duration")


@query(with_sql("ev") + """, g AS (SELECT *, lag(t) OVER (PARTITION BY media_id ORDER BY t, ordinal) AS p FROM ev),
s AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p > 12 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t, ordinal) AS session FROM g)
SELECT media_id, CAST(session AS BIGINT) AS session, round(min(t), 6) AS "start", round(max(t), 6) AS "end", count(*) AS events FROM s GROUP BY ALL HAVING max(t) > min(t)""")
def sessions(c):
    out = intervals.sessions(c.ev, gap=12.0, cuts=c.ev_cuts)
    return out.select("media_id", "session", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "events")


@query(with_sql("ev") + """, a AS (SELECT * FROM ev WHERE label = 'click'), b AS (SELECT * FROM ev WHERE label = 'error')
SELECT a.media_id, a.ordinal, round(min(abs(a.t - b.t)), 6) AS distance FROM a LEFT JOIN b ON a.media_id = b.media_id GROUP BY ALL""")
def nearest_distance(c):
    out = joins.nearest(c.ev.filter(F.col("label") == "click"), c.ev.filter(F.col("label") == "error"), cuts=c.ev_cuts)
    return out.select("media_id", "ordinal", F.round("distance", 6).alias("distance"))


SPEECH_SQL = """, sp AS (SELECT media_id, ordinal, t AS "start", t + k / CAST(10 AS DOUBLE) AS "end" FROM ev WHERE label = 'signup'),
mu AS (SELECT media_id, t, ordinal, CASE k % 4 WHEN 0 THEN 'Musical Onset' WHEN 1 THEN 'Tempo Change' WHEN 2 THEN 'Spectral Event' ELSE 'Structural Segment' END AS description FROM ev WHERE label IN ('click', 'purchase')),
rf AS (SELECT media_id, t FROM ev WHERE label = 'error'),
ne AS (SELECT mu.media_id, mu.ordinal, coalesce(bool_or(abs(t - "start") <= 0.5 OR abs(t - "end") <= 0.5), FALSE) AS near_seg FROM mu LEFT JOIN sp ON mu.media_id = sp.media_id GROUP BY ALL),
ap AS (SELECT mu.media_id, mu.ordinal, coalesce(min(abs(mu.t - rf.t)) > 0.7, FALSE) AS apart FROM mu LEFT JOIN rf ON mu.media_id = rf.media_id GROUP BY ALL),
ins AS (SELECT mu.media_id, mu.ordinal, coalesce(bool_or(t >= "start" AND t <= "end"), FALSE) AS in_speech FROM mu LEFT JOIN sp ON mu.media_id = sp.media_id GROUP BY ALL),
fl AS (SELECT mu.*, duration, near_seg OR t <= 0.5 OR duration - t <= 0.5 AS near_edge, apart, in_speech FROM mu JOIN ne USING (media_id, ordinal) JOIN ap USING (media_id, ordinal) JOIN ins USING (media_id, ordinal) LEFT JOIN ev_media USING (media_id))"""


def _speech(c):
    return c.ev.filter(F.col("label") == "signup").select(
        "media_id", "ordinal", F.col("t").alias("start"), (F.col("t") + F.col("k") / 10.0).alias("end"))


def _music(c):
    names = F.array(*[F.lit(x) for x in ("Musical Onset", "Tempo Change", "Spectral Event", "Structural Segment")])
    return c.ev.filter(F.col("label").isin("click", "purchase")).select(
        "media_id", "t", "ordinal", F.element_at(names, F.col("k") % 4 + 1).alias("description"))


@query(with_sql("ev", "ev_media") + SPEECH_SQL + "SELECT media_id, ordinal, near_edge FROM fl")
def near_boundary(c):
    edges = intervals.span_edges(_speech(c))
    return intervals.near_boundary(_music(c), edges, c.ev_media, cuts=c.ev_cuts).select("media_id", "ordinal", "near_edge")


@query(with_sql("ev", "ev_media") + SPEECH_SQL + """
SELECT media_id, ordinal, description, near_edge, apart, in_speech FROM fl
WHERE near_edge OR apart OR NOT in_speech OR description IN ('Tempo Change', 'Structural Segment')""")
def filter_artifacts(c):
    reference = c.ev.filter(F.col("label") == "error").select("media_id", "t", "ordinal")
    out = intervals.filter_artifacts(_music(c), _speech(c), reference, c.ev_media, width=5.0, cuts=c.ev_cuts)
    return out.select("media_id", "ordinal", "description", "near_edge", "apart", "in_speech")


@query(with_sql("ol_spans", "ol_events") + """, a AS (SELECT * FROM ol_spans WHERE media_id % 3 <> 0 AND ordinal % 2 = 0), b AS (SELECT * FROM ol_spans WHERE media_id % 3 = 0 OR ordinal % 2 = 1),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b WHERE media_id NOT IN (SELECT media_id FROM a)),
n AS (SELECT u.media_id, u.ordinal, count(*) AS n FROM u JOIN ol_events e ON e.media_id = u.media_id AND t >= "start" AND t <= "end" GROUP BY ALL)
SELECT u.media_id, u.ordinal, "start", "end", printf('Audio Analysis Segment (%.1fs)', "end" - "start") AS description, coalesce(n, 0) AS events FROM u LEFT JOIN n USING (media_id, ordinal)""")
def unified_spans(c):
    first = (F.col("ordinal") % 2 == 0) & (F.col("media_id") % 3 != 0)
    spans, nested = intervals.unified_spans(
        c.ol_spans.filter(first), c.ol_spans.filter(~first), c.ol_events, WIDTH, cuts=c.ol_cuts, longest=30.0)
    counts = nested.groupBy("media_id", F.col("span_ordinal").alias("ordinal")).agg(F.count(F.lit(1)).alias("events"))
    return spans.join(counts, ["media_id", "ordinal"], "left").select(
        "media_id", "ordinal", "start", "end", "description", F.coalesce("events", F.lit(0)).alias("events"))


def _relative(c):
    """Segments with times relative to their chunk, and the chunks."""
    numbered = intervals.number_chunks(with_words(c.cv), 1.0, cuts=c.cv_time_cuts)
    chunks = intervals.chunk_by_gap(c.cv, 1.0, cuts=c.cv_time_cuts)
    shift = chunks.select("media_id", "chunk_id", F.col("start").alias("_c"))
    rows = numbered.join(shift, ["media_id", "chunk_id"])
    moved = F.transform("words", lambda w: w.withField("start", w["start"] - F.col("_c")).withField("end", w["end"] - F.col("_c")))
    return rows.withColumns({"start": F.col("start") - F.col("_c"), "end": F.col("end") - F.col("_c"), "words": moved}).drop("_c"), chunks


@query(with_sql("cv") + CHUNK_SQL + """SELECT media_id, ordinal, chunk_id, round("start", 6) AS "start", round("end", 6) AS "end",
  round("start" + (words - 1) * CAST(0.4 AS DOUBLE), 6) AS last_word FROM ch""")
def rebase_times(c):
    relative, chunks = _relative(c)
    out = intervals.rebase_times(relative, chunks)
    return out.select("media_id", "ordinal", "chunk_id", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"),
                      F.round(F.element_at("words", -1)["start"], 6).alias("last_word"))


REGROUP_SQL = CHUNK_SQL + """, v AS (SELECT * FROM ch WHERE trim(text) <> '' AND "start" < "end"),
st AS (SELECT media_id, chunk_id, min("start") AS "start", max("end") AS "end", sum(confidence * ("end" - "start")) / sum("end" - "start") AS confidence,
  string_agg(trim(text, ' '), ' ' ORDER BY "start", ordinal) AS text FROM v GROUP BY ALL),
tk AS (SELECT media_id, chunk_id, speaker, row_number() OVER (PARTITION BY media_id, chunk_id ORDER BY round(sum("end" - "start"), 9) DESC, min(ordinal)) AS rk FROM v GROUP BY media_id, chunk_id, speaker),
rg AS (SELECT st.*, speaker, lag(speaker) OVER (PARTITION BY st.media_id ORDER BY st.chunk_id) AS prev_speaker FROM st JOIN tk USING (media_id, chunk_id) WHERE rk = 1)"""


def _regrouped(c):
    segments = intervals.number_chunks(with_words(c.cv), 1.0, cuts=c.cv_time_cuts)
    return segments, intervals.regroup_speech(segments, cuts=c.cv_time_cuts)


@query(with_sql("cv") + REGROUP_SQL + """SELECT media_id, chunk_id, CAST(0 AS BIGINT) AS part, "start", "end", round(confidence, 6) AS confidence, speaker, prev_speaker, text FROM rg""")
def regroup_speech(c):
    _, spans = _regrouped(c)
    return spans.select("media_id", "chunk_id", "part", "start", "end", F.round("confidence", 6).alias("confidence"), "speaker",
                        "prev_speaker", "text")


@query(with_sql("cv") + REGROUP_SQL + ", " + WORDS_SQL + """, ww AS (SELECT w.media_id, chunk_id, w.ordinal, word_no, round(w."start" + word_no * CAST(0.4 AS DOUBLE), 2) AS t, word, round(word_confidence, 2) AS confidence
  FROM w JOIN v USING (media_id, ordinal) WHERE word <> '' AND word_confidence >= 0.3)
SELECT ww.media_id, ww.chunk_id, ordinal, word_no, t, 'Word' AS description, ww.confidence, word, speaker, NULL AS prev_speaker FROM ww JOIN rg USING (media_id, chunk_id)
WHERE t >= round(rg."start", 2) AND t <= round(rg."end", 2)
UNION ALL SELECT media_id, chunk_id, NULL, NULL, round("start", 2), 'Speaker Change', CAST(0.85 AS DOUBLE), NULL, speaker, prev_speaker FROM rg WHERE speaker <> prev_speaker""")
def speech_events(c):
    segments, spans = _regrouped(c)
    return intervals.speech_events(segments, spans)


@query(with_sql("ev") + """, f AS (SELECT media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY t, ordinal) - 1 AS BIGINT) AS frame, k AS score FROM ev),
g AS (SELECT *, sum((score >= 80)::INT) OVER (PARTITION BY media_id ORDER BY frame) AS cut FROM f),
s AS (SELECT media_id, cut, min(frame) AS start_frame FROM g GROUP BY ALL),
n AS (SELECT media_id, row_number() OVER w AS scene_id, start_frame, lead(start_frame) OVER w AS end_frame FROM s WINDOW w AS (PARTITION BY media_id ORDER BY start_frame))
SELECT *, start_frame / CAST(25 AS DOUBLE) AS "start", end_frame / CAST(25 AS DOUBLE) AS "end",
  CAST(floor(CASE WHEN end_frame IS NULL THEN start_frame + 75 ELSE start_frame + (end_frame - start_frame) / 2.0 END) AS BIGINT) AS middle FROM n""")
def cut_scenes(c):
    """Each event plays a frame whose score is k; scenes and their middle frames."""
    out = intervals.cut_scenes(_scored(c), 80, cuts=c.ev_cuts)
    return out.select("media_id", "scene_id", "start_frame", "end_frame", "start", "end", intervals.representative_frame().alias("middle"))


def _scored(c):
    numbered = Track(c.ev, ("media_id",), ("t", "ordinal"), c.ev_cuts).number("_n").df
    return numbered.select("media_id", (F.col("_n") - 1).alias("frame"), F.col("k").alias("score"), F.lit(25.0).alias("fps"))


POINTS_SQL = """, sc AS (SELECT media_id, ordinal % 1000 + 1 AS scene_id, ordinal, "start", CASE WHEN ordinal % 10 = 0 THEN "start" + 5 ELSE "end" END AS e FROM ol_spans),
pt AS (SELECT media_id, ordinal, scene_id, e - "start" AS scene_duration, 'first' AS frame, "start" AS t, 'scene_start' AS type FROM sc
 UNION ALL SELECT media_id, ordinal, scene_id, e - "start", 'representative', "start" + (e - "start") / 2, 'scene_middle' FROM sc
 UNION ALL SELECT media_id, ordinal, scene_id, e - "start", 'last', e - CAST(0.1 AS DOUBLE), 'scene_end' FROM sc)"""


def _points(c):
    """Orders as scenes; every tenth is open-ended."""
    scenes = c.ol_spans.select("media_id", F.col("ordinal").alias("scene_id"), "start",
                               F.when(F.col("ordinal") % 10 != 0, F.col("end")).alias("end"))
    return intervals.three_points(scenes)


@query(with_sql("ol_spans") + POINTS_SQL + """SELECT media_id, ordinal AS scene_id, scene_duration, frame, round(t, 6) AS t, printf('scene_%03d_', ordinal) || frame || '.jpg' AS path, type FROM pt""")
def three_points(c):
    return _points(c).withColumn("t", F.round("t", 6))


@query(with_sql("ol_spans") + POINTS_SQL + """SELECT media_id, ordinal AS scene_id, "start" AS t, printf('scene_%03d_representative.jpg', ordinal) AS representative_frame_path,
  "start" + (e - "start") / 2 AS representative_frame_timestamp, e - "start" AS scene_duration, round(e - 0.1, 6) AS scene_end_timestamp, 'internvl3' AS source, CAST(0.8 AS DOUBLE) AS confidence FROM sc""")
def scene_events(c):
    return intervals.scene_events(_points(c)).withColumn("scene_end_timestamp", F.round("scene_end_timestamp", 6))


@query(with_sql("ol_spans") + POINTS_SQL + """SELECT media_id, ordinal AS scene_id, printf('scene_%03d_representative.jpg', ordinal) AS path,
  printf('%02dm%05.2fs.jpg', CAST(floor(t / 60) AS BIGINT), t - floor(t / 60) * 60) AS copy_name FROM pt WHERE frame = 'representative'""")
def copy_names(c):
    return intervals.copy_names(_points(c))


@query(with_sql("ol_spans") + """SELECT media_id, ordinal AS scene_id, printf('scene_%03d.mp4', ordinal) AS clip, CASE WHEN ordinal % 10 <> 0 THEN "end" - "start" END AS duration_seconds,
  CASE WHEN ordinal % 10 <> 0 THEN "start" + ("end" - "start") / 2 ELSE "start" + 3 END AS representative_timestamp FROM ol_spans""")
def scene_offsets(c):
    scenes = c.ol_spans.select("media_id", F.col("ordinal").alias("scene_id"), "start",
                               F.when(F.col("ordinal") % 10 != 0, F.col("end")).alias("end"))
    return io.scene_offsets(scenes).select("media_id", "scene_id", "clip", "duration_seconds", "representative_timestamp")


@query(with_sql("ol_spans") + POINTS_SQL + """SELECT media_id, CAST(floor((ordinal - 1) / 1000) AS BIGINT) AS part, CAST(dense_rank() OVER (PARTITION BY media_id, floor((ordinal - 1) / 1000) ORDER BY ordinal) - 1 AS INTEGER) AS place,
  printf('scene_%03d', ordinal) AS scene, frame, round(t, 6) AS t, printf('scene_%03d_', ordinal) || frame || '.jpg' AS path, type FROM pt""")
def frame_metadata(c):
    """The maps taken apart again: a scene's place among the entries of its row, and its three frames."""
    entries = io.frame_metadata(_points(c)).select("media_id", "part", F.posexplode("scenes").alias("place", "scene", "frames"))
    return entries.select("media_id", "part", "place", "scene", F.explode("frames").alias("frame", "v")).select(
        "media_id", "part", "place", "scene", "frame", F.round("v.t", 6).alias("t"), "v.path", "v.type")
