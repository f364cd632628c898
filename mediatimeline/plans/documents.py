"""Merged timelines and the documents made of them."""

from pyspark.sql import functions as F

from mediatimeline.functions import rows
from mediatimeline.functions.render import event_line as line_of
from mediatimeline.operators import change, combine, joins
from mediatimeline.plans.bridges import with_sql
from mediatimeline.plans.registry import query
from mediatimeline.sources import io

W = "OVER (PARTITION BY media_id ORDER BY t, ordinal)"


def detectors(c):
    """Three detectors over the events: label changes, value jumps, and spoken words."""
    labels = change.gated_label_change(c.ev, above=0.6, cuts=c.ev_cuts)
    voice = rows.make_events(labels.withColumn("kind", F.lit("emotion_change")), "pyaudio_voice", details=F.create_map(
        F.lit("previous_emotion"), F.col("prev_label"), F.lit("emotion"), F.col("label")))
    jumps = change.numeric_change(c.ev, cuts=c.ev_cuts)
    tempo = rows.make_events(jumps.withColumns({"kind": F.lit("tempo_change"), "confidence": F.col("change_confidence")}), "librosa_music",
                             details=F.create_map(F.lit("previous_tempo"), F.col("prev_value").cast("string"), F.lit("new_tempo"), F.col("value").cast("string")))
    words = rows.make_events(c.ev.filter(F.col("label") == "signup").withColumn("kind", F.lit("word")), "whisper_voice", details=F.create_map(
        F.lit("word"), F.concat(F.lit("w"), F.col("k").cast("string")), F.lit("speaker"), F.concat(F.lit("Speaker_"), (F.col("k") % 2).cast("string"))))
    return [voice, tempo, words]


DETECT_SQL = f"""
, l AS (SELECT *, lag(label) {W} AS prev_label FROM ev WHERE confidence > 0.6), v AS (SELECT *, lag(value) {W} AS prev_value FROM ev),
raw AS (
  SELECT 0 AS timeline, media_id, ordinal, round(t, 2) AS t, 'Emotion Change' AS description, 'pyaudio_voice' AS source, confidence,
    'Emotion Change: ' || coalesce(prev_label, 'unknown') || ' -> ' || label AS body FROM l WHERE label IS DISTINCT FROM prev_label
  UNION ALL SELECT 1, media_id, ordinal, round(t, 2), 'Tempo Change', 'librosa_music', round(least(0.95, 0.6 + abs(value - prev_value) / 20), 2),
    'Tempo Change: ' || CAST(trunc(prev_value) AS BIGINT) || ' BPM -> ' || CAST(trunc(value) AS BIGINT) || ' BPM' FROM v WHERE abs(value - prev_value) > 10
  UNION ALL SELECT 2, media_id, ordinal, round(t, 2), 'Word', 'whisper_voice', CASE WHEN confidence <> 1 THEN round(confidence, 2) END, '[Speaker_' || (k % 2) || '] w' || k FROM ev WHERE label = 'signup'),
ln AS (SELECT *, printf('[%02d:%05.2f]', CAST(floor(t / 60) AS BIGINT), t - floor(t / 60) * 60) || CASE WHEN description = 'Word' THEN ' - ' || body ELSE ' - (' || source || ') ' || body END AS line FROM raw)"""
KEPT = "description LIKE '%Tempo Change%' OR source = 'whisper_voice'"


@query(with_sql("ev") + DETECT_SQL + f"SELECT timeline, media_id, ordinal, t, description, source, confidence FROM raw WHERE {KEPT}")
def combine_timelines(c):
    events, _ = combine.combine_timelines(detectors(c))
    return events.drop("details")


@query(with_sql("ev") + DETECT_SQL + "SELECT timeline AS origin, media_id, ordinal, t, description, source FROM raw")
def all_events(c):
    return combine.all_events(*detectors(c)).select("origin", "media_id", "ordinal", "t", "description", "source")


@query(with_sql("ev") + DETECT_SQL + "SELECT timeline AS origin, media_id, ordinal, line FROM ln")
def event_line(c):
    return combine.all_events(*detectors(c)).select("origin", "media_id", "ordinal", line_of().alias("line"))


@query(with_sql("ev") + DETECT_SQL + f"SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY t, ordinal * 8 + timeline) AS line_no, line FROM ln WHERE {KEPT}")
def knowledge_lines(c):
    return combine.knowledge_lines(merged(c), cuts=c.ev_cuts).select("media_id", "line_no", "line")


def merged(c):
    """The merged timeline with one order number: the detector's rank breaks ties of one event."""
    events, _ = combine.combine_timelines(detectors(c))
    return events.withColumn("ordinal", F.col("ordinal") * 8 + F.col("timeline"))


def titles(c):
    """Name and transcript of each media: the transcript lists its number of events, where it is even."""
    n = F.count(F.lit(1))
    return c.ev.groupBy("media_id").agg(n.alias("_n")).select(
        "media_id", F.concat(F.lit("media_"), F.col("media_id").cast("string")).alias("name"),
        F.when(F.col("_n") % 2 == 0, F.concat(F.col("_n").cast("string"), F.lit(" events"))).alias("transcript"))


NL = "chr(10)"
TITLE_SQL = "tt AS (SELECT media_id, CASE WHEN count(*) % 2 = 0 THEN count(*) || ' events' END AS transcript FROM ev GROUP BY media_id)"


@query(with_sql("ev") + DETECT_SQL + f""", {TITLE_SQL}, bd AS (SELECT media_id, string_agg(line, {NL} ORDER BY t, ordinal * 8 + timeline) AS body FROM ln WHERE {KEPT} GROUP BY media_id)
SELECT media_id, CAST(0 AS BIGINT) AS part, '# Summary for video: media_' || media_id || '.mp4' || {NL} || {NL} || CASE WHEN transcript IS NOT NULL THEN '## Full Transcript' || {NL} || transcript || {NL} || {NL} ELSE '' END
  || '## Detailed Event Timeline' || {NL} || coalesce({NL} || body, '') AS document FROM tt LEFT JOIN bd USING (media_id)""")
def knowledge_document(c):
    return combine.knowledge_document(merged(c), titles(c), cuts=c.ev_cuts)


@query(with_sql("ev") + DETECT_SQL + f""", {TITLE_SQL}, bd AS (SELECT media_id, string_agg(replace(replace(line, '[Speaker_0] ', ''), '[Speaker_1] ', ''), {NL} ORDER BY t, ordinal * 8 + timeline) AS body FROM ln WHERE source = 'whisper_voice' GROUP BY media_id)
SELECT media_id, CAST(0 AS BIGINT) AS part, 'Full Transcript: ' || coalesce(transcript, '') || {NL} || coalesce({NL} || body, '') AS context FROM tt LEFT JOIN bd USING (media_id)""")
def context_document(c):
    return combine.context_document(merged(c), titles(c), cuts=c.ev_cuts)


@query(with_sql("ev") + DETECT_SQL + "SELECT media_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM raw GROUP BY media_id")
def source_union(c):
    return combine.source_union(combine.all_events(*detectors(c)))


@query("""WITH t AS (SELECT source AS media_id, doc_id AS ordinal, CASE WHEN doc_id % 3 = 0 THEN 'whisper' ELSE 'other' END AS src, CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END AS transcript, lang AS language FROM documents)
SELECT media_id, min_by(transcript, ordinal) AS transcript, min_by(language, ordinal) AS language FROM t WHERE src = 'whisper' AND transcript <> '' GROUP BY media_id""")
def transcript_priority(c):
    rows_ = c.dc.select(F.col("source").alias("media_id"), F.col("doc_id").alias("ordinal"),
                        F.when(F.col("doc_id") % 3 == 0, "whisper").otherwise("other").alias("source"),
                        F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("").alias("transcript"), F.col("lang").alias("language"))
    return combine.transcript_priority(rows_)


@query(with_sql("ev") + "SELECT media_id, ordinal, round(t, 6) AS t FROM ev ORDER BY media_id, t, ordinal")
def chronological(c):
    return combine.chronological(c.ev.select("media_id", "ordinal", "t"), "t", "ordinal").withColumn("t", F.round("t", 6))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey % 2 DESC, lower(p_name), p_name")
def browse_order(c):
    """Parts as folder entries; odd keys play folders."""
    entries = c.table("part").select("p_partkey", "p_name", (F.col("p_partkey") % 2 == 1).alias("is_dir"))
    return io.browse_order(entries, name="p_name").select("p_partkey", "p_name")


def _inner(c):
    spans = c.ol_spans.select("media_id", F.col("ordinal").alias("span_ordinal"), "start", "end")
    return joins.events_in_spans(c.ol_events, spans, 30.0, cuts=c.ol_cuts, longest=30.0)


@query(with_sql("ol_spans", "ol_events") + """, n AS (SELECT s.media_id, s.ordinal, count(*) AS n FROM ol_spans s JOIN ol_events e ON e.media_id = s.media_id AND t >= "start" AND t <= "end" GROUP BY ALL)
SELECT media_id, ordinal, 'event' AS row_type, t AS "start", CAST(NULL AS DOUBLE) AS "end", 'Line ' || source AS description, 'line_' || lower(source) AS event_type, source, CAST(0.5 AS DOUBLE) AS confidence, CAST(NULL AS BIGINT) AS events_count FROM ol_events
UNION ALL SELECT media_id, ordinal, 'span', "start", "end", description, NULL, 'orders', confidence, coalesce(n, 0) FROM ol_spans LEFT JOIN n USING (media_id, ordinal)""")
def audit_export(c):
    events = c.ol_events.select("media_id", "ordinal", "t", F.concat(F.lit("Line "), "source").alias("description"), "source", F.lit(0.5).alias("confidence"))
    spans = c.ol_spans.withColumn("source", F.lit("orders"))
    return combine.audit_export(events, spans, _inner(c))


@query(with_sql("ol_spans", "ol_events") + """, s AS (SELECT media_id, ordinal, "start", "end", 'orders' AS source, description, 'speech' AS category FROM ol_spans),
ed AS (SELECT DISTINCT media_id, unnest([start, "end"]) AS a FROM s), pc AS (SELECT media_id, a, lead(a) OVER (PARTITION BY media_id ORDER BY a) AS b FROM ed),
fm AS (SELECT media_id, a, b, regexp_replace(printf('%.2f', a), '(\\.\\d)0$', '\\1') AS fa, regexp_replace(printf('%.2f', b), '(\\.\\d)0$', '\\1') AS fb FROM pc WHERE b IS NOT NULL)
SELECT fm.media_id, a AS "at", fa || '-' || fb || 's' AS time_range, source, description, category, ordinal FROM fm JOIN s ON s.media_id = fm.media_id AND "start" <= (a + b) / 2 AND "end" >= (a + b) / 2
UNION ALL SELECT media_id, t, regexp_replace(printf('%.2f', t), '(\\.\\d)0$', '\\1') || 's', source, 'Line', 'sfx', ordinal FROM ol_events""")
def time_range_segments(c):
    spans = c.ol_spans.select("media_id", "ordinal", "start", "end", F.lit("orders").alias("source"), "description", F.lit("speech").alias("category"))
    events = c.ol_events.select("media_id", "ordinal", "t", "source", F.lit("Line").alias("description"), F.lit("sfx").alias("category"))
    return combine.time_range_segments(spans, events, 30.0, cuts=c.cuts("orders", c.ol_spans, by=("start", "ordinal"), copies=2), longest=30.0)


@query(with_sql("ol_spans", "ol_events") + """, p AS (SELECT e.media_id, s.ordinal AS so, count(*) AS n FROM ol_events e JOIN ol_spans s ON e.media_id = s.media_id AND t >= "start" AND t <= "end" GROUP BY ALL),
a AS (SELECT ol_spans.media_id, count(*) AS spans, sum(coalesce(n, 0)) AS inner_events FROM ol_spans LEFT JOIN p ON p.media_id = ol_spans.media_id AND so = ordinal GROUP BY ol_spans.media_id),
b AS (SELECT media_id, count(*) AS events FROM ol_events GROUP BY media_id)
SELECT CAST(media_id AS VARCHAR) AS media_id, CAST(0 AS BIGINT) AS part, CAST(coalesce(spans, 0) AS INTEGER) AS spans, CAST(coalesce(inner_events, 0) AS BIGINT) AS inner_events, CAST(coalesce(events, 0) AS INTEGER) AS events FROM a FULL JOIN b USING (media_id)""")
def nest_timelines(c):
    """Nested rows as they are written; counted for the check."""
    out = nested(c)
    inner = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + F.size(s["events"]))
    return out.select("media_id", "part", F.size("spans").alias("spans"), inner.alias("inner_events"), F.size("events").alias("events"))


def nested(c):
    none = rows.no_details()
    media = c.ol_spans.groupBy("media_id").agg(F.max("end").alias("duration"))
    spans = c.ol_spans.withColumns({"source": F.lit("orders"), "details": none})
    shape = {"description": F.lit("Line"), "confidence": F.lit(0.5), "details": none}
    return io.nest_timelines(media, spans, _inner(c).withColumns(shape), c.ol_events.withColumns(shape), cuts=c.ol_cuts)
