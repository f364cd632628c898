"""Sources and sinks: what is written is what is read."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mediatimeline.functions import detectors
from mediatimeline.operators.ordered import NO_CUTS, find_cuts
from mediatimeline.sources import documents, io, store, timeline_files
from tests.conftest import plan_of


def timelines(spark):
    media = spark.createDataFrame([("1", 90.0), ("2", 30.0), ("3", 5.0)], "media_id string, duration double")
    kinds = "description string, source string, confidence double, details map<string,string>"
    spans = spark.createDataFrame([("1", i, i * 10.0, i * 10.0 + 8, "Speech", "whisper", None, {"n": str(i)}) for i in range(6)],
                                  f"media_id string, ordinal bigint, start double, end double, {kinds}")
    inner = spark.createDataFrame([("1", i, s, i * 1.0, "Word", "whisper", 0.5, {"word": f"w{i}"}) for s in (0, 3) for i in range(s * 20, s * 20 + 9)],
                                  f"media_id string, ordinal bigint, span_ordinal bigint, t double, {kinds}")
    events = spark.createDataFrame([(m, i, i * 2.5, "Tempo Change", "librosa", 0.9, {}) for m in ("1", "2") for i in range(7)],
                                   f"media_id string, ordinal bigint, t double, {kinds}")
    return media, spans, inner, events


@pytest.mark.parametrize("part_rows", [10_000, 4, 2])
def test_timeline_round_trip(spark, tmp_path, part_rows):
    media, spans, inner, events = timelines(spark)
    high = 2**62  # ordinals of any size
    spans, events = spans.withColumn("ordinal", F.col("ordinal") + high), events.withColumn("ordinal", F.col("ordinal") + high)
    inner = inner.withColumn("span_ordinal", F.col("span_ordinal") + high)
    events = events.union(events.where("media_id = '2'").withColumn("media_id", F.lit("4")))  # has no media row
    cuts = NO_CUTS if part_rows > 4 else find_cuts(events, rows=3)
    nested = io.nest_timelines(media, spans, inner, events, part_rows, cuts)
    io.write_timelines(nested, str(tmp_path / "tl"))
    back = io.read_timelines(spark, str(tmp_path / "tl"))
    assert sorted(map(str, back.collect())) == sorted(map(str, nested.collect()))
    assert {r["media_id"]: r["duration"] for r in back.collect()} == {"1": 90.0, "2": 30.0, "3": 5.0, "4": None}
    heads, words, single = io.flatten_timelines(back)
    assert sorted((r["media_id"], r["ordinal"], r["start"]) for r in heads.collect()) == [("1", high + i, i * 10.0) for i in range(6)]
    assert sorted(r["details"]["word"] for r in words.collect()) == sorted(f"w{i}" for s in (0, 60) for i in range(s, s + 9))
    assert sorted((r["media_id"], r["t"]) for r in single.collect()) == [(m, i * 2.5) for m in ("1", "2", "4") for i in range(7)]
    assert max(len(r["events"]) for r in nested.collect()) <= part_rows


def test_catalog(spark, tmp_path):
    os.makedirs(tmp_path / "a")
    for name, size in (("a/one.MP4", 2048), ("two.mkv", 1023), ("three.txt", 4000), ("four.webm", 1048576)):
        (tmp_path / name).write_bytes(b"x" * size)
    got = {r["name"]: r for r in io.media_info(io.media_catalog(spark, str(tmp_path))).collect()}
    assert set(got) == {"one.MP4", "four.webm"} and got["four.webm"]["size_mb"] == 1.0 and got["one.MP4"]["extension"] == ".mp4"
    plan = io.media_catalog(spark, str(tmp_path)).select("path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_logs_manifest(spark, tmp_path):
    log = tmp_path / "log"
    os.makedirs(log)
    (log / "a.jsonl").write_text('{"timestamp":"2024-01-01T00:00:00Z","error_type":"x"}\nnot json\n{"error_type":"y"}\n')
    assert sorted(r["error_type"] for r in io.read_error_log(spark, str(log)).collect()) == ["x", "y"]
    rows = spark.createDataFrame([("f", True)], "filename string, success boolean")
    io.append_rows(rows, str(tmp_path / "res"))
    io.append_rows(rows, str(tmp_path / "res"))
    assert spark.read.schema(io.RESULTS).json(str(tmp_path / "res")).count() == 2
    first = io.write_manifest(rows, str(tmp_path / "man"), 1)
    io.write_manifest(rows.union(rows), str(tmp_path / "man"), 2)
    assert spark.read.parquet(first).count() == 1


def test_latest_per_family(spark):
    files = spark.createDataFrame([("a", "contextual", "p1", 1), ("a", "contextual", "p2", 2), ("a", "legacy", "p9", 9), ("b", "legacy", "p3", 1),
                                   ("c", "noncontextual", "p4", 1), ("c", "legacy", "p5", 1)], "media_id string, family string, path string, mtime bigint")
    got = {r["media_id"]: (r["chosen"], r["legacy"]) for r in io.latest_per_family(files).collect()}
    assert got == {"a": ("p2", None), "b": ("p3", "p3"), "c": ("p4", None)}


def test_detectors(spark):
    class Tagged:
        def __init__(self, source):
            self.source = source

        def detect(self, media):
            return media.select("media_id", F.lit(self.source).alias("source"))
    media = spark.createDataFrame([(1, 100), (2, 8_800_000)], "media_id int, size_bytes bigint")
    out = detectors.run_detectors(media, [Tagged("a"), Tagged("b")])
    assert set(out) == {"a", "b"}
    with pytest.raises(ValueError):
        detectors.run_detectors(media, [Tagged("a"), Tagged("a")])
    rows = detectors.fallback_rows(media, out["a"].filter("media_id = 0"), "x").orderBy("media_id").collect()
    assert [r["duration"] for r in rows] == [30.0, 100.0]


def stored(path):
    return sorted(f for f in os.listdir(path)) if os.path.isdir(path) else []


def test_documents(spark, tmp_path):
    path = str(tmp_path / "docs")
    names = ["m1", "a/b", "a_b", "_hidden", ".dot", "é ü", "", "x" * 300, "x" * 301, "A", None]
    rows = [(m, p, f"# {m} {p}\nline") for m in names for p in (2, 0, 1)] + [("m1", 3, None)]
    frame = spark.createDataFrame(rows, "media_id string, part bigint, document string")
    documents.write_documents(frame.repartition(5), path)
    want = {m: "\n".join(f"# {m} {p}\nline" for p in range(3)) + ("\n" if m == "m1" else "") for m in names}
    got = documents.read_documents(spark, path).collect()
    assert {r["media_id"]: r["document"] for r in got} == want and len(got) == len(names)
    assert {r["media_id"]: r["parts"] for r in got}["m1"] == 4
    assert len({documents.file_name(m).lower() for m in names if m != "A"}) == len(names) - 1
    assert stored(path) == sorted([documents.file_name(m) for m in names] + [store.MANIFEST] + [f for f in os.listdir(path) if f.endswith(".crc")])
    # a second write replaces its media and leaves the others
    documents.write_documents(spark.createDataFrame([("m1", 0, "new"), ("m9", 0, "x")], "media_id string, part bigint, document string"), "file:" + path)
    assert {r["media_id"]: r["document"] for r in documents.read_documents(spark, path).collect()} == want | {"m1": "new", "m9": "x"}


def test_document_folders(spark, tmp_path):
    """Files in sub-folders: the manifest, the commit messages and Spark's reader know folders, not files."""
    path = str(tmp_path / "docs")
    rows = [(m, p, f"{m} {p}") for m in [*map(str, range(500)), "a/b", "", None] for p in (1, 0)]
    frame = spark.createDataFrame(rows, "media_id string, part bigint, document string")
    documents.write_documents(frame, path, folders=True)
    folders = store.manifest(path)["folders"]
    assert 0 < len(folders) <= 8 and sorted(x for x in stored(path) if not x.endswith(".crc")) == sorted([*folders, store.MANIFEST])
    assert os.path.getsize(f"{path}/{store.MANIFEST}") < 500
    got = [(r["file"], r["document"]) for r in documents.read_folders(spark, path).collect()]
    assert sorted(got) == sorted((documents.file_name(m), f"{m} 0\n{m} 1") for m in {r[0] for r in rows})
    with pytest.raises(Exception, match="already"):
        documents.write_documents(frame, path, folders=True)
    assert sorted((r["file"], r["document"]) for r in documents.read_folders(spark, path).collect()) == sorted(got)
    empty = str(tmp_path / "none")
    documents.write_documents(frame.where("false"), empty, folders=True)
    assert documents.read_folders(spark, empty).collect() == []


def test_failed_write_leaves_no_document(spark, tmp_path):
    path = str(tmp_path / "docs")
    broken = F.when(F.col("id") == 55, F.raise_error(F.lit("broken"))).otherwise("text")
    rows = spark.range(100).select(F.col("id").cast("string").alias("media_id"), F.lit(0).alias("part"), broken.alias("document"))
    with pytest.raises(Exception, match="broken"):
        documents.write_documents(rows, path)
    assert stored(path) == []
    with pytest.raises(Exception):  # nothing was published
        documents.read_documents(spark, path).collect()


def test_no_documents(spark, tmp_path):
    path = str(tmp_path / "docs")
    documents.write_documents(spark.createDataFrame([], "media_id string, part bigint, document string"), path)
    assert stored(path) == [store.MANIFEST] and documents.read_documents(spark, path).collect() == []


def test_failing_rows_become_errors(spark):
    """A model that raises on some rows labels all others; each failing row is named once."""
    calls = []

    def predict(model, batch):
        calls.append(len(batch))
        if (batch["x"] % 97 == 5).any():
            raise KeyError("five")
        if (batch["x"] == 700).any():
            return pd.DataFrame({"label": [], "confidence": [], "probabilities": []})  # loses rows
        return pd.DataFrame({"label": [str(x) for x in batch["x"]], "confidence": 0.5, "probabilities": [{"a": 1.0}] * len(batch)})

    rows = spark.range(1000).select(F.col("id").alias("media_id"), F.lit(0).alias("win"), F.col("id").alias("x"))
    labels, errors = detectors.try_model(rows, lambda: None, predict, ["x"], source="m")
    bad = {x for x in range(1000) if x % 97 == 5}
    assert {r["media_id"]: r["label"] for r in labels.collect()} == {x: str(x) for x in range(1000) if x not in bad and x != 700}
    got = {r["media_id"]: (r["tool_name"], r["error_type"]) for r in errors.collect()}
    assert got == {x: ("m", "KeyError") for x in bad} | {700: ("m", "ValueError")}
    assert detectors.try_model(rows.where("false"), lambda: None, predict, ["x"])[0].collect() == []
    with pytest.raises(Exception, match="five"):
        detectors.apply_model(rows, lambda: None, predict, ["x"]).collect()


def test_many_failing_rows_cost_few_calls(spark, tmp_path):
    """One file is dealt to several tasks, a bad row costs about one call, and a batch comes back as one frame."""
    spark.range(20000).select("id", (F.col("id") % 50).alias("x")).coalesce(1).write.parquet(str(tmp_path / "in"))
    calls = spark.sparkContext.accumulator(0)

    def predict(model, batch):
        calls.add(1)
        if (batch["x"] % 10 == 3).any():
            raise ValueError("three")
        return pd.DataFrame({"label": [str(x) for x in batch["x"]], "confidence": 0.5, "probabilities": [{"a": 1.0}] * len(batch)})

    rows = spark.read.parquet(str(tmp_path / "in")).select(F.col("id").alias("media_id"), F.lit(0).alias("win"), "x")
    labels, errors = detectors.try_model(rows, lambda: None, predict, ["x"])
    assert labels.count() == 18000 and errors.count() == 2000
    assert labels.where("label <> cast(media_id % 50 as string)").count() == 0 and errors.where("media_id % 10 <> 3").count() == 0
    assert calls.value < 1.5 * 2000
    assert len([f for f in labels.inputFiles() if f.endswith(".parquet")]) > 1


def test_timeline_files(spark, tmp_path):
    """Both generations are read; what is stored is what was given; files that are no timelines are named."""
    path = tmp_path / "tl"
    docs = spark.createDataFrame(
        [("m1", "m1.wav", 7.5, 'He said "hi"\nthere', ["S1", "S2"], "en", 0.9, "2024-01-01T00:00:00", ["note"]), ("m 2", None, None, None, None, None, None, None, None)],
        "media_id string, audio_file string, duration double, transcript string, speakers array<string>, language string, language_confidence double, created_at string, notes array<string>")
    spans = spark.createDataFrame([("m1", 2, 3.0, 4.0, "Speech", "whisper", None, None, '{"librosa":{"rms":0.5,"v":[1,2]}}'), ("m1", 1, 0.0, 2.0, "Speech", "whisper", 0.5, '{"a":{"b":1}}', None)],
                                  "media_id string, ordinal bigint, start double, end double, description string, source string, confidence double, details string, audio_features string")
    spans = spans.withColumns({n: F.parse_json(n) for n in ("details", "audio_features")})
    events = spark.createDataFrame(
        [("m1", 1, 5, 1.5, "Word", "whisper", None, '{"word":"b"}'), ("m1", 1, 4, 0.5, "Word", "whisper", 0.7, '{"word":"a"}'), ("m1", None, 9, 6.0, "Beat", "librosa", None, None),
         ("m1", None, 8, 6.0, "Beat", "librosa", 0.25, '{"n":[1,null]}')],
        "media_id string, span_ordinal bigint, ordinal bigint, t double, description string, source string, confidence double, details string")
    timeline_files.write_timeline_files(docs, spans, events.withColumn("details", F.parse_json("details")), str(path))
    whole = json.loads((path / "m1.json").read_text())
    assert whole["global_data"] == {"audio_file": "m1.wav", "duration": 7.5, "full_transcript": 'He said "hi"\nthere', "speakers": ["S1", "S2"], "language": "en", "language_confidence": 0.9}
    assert [s["start"] for s in whole["timeline_spans"]] == [0.0, 3.0] and [e["details"]["word"] for e in whole["timeline_spans"][0]["events"]] == ["a", "b"]
    assert whole["timeline_spans"][1]["audio_features"] == {"librosa": {"rms": 0.5, "v": [1, 2]}} and whole["timeline_spans"][1]["events"] == []
    assert whole["metadata"] == {"created_at": "2024-01-01T00:00:00", "sources_used": ["librosa", "whisper"], "total_spans": 2, "total_events": 4, "span_events": 2,
                                 "standalone_events": 2, "processing_notes": ["note"]}
    (path / "flat.json").write_text(json.dumps({"source": "librosa", "audio_file": "f.wav", "total_duration": 9.0, "created_at": "x", "timeline": [
        {"type": "span", "start": 1.0, "end": 2.0, "description": "Music", "category": "music", "source": "librosa", "confidence": 1.0, "details": {}},
        {"type": "event", "timestamp": 1.5, "description": "Onset", "category": "sfx", "source": "librosa", "confidence": 0.5, "details": {"k": 1}}],
        "summary": {"total_events": 1, "total_spans": 1}}, indent=2))
    (path / "torn.json").write_text('{"global_data": {')
    (path / "other.json").write_text('{"x": 1}')
    (path / "empty.json").write_text("")
    files = timeline_files.read_timeline_files(spark, str(path))
    skipped = {r["file"]: r["problem"] for r in timeline_files.skipped_files(files).collect()}
    assert skipped.items() >= {"torn.json": "not JSON", "other.json": "not a timeline"}.items() and not skipped.keys() & {"m1.json", "m=202.json", "flat.json"}
    heads = {r["file"]: r for r in timeline_files.timeline_documents(files).collect()}
    assert heads["m1.json"]["speakers"] == ["S1", "S2"] and heads["m1.json"]["notes"] == ["note"] and heads["m1.json"]["span_events"] == 2
    assert heads["m=202.json"]["transcript"] == "" and heads["m=202.json"]["total_events"] == 0 and heads["flat.json"]["duration"] == 9.0 and heads["flat.json"]["total_spans"] == 1
    got = timeline_files.timeline_spans(files).withColumn("rms", F.try_variant_get("audio_features", "$.librosa.rms", "double")).collect()
    assert sorted((r["file"], r["span_no"], r["start"], r["confidence"], r["category"], r["rms"]) for r in got if r["file"] == "m1.json") == [("m1.json", 0, 0.0, 0.5, None, None), ("m1.json", 1, 3.0, None, None, 0.5)]
    assert [(r["start"], r["category"]) for r in got if r["file"] == "flat.json"] == [(1.0, "music")]
    seen = timeline_files.timeline_events(files).withColumn("d", F.to_json("details")).collect()
    assert sorted((r["t"], r["span_no"] if r["span_no"] is not None else -1, r["d"]) for r in seen if r["file"] == "m1.json" and r["d"]) == [
        (0.5, 0, '{"word":"a"}'), (1.5, 0, '{"word":"b"}'), (6.0, -1, '{"n":[1,null]}')]
    assert [(r["t"], r["span_no"], r["d"]) for r in seen if r["file"] == "flat.json"] == [(1.5, None, '{"k":1}')]


def test_timeline_lines_are_moved_once(spark, tmp_path):
    """Commas, counts and sources are seen where the lines of a media are put in order; files in folders are compressed."""
    docs = spark.createDataFrame([("a", None, None, None, None, None, None, None, None), ("b", None, None, None, None, None, None, None, None)],
                                 "media_id string, audio_file string, duration double, transcript string, speakers array<string>, language string, language_confidence double, created_at string, notes array<string>")
    spans = spark.createDataFrame([("a", i, float(i // 2), i + 1.0, "S", f"s{i % 2}", None, None, None) for i in range(5)],
                                  "media_id string, ordinal bigint, start double, end double, description string, source string, confidence double, details string, audio_features string")
    events = spark.createDataFrame([("a", s, float(s // 2), i, 0.5 * (i % 3), "E", "e", None, None) for s in (1, 4) for i in range(4)] +
                                   [(m, None, None, i, 1.0 * i, "E", None, None, None) for m in "ab" for i in range(3)],
                                   "media_id string, span_ordinal bigint, span_start double, ordinal bigint, t double, description string, source string, confidence double, details string")
    lines = timeline_files.timeline_lines(docs, spans, events)
    plan = plan_of(lines)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan, plan
    by_name = timeline_files.timeline_lines(docs, spans, events.drop("span_start")).collect()
    assert sorted(map(str, by_name)) == sorted(map(str, lines.collect()))
    path = str(tmp_path / "tl")
    timeline_files.write_timeline_files(docs, spans, events, path, folders=True)
    assert sorted(p.name for p in (tmp_path / "tl").glob("*/*")) == ["a.json.gz", "b.json.gz"]
    files = {r["file"]: json.loads(r["doc"]) for r in timeline_files.read_timeline_files(spark, path, folders=True).selectExpr("file", "to_json(doc) AS doc").collect()}
    a, b = files["a.json.gz"], files["b.json.gz"]
    assert [(s["start"], s["end"], len(s["events"])) for s in a["timeline_spans"]] == [(0.0, 1.0, 0), (0.0, 2.0, 4), (1.0, 3.0, 0), (1.0, 4.0, 0), (2.0, 5.0, 4)]
    assert [e["timestamp"] for e in a["timeline_spans"][1]["events"]] == [0.0, 0.0, 0.5, 1.0] and [e["timestamp"] for e in a["events"]] == [0.0, 1.0, 2.0]
    counts = ("total_spans", "total_events", "span_events", "standalone_events", "sources_used")
    assert [a["metadata"][n] for n in counts] == [5, 11, 8, 3, ["e", "s0", "s1"]]
    assert [b["metadata"][n] for n in counts] == [0, 3, 0, 3, []] and b["timeline_spans"] == [] and len(b["events"]) == 3
