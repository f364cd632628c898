"""Row rules, classifiers and texts on hand-made rows."""

import random
import time

import pytest
from pyspark.sql import functions as F

from mediatimeline.functions import render, rows, rules
from mediatimeline.operators import combine, library, rollups
from mediatimeline.session import settle


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()["x"]


def test_invented_against_loop(spark):
    texts = ["bye bye", "Thank you for watching", "hello there", "please subscribe", "  ", None, "see you next time, bye", "the end of the channel"]
    cases = [(i, t, p / 20, lp) for i, (t, p, lp) in enumerate((t, p, lp) for t in texts for p in range(0, 21) for lp in (-1.01, -1.0, 0.0, None))]
    df = spark.createDataFrame(cases, "i int, text string, no_speech_prob double, avg_logprob double")
    got = {r["i"] for r in rows.drop_invented(df).collect()}

    def invented(t, p, lp):
        c = 1.0 - p
        if c < 0.3 or (lp or 0) < -1.0:
            return True
        for phrase in rows.INVENTED_PHRASES:
            if phrase in (t or "").strip().lower():
                c -= 0.35 if len(phrase) > 10 else 0.15
                if c < 0.5:
                    return True
        return False
    exact = {c[0] for c in cases if not invented(*c[1:])}
    # Sums of several penalties may differ in the last bit exactly at one half.
    assert len(got ^ exact) <= 4


def test_constructors_and_details(spark):
    df = spark.createDataFrame([(1, 0, 1.239, "foo_bar", 1.0), (1, 1, 2.0, "tempo_change", 0.999)], "media_id int, ordinal bigint, t double, kind string, confidence double")
    got = rows.make_events(df, "s").orderBy("ordinal").collect()
    assert [(r["t"], r["description"], r["confidence"]) for r in got] == [(1.24, "Foo Bar", None), (2.0, "Tempo Change", 1.0)]
    details = F.create_map(*[F.lit(x) for x in ("a", None, "b", "", "c", "0", "d", "0.0", "e", "False", "f", "x", "g", "-1")])
    assert one(spark, rows.clean_details(details)) == {"f": "x", "g": "-1"}


@pytest.mark.parametrize("t, text", [(59.99, "[00:59.99]"), (60.0, "[01:00.00]"), (3600.0, "[60:00.00]"), (0.0, "[00:00.00]"), (6001.25, "[100:01.25]")])
def test_clock(spark, t, text):
    assert one(spark, render.clock(F.lit(t))) == text


LINES = [
    ("Speaker Change", "whisper_voice", {}, None),
    ("Word", "whisper_voice", {"word": "hi", "speaker": "A"}, "[00:01.00] - [A] hi"),
    ("Word", "whisper_voice", {}, "[00:01.00] - [UNKNOWN] "),
    ("a man walks", "internvl3", {}, "[00:01.00] - [VLM] a man walks"),
    ("Emotion Change", "p", {"emotion": "calm"}, "[00:01.00] - (p) Emotion Change: unknown -> calm"),
    ("Musical Onset", "p", {}, "[00:01.00] - (p) Musical Onset: N/A"),
    ("Harmonic Shift", "p", {"previous_key": "C"}, "[00:01.00] - (p) Harmonic Shift: C -> ?"),
    ("Tempo Change", "p", {"previous_tempo": "119.9"}, "[00:01.00] - (p) Tempo Change: 119 BPM -> 0 BPM"),
    ("Other", "p", {}, "[00:01.00] - (p) Other"),
]


def test_event_lines(spark):
    df = spark.createDataFrame([(i, 1.0, d, s, m) for i, (d, s, m, _) in enumerate(LINES)], "i int, t double, description string, source string, details map<string,string>")
    assert [r["l"] for r in df.select("i", render.event_line().alias("l")).orderBy("i").collect()] == [x[3] for x in LINES]


def test_documents(spark):
    events = spark.createDataFrame([(1, 0, 2.0, "B", "p", {}), (1, 1, 1.0, "A", "p", {}), (1, 2, 3.0, "C", "p", {})],
                                   "media_id int, ordinal bigint, t double, description string, source string, details map<string,string>")
    media = spark.createDataFrame([(1, "m1", "hello"), (2, "m2", "")], "media_id int, name string, transcript string")
    docs = {r["media_id"]: r["document"] for r in combine.knowledge_document(events, media).collect()}
    assert docs[1] == ("# Summary for video: m1.mp4\n\n## Full Transcript\nhello\n\n## Detailed Event Timeline\n\n"
                       "[00:01.00] - (p) A\n[00:02.00] - (p) B\n[00:03.00] - (p) C")
    assert docs[2] == "# Summary for video: m2.mp4\n\n## Detailed Event Timeline\n"
    parts = combine.knowledge_document(events, media, part_rows=2).filter("media_id = 1").orderBy("part").collect()
    assert "\n".join(p["document"] for p in parts) == docs[1]
    with pytest.raises(ValueError):
        combine.combine_timelines([])


SOUND = [
    (0.31, 3001, 0.0, "high_frequency_transient"), (0.3, 3001, 0.2, "background"), (0.2, 2500, 0.16, "noisy_transient"),
    (0.151, 1499, 0.15, "low_frequency_impact"), (0.1, 2500, 0.11, "speech"), (0.15, 1500, 0.0, "music"), (0.1, 1600, 0.0, "background"),
]


def test_sound_rules(spark):
    df = spark.createDataFrame([(i, float(e), float(c), float(z)) for i, (e, c, z, _) in enumerate(SOUND)], "i int, energy double, centroid double, zcr double")
    got = [r["v"]["label"] for r in df.select("i", rules.classify_sound().alias("v")).orderBy("i").collect()]
    assert got == [x[3] for x in SOUND]


def test_text_rules(spark):
    def score(text):
        return round(one(spark, rules.text_confidence(F.lit(text))), 6)
    assert score("short") == 0.2 and score("x" * 20) == 0.5 and score("x" * 101) == 0.7
    assert score("a person near an object in some environment") == 0.65
    assert score("analysis failed: no person found") == 0.275
    assert one(spark, rules.scene_similarity(F.lit("SAME_SCENE 85"))) == 0.85
    assert one(spark, rules.scene_similarity(F.lit("same_scene"))) == 0.8
    assert one(spark, rules.scene_similarity(F.lit("DIFFERENT 0.9"))) == 0.2
    for text, want in (("0.4 or so", 0.4), ("very similar", 0.9), ("similar", 0.7), ("different", 0.3), ("hm", 0.5), ("70", 0.7)):
        assert one(spark, rules.frame_similarity(F.lit(text))) == want
    assert one(spark, rules.classify_error(F.lit("CUDA out of memory"), "gpu")) == "gpu_memory"
    assert one(spark, rules.classify_error(F.lit("CUDA out of memory"))) == "gpu_error"
    assert one(spark, rules.classify_error(F.lit("nothing"), "scene")) == "unknown"


def test_batch_state(spark):
    items = spark.createDataFrame([(1, 0, "failed", "s", "e"), (1, 1, "in_progress", "s", None), (1, 2, "completed", "s", None)],
                                  "batch_id int, item int, status string, current_stage string, error string")
    batches = spark.createDataFrame([(1, "processing")], "batch_id int, status string")
    fixed, paused = rollups.recover_interrupted(items, batches)
    assert [(r["status"], r["current_stage"]) for r in fixed.orderBy("item").collect()] == [("failed", "s"), ("pending", None), ("completed", "s")]
    assert paused.first()["status"] == "paused"
    assert [(r["status"], r["error"]) for r in rollups.retry_failed(items).orderBy("item").collect()] == [("pending", None), ("in_progress", None), ("completed", None)]
    updates = spark.createDataFrame([(1, 0, 1, "a", None), (1, 0, 2, None, "y"), (1, 0, 3, "b", None)], "batch_id int, item int, seq int, current_stage string, error string")
    got = rollups.apply_updates(items, updates, ("current_stage", "error")).filter("item = 0").first()
    assert (got["current_stage"], got["error"]) == ("b", "y")


def _crossed(spark, rows, threshold, weights):
    """(members, pairs) of the operator, and of comparing all pairs of sets."""
    members, pairs = library.cross_references(spark.createDataFrame(rows, "media_id string, scene int, field string, term string"), threshold, weights)
    ids = {(r["media_id"], r["scene"]): r["set_id"] for r in members.collect()}
    found = {frozenset((bytes(r["left_id"]), bytes(r["right_id"]))): (r["shared_terms"], r["similarity"]) for r in pairs.collect()}
    sets, media = {}, {}
    for m, s, f, t in rows:
        sets.setdefault((m, s), set()).add((f, t))
    for key, own in sets.items():
        media.setdefault(frozenset(own), set()).add(key[0])
    named = {frozenset(own): bytes(ids[key]) for key, own in sets.items()}
    want = {}
    for a in media:
        for b in media:
            def weight(x):
                return sum(weights.get(f, 1) for f, _ in x)
            j = weight(a & b) / weight(a | b)
            if a != b and j >= threshold and len(media[a] | media[b]) > 1:
                want[frozenset((named[a], named[b]))] = (len(a & b), j)
    assert set(ids) == set(sets) and all((named[frozenset(sets[x])] == bytes(ids[x])) for x in sets)
    return found, want


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_cross_references_against_all_pairs(spark, threshold):
    rng = random.Random(2)
    rows = []
    for i in range(90):
        own = {("text", f"w{rng.randint(0, 25)}") for _ in range(rng.randint(1, 6))} | ({("text", "everywhere")} if i % 3 else set())
        own |= {("speaker", f"s{rng.randint(0, 3)}")} if i % 2 else set()
        own |= {("object", x) for x in rng.sample(["person", "laptop", "board"], i % 3)}
        rows += [(f"m{i % 4}", i, f, t) for f, t in own]
    rows += [("m9", 5, f, t) for m, s, f, t in rows if s == 5]  # the same set in another media
    rows += [(None, 1, "text", "w1"), (None, 1, "text", "w2"), (None, 2, "text", "w1"), ("m0", 300, "text", "w1"), ("m0", 300, "text", "w1")]
    found, want = _crossed(spark, rows, threshold, {"object": 3, "speaker": 2})
    assert found == want and (want or threshold > 0.7)


def test_cross_references_of_long_sets(spark):
    """Long sets of one vocabulary meet everywhere; almost only similar ones are compared in full."""
    rng = random.Random(4)
    rows, base = [], [f"t{i}" for i in range(900)]
    for i in range(60):
        own = set(rng.sample(base, rng.randint(150, 400))) if i % 4 else set(base[i:i + 300]) - set(rng.sample(base, 30))
        rows += [(f"m{i % 5}", i, "text", t) for t in own]
    found, want = _crossed(spark, rows, 0.5, {})
    assert found == want and want
    marked = library.marked_sets(library.term_sets(spark.createDataFrame(rows, "media_id string, scene int, field string, term string"))[1])
    assert library.candidate_pairs(marked, 0.5).count() <= 1.5 * len(want) + 20


def test_marks(spark):
    for n in (0, 1, 5, 300):
        hashes = [random.Random(n).randrange(-2**63, 2**63) for _ in range(n)] + [7, 7]
        want = [0] * 16
        for h in hashes:
            want[(h >> 6) & 15] |= 1 << (h & 63)
        got = spark.createDataFrame([(hashes,)], "hashes array<long>").select(library._bits(F.lit(16)).alias("b")).first()["b"]
        assert [x & (2**64 - 1) for x in got] == want
    row = spark.createDataFrame([([1, 2, 4, 8], [3, 14])], "a array<long>, b array<long>")
    assert row.select(library._differing("a", "b").alias("d"), library._differing("b", "a").alias("e")).first()[:] == ((5 ^ 3).bit_count() + (10 ^ 14).bit_count(),) * 2


def test_terms_are_keywords(spark):
    df = spark.createDataFrame([(1, 1, "The Cat, the cat (a) x2!", None), (1, 2, "", "and Äpfel")], "media_id int, scene_id int, a string, b string")
    got = {(r["scene_id"], r["term"]) for r in library.searchable_terms(df, ("a", "b")).collect()}
    assert got == {(1, "cat"), (1, "x2"), (2, "äpfel")}
    assert one(spark, library.keywords(F.lit("The Cat, the cat (a) x2!"))) == ["cat", "x2"]


def test_index_parts(spark):
    df = spark.createDataFrame([(m, s, "t") for m in range(20) for s in range(10)], "media_id int, scene_id int, term string")
    parts = library.master_index(df, "topic", parts=4).collect()
    assert len(parts) > 1 and sum(len(p["postings"]) for p in parts) == 200


def test_index_append(spark):
    """An index grown in steps has the postings of one made at once, in bounded blocks that don't overlap; few blocks are rewritten."""
    rng = random.Random(1)
    rows = [(f"m{s % 40:02d}", s, "topic", t) for s in range(2000) for t in ["all", *rng.sample("abcdef", 2)]] + [("m00", 0, "object", "all"), ("m00", 0, "topic", "all")]
    df = spark.createDataFrame(rows, "media_id string, scene int, field string, term string")
    index = settle(library.posting_blocks(df.where("media_id <> 'm07' and media_id <> 'm00'"), 50))
    blocks, replaced = library.append_postings(index, df.where("media_id = 'm07'"), 50)
    assert replaced.count() < index.count() / 4
    grown = settle(library.with_appended(index, df.where("media_id = 'm07'"), 50))
    grown = settle(library.with_appended(grown, df.where("media_id in ('m00', 'm07')"), 50))  # one of them again
    want = {}
    for m, s, f, t in rows:
        want.setdefault((f, t), set()).add((m, s))
    got = {}
    for r in sorted(grown.collect(), key=lambda r: (r["kind"], r["term"], r["first"])):
        own = [tuple(p) for p in r["postings"]]
        assert own == sorted(own) and (own[0], own[-1]) == (tuple(r["first"]), tuple(r["last"])) and 0 < len(own) == r["scenes"] <= 50
        assert not got.get((r["kind"], r["term"])) or got[r["kind"], r["term"]][-1] < own[0]
        got.setdefault((r["kind"], r["term"]), []).extend(own)
    assert got == {k: sorted(v) for k, v in want.items()}


def test_index_append_is_linear(spark):
    """Postings of one term are placed in one pass: no frame runs to the end of its group from each row."""
    df = spark.range(600_000).select(F.lit("m").alias("media_id"), F.col("id").cast("int").alias("scene"), F.lit("topic").alias("field"), F.lit("all").alias("term"))
    index = settle(library.posting_blocks(df.where("scene % 3 <> 0 and scene > 100"), 64))
    start = time.time()
    blocks, replaced = library.append_postings(index, df.where("scene % 3 = 0"), 64)
    assert blocks.agg(F.sum("scenes")).first()[0] == 200_000 + index.agg(F.sum("scenes")).first()[0] and replaced.count() == index.count()
    assert blocks.agg(F.min("first.scene_id")).first()[0] == 0 and time.time() - start < 60


def test_log_and_objects(spark):
    lines = ["2024-01-01 10:00:00 Starting processing: a", "2024-01-01 10:10:00 Processing completed successfully. Processing time: 9.5 minutes",
             "2024-01-02 10:00:00 Starting processing: b", "2024-01-02 10:01:00 Processing failed. Error: CUDA: oom", "no time Processing failed"]
    log = rollups.parse_log(spark.createDataFrame([(x,) for x in lines], "value string"))
    report = {r["day"]: r for r in rollups.log_report(log).collect()}
    assert report[None]["started"] == 2 and report["2024-01-01"]["success_rate"] == 100.0 and report["2024-01-01"]["mean_minutes"] == 9.5
    assert [(r["error"], r["occurrences"]) for r in rollups.top_errors(log).collect()] == [("CUDA", 1)]
    seen = spark.createDataFrame([(1, "a", f, 20) for f in (1, 2, 5, 9, 18)], "media_id int, object_id string, frame bigint, last_frame bigint")
    got = library.appear_disappear(seen).orderBy("visit").collect()
    assert [(r["enters"], r["exits"]) for r in got] == [(1, 8), (9, 12), (18, None)]


def test_error_rate_slides(spark):
    """A burst across midnight counts whole, and a rate that stays up gives one alert."""
    hour = 3600.0
    rows = [(h * hour + i, h in (22, 23, 24, 25) and i < 15) for h in range(0, 100) for i in range(20)]
    rows += [(300 * hour, True), (301 * hour, True), (340 * hour, True)]
    df = spark.createDataFrame(rows, "t double, bad boolean")
    got = [(r["pane"], r["level"]) for r in rollups.error_rate_alerts(df, F.col("bad")).orderBy("pane").collect()]
    want, before, last = [], 0, -100
    for pane in sorted({int(t // hour) for t, _ in rows}):
        window = [bad for t, bad in rows if pane - 24 < t // hour <= pane]
        value = 100.0 * sum(window) / len(window)
        level = 2 if value >= 25 else 1 if value >= 10 else 0
        if level > (before if pane - last < 24 else 0):
            want.append((pane, {1: "warning", 2: "critical"}[level]))
        before, last = level, pane
    assert got == want and got[0] == (25, "warning") and (300, "critical") in got and (301, "critical") not in got and (340, "critical") in got
    assert rollups.error_rate_alerts(df.where("false"), F.col("bad")).collect() == []


def test_sets_of_lists_move_no_row_per_term(spark):
    """Lists of terms give the sets that rows of terms give, also for a scene on several rows, without a row a term."""
    scenes = spark.createDataFrame([("m", 1, "b a a", "x"), ("m", 1, "c", None), ("n", 2, "a c b", "x"), ("n", 3, None, None), (None, 4, "b", None)],
                                   "media_id string, scene int, words string, lang string")
    words = F.split("words", " ")
    lists = library.term_lists(scenes, {"text": words, "topic": F.array("lang")})
    rows = library.scene_terms({"text": scenes.withColumn("term", F.explode(words)), "topic": scenes.withColumn("term", F.col("lang"))})
    named = library.named_sets(lists)
    got = {(r["media_id"], r["scene"]): (r["terms"], r["set_id"]) for r in named.collect()}
    assert got == {(r["media_id"], r["scene"]): (r["terms"], r["set_id"]) for r in library.named_sets(rows).collect()}
    assert len(got) == 3 and got["m", 1] == got["n", 2] and got["m", 1][0] == ["text\x01a", "text\x01b", "text\x01c", "topic\x01x"]
    assert "Generate" not in lists._jdf.queryExecution().toString()


def test_pairs_are_looked_at_where_sets_meet(spark, monkeypatch):
    """No pair is joined with marks, however many meet; sets divided into many blocks give the same pairs."""
    rng = random.Random(6)
    rows, base = [], [f"t{i}" for i in range(3000)]
    for i in range(80):
        own = set(rng.sample(base, rng.randint(300, 1500))) if i % 3 else set(base[i:i + 1200]) - set(rng.sample(base, 200))
        rows += [(f"m{i % 5}", i, "text", t) for t in own]
    monkeypatch.setattr("mediatimeline.operators.pairs.BLOCK_BYTES", 20_000)
    found, want = _crossed(spark, rows, 0.5, {})
    assert found == want and want
    marked = settle(library.marked_sets(library.term_sets(spark.createDataFrame(rows, "media_id string, scene int, field string, term string"))[1]))
    pairs = library.candidate_pairs(marked, 0.5)
    assert pairs.count() <= 1.2 * len(want) and "Join" not in pairs._jdf.queryExecution().toString()


def test_units_are_numbers(spark):
    """Sets and pairs travel with a number for each unit, the same for the same unit of any set, whatever task named it."""
    rows = [(f"m{i % 3}", i, f, f"{f}{(i * k) % (3 + k)}") for i in range(40) for k, f in enumerate(("text", "topic", "speaker", "other"), 1)]
    frame = spark.createDataFrame(rows, "media_id string, scene int, field string, term string").repartition(4)
    members, sets = library.term_sets(frame)
    assert sets.schema["units"].dataType.simpleString() == "array<int>"
    own = {r["scene"]: bytes(r["set_id"]) for r in members.collect()}
    units = {bytes(r["set_id"]): r["units"] for r in sets.collect()}
    terms, seen = {}, {}
    for _, scene, f, t in rows:
        terms.setdefault(scene, set()).add((f, t))
    weights = library.FIELD_WEIGHTS
    for scene, found in terms.items():
        assert len(set(units[own[scene]])) == len(units[own[scene]]) == sum(weights.get(f, 1) for f, _ in found)
        for u in units[own[scene]]:
            seen[u] = seen.get(u, found) & found
    every = set().union(*terms.values())
    assert len(seen) == sum(weights.get(f, 1) for f, _ in every) and all(seen.values())
    few = library.cross_references(frame, 0.4, {"text": 5})[1]
    assert few.schema["shared_terms"].dataType.simpleString() == "int" and few.count() > 0
