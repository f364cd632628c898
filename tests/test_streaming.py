"""Streams that arrive shuffled give what the batch form gives for rows behind the watermark."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from mediatimeline.operators import change, intervals
from mediatimeline.streaming import ops

SCHEMA = "media_id int, ordinal bigint, t double, label string, at timestamp"


def write(spark, rows, folder, order):
    """One file per slice, in the order they should arrive."""
    for n, part in enumerate(order):
        df = spark.createDataFrame([rows[i] for i in part], "media_id int, ordinal bigint, t double, label string").coalesce(1)
        df = df.withColumn("at", F.timestamp_seconds(F.lit(1704067200) + F.col("t")))
        tmp = f"{folder}-tmp-{n}"
        df.write.parquet(tmp)
        os.makedirs(folder, exist_ok=True)
        name = next(f for f in os.listdir(tmp) if f.endswith(".parquet"))
        target = f"{folder}/{n:03d}.parquet"
        os.rename(f"{tmp}/{name}", target)
        os.utime(target, (1_700_000_000 + n, 1_700_000_000 + n))


@pytest.fixture(scope="module")
def replay(spark, tmp_path_factory):
    rng = random.Random(11)
    rows = [(rng.randint(1, 2), i, i * 10.0 + rng.choice([0.0, 3.0]), rng.choice("EEo")) for i in range(120)]
    jitter = sorted(range(120), key=lambda i: i + rng.uniform(-4, 4))  # at most about 80 s out of order
    order = [jitter[i:i + 20] for i in range(0, 120, 20)]
    folder = str(tmp_path_factory.mktemp("s") / "in")
    write(spark, rows, folder, order)
    return rows, folder


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def out(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


def batch(spark, rows):
    df = spark.createDataFrame(rows, "media_id int, ordinal bigint, t double, label string")
    return df, max(r[2] for r in rows) - 100  # rows at or before this are behind a 100 s watermark


def test_label_changes(spark, replay, tmp_path):
    rows, folder = replay
    df, limit = batch(spark, rows)
    got = ops.run_to_folder(ops.label_changes(stream(spark, folder), "at", "100 seconds"), out(tmp_path)).collect()
    want = change.gated_label_change(df.withColumn("confidence", F.lit(1.0)), above=0.5).filter(F.col("t") < limit)
    assert sorted((r["media_id"], r["ordinal"], r["label"], r["prev_label"]) for r in got) == \
        sorted((r["media_id"], r["ordinal"], r["label"], r["prev_label"]) for r in want.collect())


def test_breaker(spark, replay, tmp_path):
    rows, folder = replay
    df, limit = batch(spark, rows)
    result = ops.breaker(stream(spark, folder), "at", "100 seconds", F.col("label") == "E", key="media_id")
    got = ops.run_to_folder(result, out(tmp_path)).collect()
    want = change.circuit_breaker(df, F.col("label") == "E", keys=("media_id",), by=("t", "ordinal")).filter(F.col("t") < limit)
    assert sorted((r["media_id"], r["ordinal"], r["streak"], r["stopped"]) for r in got) == \
        sorted((r["media_id"], r["ordinal"], r["streak"], r["stopped"]) for r in want.collect())


def test_sessions(spark, replay, tmp_path):
    rows, folder = replay
    df, limit = batch(spark, rows)
    got = ops.run_to_folder(ops.sessions(stream(spark, folder), "at", "20 seconds", "100 seconds"), out(tmp_path))
    got = [(r["media_id"], r["s"], r["e"], r["events"]) for r in got.select("media_id", F.unix_timestamp("start").alias("s"), F.unix_timestamp("end").alias("e"), "events").collect()]
    want = intervals.sessions(df, gap=20.0).filter(F.col("end") + 20 <= limit).collect()
    base = 1704067200
    assert sorted(got) == sorted((r["media_id"], base + int(r["start"]), base + int(r["end"]), r["events"]) for r in want)


def test_latest_stage(spark, replay, tmp_path):
    rows, folder = replay
    got = ops.run_to_folder(ops.latest_stage(stream(spark, folder), ("media_id",), "ordinal", "label"), out(tmp_path), "update")
    last = {}
    for m, o, _, label in rows:
        last[m] = max(last.get(m, (-1, "")), (o, label))
    assert {r["media_id"]: (r["seq"], r["stage"]) for r in got.groupBy("media_id").agg(F.max("seq").alias("seq"), F.max_by("stage", "seq").alias("stage")).collect()} == last


def test_late_row_is_dropped(spark, tmp_path):
    rows = [(1, 0, 0.0, "a"), (1, 1, 500.0, "b"), (1, 2, 10.0, "z"), (1, 3, 1000.0, "c")]
    folder = str(tmp_path / "in")
    write(spark, rows, folder, [[0, 1], [2], [3]])
    got = ops.run_to_folder(ops.label_changes(stream(spark, folder), "at", "50 seconds"), out(tmp_path)).collect()
    assert sorted((r["ordinal"], r["label"]) for r in got) == [(0, "a"), (1, "b")]


def test_results_stream(spark, tmp_path):
    folder = tmp_path / "results"
    os.makedirs(folder)
    (folder / "a.jsonl").write_text('{"filename":"x","success":true}\n{"filename":"y","success":false}\n')
    got = ops.run_to_folder(ops.read_results(spark, str(folder)), out(tmp_path)).collect()
    assert sorted((r["filename"], r["success"]) for r in got) == [("x", True), ("y", False)]


def test_state_written_per_trigger(spark, tmp_path):
    """A trigger writes the slices of its own rows and of those that became ready, not all that waits."""
    rows = [(1, i, float(i), "ab"[i % 2]) for i in range(4000)]
    folder = str(tmp_path / "in")
    write(spark, rows, folder, [list(range(i, i + 400)) for i in range(0, 4000, 400)])
    seen = []
    result = ops.label_changes(stream(spark, folder), "at", "3200 seconds")  # nearly all rows wait; a slice is 200 s
    query = (result.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c"))
             .foreachBatch(lambda df, n: seen.append(df.count())).trigger(availableNow=True).start())
    query.awaitTermination()
    written = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]]
    assert sum(seen) == 799 and len(written) >= 10  # rows before second 3999 - 3200
    assert max(written) <= 2 * (400 // 200 + 2) + 4  # two slices of new rows, two or three that are taken out, the last label, a timer


def test_replay_of_a_long_history(spark, tmp_path):
    """Rows far behind the latest of their trigger wait in one slot, however long their time is; results stay the same."""
    rows = [(1 + i % 2, i, float(i), "ab"[i // 2 % 2]) for i in range(4000)]
    folder = str(tmp_path / "in")
    write(spark, rows, folder, [list(range(3999, -1, -1))])
    result = ops.label_changes(stream(spark, folder), "at", "100 seconds")  # a slice is 6.25 s
    got = []
    query = (result.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c"))
             .foreachBatch(lambda df, n: got.extend(r["ordinal"] for r in df.collect())).trigger(availableNow=True).start())
    query.awaitTermination()
    assert sorted(got) == [i for i in range(4000) if i < 3899]
    written = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["stateOperators"]]
    assert max(written) <= 2 * (ops.SLICES + 6)
