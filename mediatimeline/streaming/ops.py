"""The ordered operators over streams. Each gives, for rows behind the watermark, what the batch form gives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from mediatimeline.session import ship
from mediatimeline.sources.io import RESULTS


def read_results(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Follow a folder of result files."""
    return spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", files_per_batch).json(path)


def media_time(t: Column | str) -> Column:
    """Seconds of media time as a timestamp, for watermarks."""
    t = F.col(t) if isinstance(t, str) else t
    return F.timestamp_micros(F.round(t * 1_000_000).cast("bigint"))


def latest_stage(progress: DataFrame, keys=("batch_id", "item"), seq: str = "seq", stage: str = "stage") -> DataFrame:
    """Current stage of each item (update mode)."""
    return progress.groupBy(*keys).agg(F.max_by(stage, seq).alias("stage"), F.max(seq).alias("seq"))


def sessions(events: DataFrame, ts: str, gap: str, late: str, keys=("media_id",)) -> DataFrame:
    """Sessions of events at most `gap` apart; the end is the last event, not last event + gap."""
    out = events.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap)).agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("events"))
    return out.filter(F.col("end") > F.col("start")).drop("session_window")


def windows(events: DataFrame, ts: str, size: str, step: str, late: str, aggs: dict[str, Column], keys=("media_id",)) -> DataFrame:
    """Aggregates of sliding (or, with step = size, tumbling) windows."""
    out = events.withWatermark(ts, late).groupBy(*keys, F.window(ts, size, step)).agg(*[c.alias(n) for n, c in aggs.items()])
    return out.select(*keys, F.col("window.start").alias("start"), F.col("window.end").alias("end"), *aggs)


def error_rate(rows: DataFrame, ts: str, failed: Column, size: str, late: str, keys=()) -> DataFrame:
    """Rows, errors and percentage of errors per tumbling window."""
    aggs = {"rows": F.count(F.lit(1)), "errors": F.count_if(failed), "error_rate": F.count_if(failed) * 100.0 / F.count(F.lit(1))}
    return windows(rows, ts, size, size, late, aggs, keys)


SLICES = 16  # pieces of the allowed lateness in which waiting rows are kept
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class InOrder(StatefulProcessor):
    """Gives the rows of a key in event-time order once the watermark has passed them; `run` says what becomes of them.

    Rows wait in a map state by slice of time. New rows rewrite the slices they fall into. A timer fires when the watermark
    reaches the earliest waiting row; then the slices behind the watermark are taken out, and at most one is cut in two.
    So a trigger writes new rows, rows that became ready and their slices, whatever else is waiting. A row behind the
    watermark is dropped when it arrives.

    New rows that are `late` or more older than the latest of the trigger wait in one slot (AGED), however many slices they
    span: the watermark is past them after this trigger, so the slot is taken out as a whole. Replaying a long history costs
    two calls to the state store for a key, not two for each slice of its time.
    """

    AGED = -2**62

    carried: str  # schema of what goes from one run to the next
    start: tuple

    def __init__(self, key: str, slice_us: int):
        self.key, self.slice_us, self.late_us = key, max(1000, slice_us), slice_us * SLICES

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", self.carried)
        self.waiting = handle.getMapState("waiting", "slice bigint", "at array<bigint>, ordinal array<bigint>, label array<string>")

    def run(self, carried: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        at, ordinal, label = [], [], []
        for r in rows:
            at.append(r["at"].to_numpy())
            ordinal.append(r["ordinal"].to_numpy())
            label.append(r["label"].to_numpy(dtype=object))
        at, ordinal, label = (np.concatenate(x) if len(x) > 1 else x[0] for x in (at, ordinal, label))
        if at.min() < passed:
            kept = at >= passed
            at, ordinal, label = at[kept], ordinal[kept], label[kept]
        if len(at):
            # The watermark of the next trigger is the latest row of this one, of any key, less `late`: in whole milliseconds.
            numbers = np.where(at < (int(at.max()) // 1000) * 1000 - self.late_us, self.AGED, at // self.slice_us)
            for number in np.unique(numbers).tolist():
                own = numbers == number
                columns = [at[own].tolist(), ordinal[own].tolist(), label[own].tolist()]
                if self.waiting.containsKey((number,)):
                    columns = [[*old, *new] for old, new in zip(self.waiting.getValue((number,)), columns)]
                self.waiting.updateValue((number,), tuple(columns))
            self.handle.registerTimer(int(at.min()) // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        slots = sorted(k[0] for k in self.waiting.keys())
        ready: list[list] = [[], [], []]
        for number in slots:
            if number != self.AGED and number * self.slice_us >= passed:
                self.handle.registerTimer(number * self.slice_us // 1000 + 1)
                break
            columns = [list(c) for c in self.waiting.getValue((number,))]
            if max(columns[0]) < passed:
                self.waiting.removeKey((number,))
                rest = None
            else:
                behind = [x < passed for x in columns[0]]
                rest = [[x for x, b in zip(c, behind) if not b] for c in columns]
                if any(behind):
                    self.waiting.updateValue((number,), tuple(rest))
                    columns = [[x for x, b in zip(c, behind) if b] for c in columns]
                else:
                    columns = [[], [], []]
            for all_of, more in zip(ready, columns):
                all_of.extend(more)
            if rest:
                self.handle.registerTimer(min(rest[0]) // 1000 + 1)
                if number != self.AGED:
                    break
        if ready[0]:
            # Object labels keep null as None.
            ordered = pd.DataFrame({"at": ready[0], "ordinal": ready[1], "label": pd.Series(ready[2], dtype=object)})
            if len(ordered) > 1:
                ordered = ordered.sort_values(["at", "ordinal"], kind="stable", ignore_index=True)
            carried, out = self.run(self.last.get() if self.last.exists() else self.start, ordered)
            self.last.update(carried)
            out.insert(0, self.key, key[0])
            yield out

    def close(self) -> None:
        pass


class Changes(InOrder):
    carried, start = "label string", (None,)

    def run(self, carried: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        labels = rows["label"].astype(object)
        previous = labels.shift(1)
        previous.iloc[0] = carried[0]
        # No row before counts as a null label, as in the batch form: a null behind it is no change.
        changed = ~((labels == previous) | (labels.isna() & previous.isna()))
        out = pd.DataFrame({"ordinal": rows["ordinal"], "label": labels, "prev_label": previous.where(previous.notna(), None)})[changed]
        return (labels.iloc[-1],), out


class Streaks(InOrder):
    carried, start = "streak bigint, tripped boolean", (0, False)

    def __init__(self, key: str, slice_us: int, limit: int):
        super().__init__(key, slice_us)
        self.limit = limit

    def run(self, carried: tuple, rows: pd.DataFrame) -> tuple[tuple, pd.DataFrame]:
        streak, tripped = carried
        bad = (rows["label"] == "true").to_numpy()
        place = np.arange(1, len(bad) + 1)
        good = np.maximum.accumulate(np.where(bad, 0, place))
        streaks = place - good + np.where(good == 0, streak, 0)  # failures since the last success, the carried ones before any
        over = np.logical_or.accumulate(np.r_[tripped, streaks >= self.limit])
        return (int(streaks[-1]), bool(over[-1])), pd.DataFrame({"ordinal": rows["ordinal"], "streak": streaks, "stopped": over[:-1]})


def _slice_us(spark: SparkSession, late: str) -> int:
    """Microseconds of one slice of the allowed lateness."""
    return spark.range(1).select(F.expr(f"unix_micros(timestamp_micros(0) + interval '{late}')")).first()[0] // SLICES


def _in_order(rows: DataFrame, ts: str, late: str, key: str, label: Column, processor: InOrder, output: str) -> DataFrame:
    spark = rows.sparkSession
    ship(spark)
    # The only store that has timers and map states.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind = rows.schema[key].dataType.simpleString()
    slim = rows.withWatermark(ts, late).select(
        key, F.col(ts).alias("_ts"), F.unix_micros(ts).alias("at"), F.col("ordinal").cast("bigint").alias("ordinal"), label.cast("string").alias("label"))
    return slim.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, {output}", "Append", "EventTime")


def label_changes(rows: DataFrame, ts: str, late: str, label: str = "label", key: str = "media_id") -> DataFrame:
    """Rows whose label differs from the last one of the media, in event-time order.

    Rows wait in state until the watermark has passed them, so rows that arrive out of order but in time count in their
    right place. Apply the confidence gate before this, as in the batch form.
    """
    return _in_order(rows, ts, late, key, F.col(label), Changes(key, _slice_us(rows.sparkSession, late)), "ordinal bigint, label string, prev_label string")


def breaker(items: DataFrame, ts: str, late: str, failed: Column, limit: int = 3, key: str = "batch_id") -> DataFrame:
    """Failure streak of each item in event-time order, and whether the batch was stopped before it.

    An item comes out once the watermark has passed it: items of the last `late` are still waiting when the input ends.
    """
    return _in_order(items, ts, late, key, failed, Streaks(key, _slice_us(items.sparkSession, late), limit), "ordinal bigint, streak bigint, stopped boolean")


def run_to_folder(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Process what is there now into `folder`, one sub-folder per batch, and read it back.

    A batch that is run again after a failure overwrites its own sub-folder, so rows appear once.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")
    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
             .foreachBatch(write).trigger(availableNow=True).start())
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows").select(*stream.columns)
