"""Hooks for callers' own models, and what stands in for a detector that failed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediatimeline.session import settle, ship


class Detector(Protocol):
    """A source of timeline rows: reads media rows, gives event rows tagged with its source."""

    source: str

    def detect(self, media: DataFrame) -> DataFrame: ...


def run_detectors(media: DataFrame, detectors: list[Detector]) -> dict[str, DataFrame]:
    """Event rows of each detector by source tag; two detectors must not share one."""
    out: dict[str, DataFrame] = {}
    for d in detectors:
        if d.source in out:
            raise ValueError(f"two detectors are tagged {d.source!r}")
        out[d.source] = d.detect(media)
    return out


LABELS = "label string, confidence double, probabilities map<string,double>"
FAILURE = "error_type string, error_message string"


def _labelled(windows: DataFrame, load: Callable[[], Any], predict: Callable[[Any, pd.DataFrame], pd.DataFrame], columns: list[str],
              keys: tuple[str, ...], capture: bool) -> DataFrame:
    slim = windows.select(*keys, *columns)
    kept = ", ".join(f"{k} {slim.schema[k].dataType.simpleString()}" for k in keys)
    names = ["label", "confidence", "probabilities"]
    failure = ["error_type", "error_message"] if capture else []

    def checked(model: Any, batch: pd.DataFrame) -> pd.DataFrame:
        out = predict(model, batch)
        if len(out) != len(batch):
            raise ValueError(f"{len(out)} predictions for {len(batch)} rows")
        return out

    def runs(model: Any, batch: pd.DataFrame) -> Iterator[tuple[list, Exception | None]]:
        """(values of `names`, None) of each run of rows in order, or (none, exception) of a row that fails alone.

        A run that passes doubles the next one, a run that raises is halved; behind a bad row the next is tried alone.
        """
        at, size = 0, max(1, len(batch) // 2)
        while at < len(batch):
            part = batch.iloc[at:at + size].reset_index(drop=True)
            try:
                out = checked(model, part)
            except Exception as wrong:
                if len(part) > 1:
                    size = len(part) // 2
                    continue
                yield [], wrong
                at, size = at + 1, 1
                continue
            yield [out[n].tolist() for n in names], None
            at, size = at + len(part), 2 * size

    def searched(model: Any, batch: pd.DataFrame) -> pd.DataFrame:
        """Predictions and errors of a batch that raises as a whole, as one frame: a frame a run would be an Arrow batch a run."""
        try:  # rows alike fail alike: side by side, they leave long runs that pass at once
            batch = batch.sort_values(columns, kind="stable", ignore_index=True)
        except TypeError:
            pass  # arrays and maps have no order
        values: list[list] = [[] for _ in names]
        errors: tuple[list, list] = ([], [])
        for found, wrong in runs(model, batch):
            for column, more in zip(values, found if wrong is None else [[None]] * len(names)):
                column.extend(more)
            rows = len(found[0]) if wrong is None else 1
            errors[0].extend([None if wrong is None else type(wrong).__name__] * rows)
            errors[1].extend([None if wrong is None else str(wrong)] * rows)
        return batch[list(keys)].assign(**dict(zip(names, values)), error_type=errors[0], error_message=errors[1])

    def found(model: Any, batch: pd.DataFrame) -> pd.DataFrame:
        if not capture:
            out = checked(model, batch)
        else:
            try:
                out = checked(model, batch).assign(error_type=None, error_message=None)
            except Exception:
                return searched(model, batch)
        own = batch[list(keys)].reset_index(drop=True)
        return pd.concat([own, out[names + failure].reset_index(drop=True)], axis=1)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for batch in batches:
            model = load() if model is None else model
            yield found(model, batch)

    ship(slim.sparkSession)
    return slim.mapInPandas(label, f"{kept}, {LABELS}" + (f", {FAILURE}" if capture else ""))


def apply_model(windows: DataFrame, load: Callable[[], Any], predict: Callable[[Any, pd.DataFrame], pd.DataFrame],
                columns: list[str], keys: tuple[str, ...] = ("media_id", "win")) -> DataFrame:
    """Label windows with a caller's model, loaded once per task and fed whole Arrow batches.

    `predict(model, batch)` returns label, confidence and probabilities in the order of the batch.
    Only the keys and `columns` travel to Python. An exception of the model ends the job.
    """
    return _labelled(windows, load, predict, columns, keys, False)


def try_model(windows: DataFrame, load: Callable[[], Any], predict: Callable[[Any, pd.DataFrame], pd.DataFrame],
              columns: list[str], keys: tuple[str, ...] = ("media_id", "win"), source: str = "model") -> tuple[DataFrame, DataFrame]:
    """(labels, errors): as `apply_model`, but rows on which the model raises become rows of errors.

    A failing batch is halved down to the rows at fault, so all others get their labels. Its rows are sorted by `columns`
    before, so that a bad row costs a call and each run of rows alike the logarithm of a batch. Errors: keys, tool_name,
    error_stage, error_type (class of the exception) and error_message. The model runs once: its output is written to the
    checkpoint folder and read by both results. A model that cannot be loaded still ends the job.
    """
    spark = windows.sparkSession
    # One file may be one task, and a search for bad rows takes many calls: the rows are dealt to all cores first.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    both = settle(_labelled(windows.select(*keys, *columns).repartition(tasks), load, predict, columns, keys, True))
    labels = both.where("error_type is null").drop("error_type", "error_message")
    errors = both.where("error_type is not null").select(
        *keys, F.lit(source).alias("tool_name"), F.lit("predict").alias("error_stage"), "error_type", "error_message")
    return labels, errors


def fallback_rows(media: DataFrame, detected: DataFrame, source: str, key: str = "media_id") -> DataFrame:
    """One low-confidence event for each media without any detected row.

    The duration is guessed from the size: at least 30 seconds. Media: (key, size_bytes).
    """
    missing = media.join(detected.select(key).distinct(), key, "left_anti")
    return missing.select(
        key, F.lit(0.0).alias("t"), F.lit("Analysis unavailable").alias("description"), F.lit(source).alias("source"),
        F.lit(0.1).alias("confidence"), F.greatest(F.lit(30.0), F.col("size_bytes") / 88000.0).alias("duration"))


def register(spark) -> None:
    """Table function `segments_of(duration, length)` for SQL callers: see `fixed_segments`."""
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION segments_of(duration DOUBLE, length DOUBLE)
        RETURNS TABLE (segment BIGINT, start DOUBLE, end DOUBLE)
        RETURN SELECT * FROM inline(transform(
            if(duration > 0, sequence(0L, CAST(ceil(duration / length) AS BIGINT) - 1), array()),
            n -> named_struct('segment', n, 'start', n * length, 'end', least(duration, (n + 1) * length))))""")
