"""Windows over media time and the signal features of a window."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediatimeline.operators.ordered import NO_CUTS, Cuts, Track
from mediatimeline.session import ship

PITCHES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def window_starts(media: DataFrame, size: float, step: float, duration="duration") -> DataFrame:
    """Window rows (win, start, end) of each media: starts strictly before duration - size."""
    count = F.ceil((F.col(duration) - size) / step).cast("bigint")
    rows = media.filter(F.col(duration) > size).withColumn("win", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)))
    return rows.withColumns({"start": F.col("win") * float(step), "end": F.col("win") * float(step) + float(size)})


def sliding_windows(rows: DataFrame, size: float, step: float, duration="duration", t="t") -> DataFrame:
    """List each row under every window that holds it: start <= t < end.

    A row is in at most ceil(size/step) windows, whose numbers follow from its time; no join.
    `duration` is a column of the row. Windows that would pass the end of the media do not exist.
    """
    tt, d = F.col(t), F.col(duration)
    last = F.least(F.floor(tt / step), F.ceil((d - size) / step) - 1).cast("bigint")
    first = F.greatest(F.lit(0), F.floor((tt - size) / step)).cast("bigint")
    listed = rows.filter((d > size) & (first <= last)).withColumn("win", F.explode(F.sequence(first, last)))
    start = F.col("win") * float(step)
    return (listed.withColumns({"win_start": start, "win_end": start + float(size)})
            .filter((F.col("win_start") <= tt) & (tt < F.col("win_end"))))


def tumbling_segments(rows: DataFrame, length: float, min_tail: float, duration="duration", t="t") -> DataFrame:
    """Number the fixed-length segment of each row; a short last segment is dropped."""
    seg = F.floor(F.col(t) / length).cast("bigint")
    covered = F.least(F.col(duration), (seg + 1) * float(length)) - seg * float(length)
    return rows.withColumn("segment", seg).filter(covered > min_tail)


def fixed_segments(media: DataFrame, length: float, truncate: bool = False, duration="duration") -> DataFrame:
    """Equal-length segments, the last one clipped; `truncate` ignores a fraction of a second at the end."""
    whole = F.floor(duration) if truncate else F.col(duration)
    count = F.ceil(whole / length).cast("bigint")
    rows = media.filter(whole > 0).withColumn("segment", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)))
    return rows.withColumns({
        "start": F.col("segment") * float(length),
        "end": F.least(F.col(duration), (F.col("segment") + 1) * float(length))})


def fallback_scenes(media: DataFrame, length: float = 120.0, duration="duration") -> DataFrame:
    """Fixed-length scenes of media whose scene detection failed, numbered from 1 and marked as such."""
    rows = fixed_segments(media, length, duration=duration)
    return rows.withColumns({"scene_id": F.col("segment") + 1, "fallback_method": F.lit("time_based")}).drop("segment")


def equal_parts(media: DataFrame, parts: Column, total: Column | str) -> DataFrame:
    """Cut `total` frames into `parts` segments at whole frames."""
    total = F.col(total) if isinstance(total, str) else total
    rows = media.withColumns({"_n": parts.cast("bigint"), "_total": total}).filter(F.col("_n") > 0)
    rows = rows.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    return rows.withColumns({
        "start_frame": F.floor(F.col("segment") * F.col("_total") / F.col("_n")).cast("bigint"),
        "end_frame": F.floor((F.col("segment") + 1) * F.col("_total") / F.col("_n")).cast("bigint"),
    }).drop("_n", "_total")


def structure_parts(duration="duration", width: float = 30.0) -> Column:
    return F.greatest(F.lit(3), F.floor(F.col(duration) / width))


def rms(x="x") -> Column:
    return F.sqrt(F.avg(F.col(x) * F.col(x)))


def zero_crossings(samples: DataFrame, keys: tuple[str, ...], by: tuple[str, ...] = ("t", "ordinal"), x="x",
                   cuts: Cuts = NO_CUTS) -> DataFrame:
    """Share of samples whose sign differs from the one before, per group."""
    negative = F.col(x) < 0
    track = Track(samples, keys, by, cuts).previous(_before=negative)
    return track.df.groupBy(*keys).agg(
        (F.sum(F.when(F.col("_before") != negative, 1).otherwise(0)) / F.count(F.lit(1))).alias("zcr"))


def normalise(samples: Column | str, dtype: Column | str, channels: int = 1) -> Column:
    """Scale integer samples to -1..1 and average interleaved channels."""
    s = F.col(samples) if isinstance(samples, str) else samples
    kind = F.col(dtype) if isinstance(dtype, str) else dtype
    scaled = F.transform(s, lambda v: F.when(kind == "int16", v / 32768.0).when(kind == "int32", v / 2147483648.0)
                         .when(kind == "uint8", (v - 128.0) / 128.0).otherwise(v.cast("double")))
    if channels == 1:
        return scaled
    frames = F.sequence(F.lit(0), (F.size(s) / channels).cast("int") - 1)
    return F.transform(frames, lambda i: F.aggregate(
        F.slice(scaled, i * channels + 1, F.lit(channels)), F.lit(0.0), lambda a, v: a + v) / channels)


def every_nth(df: DataFrame, index: str, n: Column | int) -> DataFrame:
    n = F.lit(n) if isinstance(n, int) else n
    return df.filter(F.col(index) % F.greatest(F.lit(1), n) == 0)


def frame_number(t: Column | str, fps: Column | str) -> Column:
    t = F.col(t) if isinstance(t, str) else t
    fps = F.col(fps) if isinstance(fps, str) else fps
    return F.floor(t * F.when(fps > 0, fps).otherwise(30.0)).cast("bigint")


def spectrum_features(spectrum: DataFrame, keys: tuple[str, ...], f="f", m="m") -> DataFrame:
    """Centroid and bandwidth of (frequency, magnitude) rows; zero where there is no energy.

    Bandwidth comes from the first two moments, so one pass with map-side sums is enough.
    """
    freq, mag = F.col(f), F.col(m)
    sums = spectrum.groupBy(*keys).agg(
        F.sum(mag).alias("s0"), F.sum(mag * freq).alias("s1"), F.sum(mag * freq * freq).alias("s2"))
    centre = F.when(F.col("s0") > 0, F.col("s1") / F.col("s0")).otherwise(0.0)
    spread = F.when(F.col("s0") > 0, F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("s0") - centre * centre)))
    return sums.select(*keys, centre.alias("centroid"), F.coalesce(spread, F.lit(0.0)).alias("bandwidth"))


def _equal_lengths(windows: pd.Series):
    """(positions, matrix) of the windows of each length."""
    lengths = windows.map(len).to_numpy()
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, np.array([windows.iloc[i] for i in at], dtype=float).reshape(len(at), n)


def spectral_features(sample_rate: float):
    """Pandas UDF: samples of one window -> struct(centroid, bandwidth, rolloff at 85 %); windows of one length at a time."""
    ship(SparkSession.getActiveSession())

    @F.pandas_udf("centroid double, bandwidth double, rolloff double")
    def features(windows: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(windows), 3))
        for at, x in _equal_lengths(windows):
            half = x.shape[1] // 2
            if half == 0:
                continue
            m = np.abs(np.fft.rfft(x, axis=1))[:, :half]
            f = np.arange(half) * (sample_rate / x.shape[1])
            total = m.sum(axis=1)
            loud = total > 0
            m, total = m[loud], total[loud]
            c = (m * f).sum(axis=1) / total
            spread = np.sqrt((m * (f - c[:, None]) ** 2).sum(axis=1) / total)
            below = (np.cumsum(m, axis=1) < 0.85 * total[:, None]).sum(axis=1)
            out[at[loud]] = np.column_stack([c, spread, f[np.minimum(below, half - 1)]])
        return pd.DataFrame(out, columns=["centroid", "bandwidth", "rolloff"])

    return features


def f0_autocorr(sample_rate: float, low: float = 50.0, high: float = 400.0):
    """Pandas UDF: fundamental frequency from the best autocorrelation lag; 0 for short windows."""
    first, stop = int(sample_rate / high), int(sample_rate / low)
    ship(SparkSession.getActiveSession())

    @F.pandas_udf("double")
    def f0(windows: pd.Series) -> pd.Series:
        out = np.zeros(len(windows))
        for at, x in _equal_lengths(windows):
            if stop < x.shape[1]:
                spectrum = np.fft.rfft(x, 2 * x.shape[1], axis=1)
                corr = np.fft.irfft(spectrum * np.conj(spectrum), axis=1)[:, first:stop]
                out[at] = sample_rate / (corr.argmax(axis=1) + first)
        return pd.Series(out)

    return f0


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def short_spectral_features(windows: DataFrame, samples: str, sample_rate: float, out: str = "s") -> DataFrame:
    """`windows` with struct(centroid, bandwidth, rolloff at 85 %) of the samples, by array functions alone.

    The same numbers as `spectral_features`, from the plain Fourier sums: for windows of up to some hundred samples, whose
    square is cheaper than a trip to Python. Null samples count as zero, null windows give zeros.
    """
    x = F.transform(F.coalesce(F.col(samples).cast("array<double>"), F.array().cast("array<double>")), lambda v: F.coalesce(v, F.lit(0.0)))
    n = F.size("_x")

    def part(k: Column, wave) -> Column:
        return _total(F.transform("_x", lambda v, i: v * wave(F.try_divide(k * i * (2 * math.pi), n))))

    def magnitude(k: Column) -> Column:
        re, im = part(k, F.cos), part(k, F.sin)
        return F.sqrt(re * re + im * im)

    half = F.floor(n / 2).cast("int")
    spectrum = F.when(half > 0, F.transform(F.sequence(F.lit(0), half - 1), magnitude)).otherwise(F.array().cast("array<double>"))
    step = F.try_divide(F.lit(sample_rate), n)
    total, centre = F.col("_total"), F.col("_centre")
    framed = windows.withColumn("_x", x).withColumn("_m", spectrum).withColumn("_total", _total(F.col("_m")))
    framed = framed.withColumn("_centre", F.try_divide(_total(F.transform("_m", lambda m, k: m * k)) * step, total))
    spread = F.sqrt(F.try_divide(_total(F.transform("_m", lambda m, k: m * F.pow(k * step - centre, 2.0))), total))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("below"))
    below = F.aggregate("_m", start, lambda a, m: F.struct(
        (a["sum"] + m).alias("sum"), (a["below"] + F.when(a["sum"] + m < total * 0.85, 1).otherwise(0)).alias("below")))["below"]
    loud = total > 0
    found = F.struct(*[F.when(loud, c).otherwise(0.0).alias(name) for name, c in (
        ("centroid", centre), ("bandwidth", spread), ("rolloff", F.least(below, half - 1) * step))])
    return framed.withColumn(out, found).drop("_x", "_m", "_total", "_centre")


def short_f0(windows: DataFrame, samples: str, sample_rate: float, low: float = 50.0, high: float = 400.0, out: str = "f0") -> DataFrame:
    """`windows` with the fundamental frequency by the best autocorrelation lag, by array functions alone; 0 for short windows."""
    first, stop = int(sample_rate / high), int(sample_rate / low)
    x = F.transform(F.coalesce(F.col(samples).cast("array<double>"), F.array().cast("array<double>")), lambda v: F.coalesce(v, F.lit(0.0)))

    def at(lag: Column) -> Column:
        return _total(F.zip_with(F.slice("_x", F.lit(1), F.size("_x") - lag), F.slice("_x", lag + 1, F.size("_x") - lag), lambda a, b: a * b))

    # The smallest lag of several best ones.
    best = F.array_max(F.transform(F.sequence(F.lit(first), F.lit(stop - 1)), lambda lag: F.struct(at(lag).alias("c"), (-lag).alias("lag"))))
    framed = windows.withColumn("_x", x)
    return framed.withColumn(out, F.when(F.size("_x") > stop, F.lit(sample_rate) / -best["lag"]).otherwise(0.0)).drop("_x")


def dominant_pitch(frames: DataFrame, keys: tuple[str, ...], vector: str = "chroma") -> DataFrame:
    """Mean of each of the 12 pitch classes per group, and the strongest (lowest index on a tie)."""
    means = frames.groupBy(*keys).agg(*[F.avg(F.col(vector)[i].cast("double")).alias(f"p{i}") for i in range(len(PITCHES))])
    values = F.array(*[F.col(f"p{i}") for i in range(len(PITCHES))])
    index = F.array_position(values, F.array_max(values)) - 1
    names = F.array(*[F.lit(p) for p in PITCHES])
    return means.select(*keys, index.cast("int").alias("pitch_class"),
                        F.element_at(names, (index + 1).cast("int")).alias("key_name"))


def savgol_weights(window: int = 51, degree: int = 3) -> np.ndarray:
    """Row i holds the weights that give the fitted polynomial at position i of the window."""
    x = np.arange(window) - window // 2
    design = np.vander(x, degree + 1, increasing=True).astype(float)
    return design @ np.linalg.pinv(design)


def smooth_savgol(df: DataFrame, value: str, window: int = 51, degree: int = 3, keys: tuple[str, ...] = ("media_id",),
                  by: tuple[str, ...] = ("t", "ordinal"), cuts: Cuts = NO_CUTS, name: str = "smoothed") -> DataFrame:
    """Polynomial smoothing along each group; groups no longer than the window stay as they are.

    Rows are numbered, and the windows of the whole group are sums over an equi-join of
    overlapping blocks of `window` rows: each block of rows is gathered with its two
    neighbours, so a task holds three blocks whatever the length of the group.
    """
    half = window // 2
    weights = savgol_weights(window, degree)
    track = Track(df, keys, by, cuts).number("_n").overall(_size=F.count(F.lit(1)))
    rows = track.df.withColumn("_block", F.floor((F.col("_n") - 1) / window))
    # Each row goes to its own block and to both neighbouring ones.
    item = F.struct(F.col("_n"), F.col(value).cast("double").alias("v"))
    spread = rows.select(*keys, F.explode(F.array(F.col("_block") - 1, F.col("_block"), F.col("_block") + 1)).alias("_block"),
                         item.alias("_item"))
    blocks = spread.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list("_item")).alias("_near"))
    joined = rows.join(blocks, [*keys, "_block"])
    first_n = F.col("_near")[0]["_n"]
    # Start of the fitted window: centred, but kept inside the group.
    start = F.greatest(F.lit(1), F.least(F.col("_n") - half, F.col("_size") - (window - 1)))
    near = F.slice(F.col("_near"), (start - first_n + 1).cast("int"), F.lit(window))
    position = (F.col("_n") - start).cast("int")
    centre = F.array(*[F.lit(float(w)) for w in weights[half]])
    edges = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in weights])
    chosen = F.when(position == half, centre).otherwise(F.get(edges, position))
    fitted = F.aggregate(F.zip_with(near, chosen, lambda r, w: r["v"] * w), F.lit(0.0), lambda a, v: a + v)
    smoothed = F.when(F.col("_size") <= window, F.col(value).cast("double")).otherwise(fitted)
    return joined.withColumn(name, smoothed).drop("_n", "_size", "_block", "_near")
