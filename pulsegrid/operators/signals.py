"""Signal operators as windows and arrays: each series is a key, in order of time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.columns import cv, eccentricity, ordered, seconds
from pulsegrid.functions.kernels import hann


def changes(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "value", name: str = "change") -> DataFrame:
    """Absolute difference to the value before; 0 for the first."""
    return df.withColumn(name, F.coalesce(F.abs(F.col(value) - F.lag(value).over(ordered(keys, order))), F.lit(0.0)))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.withColumn("i", F.row_number().over(ordered(keys, order)) - 1)


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[str], lag: int, value: str = "value") -> DataFrame:
    return df.withColumn("ahead", F.lead(value, lag).over(ordered(keys, order))).where("ahead is not null")


def regularity(df: DataFrame, keys: Sequence[str], order: Sequence[str], lag: int, value: str = "value") -> DataFrame:
    """Per series: correlation with itself `lag` later, and how elongated that portrait is."""
    return lagged(df, keys, order, lag, value).groupBy(*keys).agg(F.corr(value, "ahead").alias("autocorr"), eccentricity(F.col(value), F.col("ahead")).alias("eccentricity"), F.count(F.lit(1)).alias("n"))


def first_run(df: DataFrame, keys: Sequence[str], order: Sequence[str], active: Column, persist: int) -> DataFrame:
    """Per series: where the first run of `persist` active rows starts, and the last active row (counted from 0)."""
    marked = numbered(df.withColumn("active", active), keys, order)
    islands = marked.withColumn("island", F.sum((~F.col("active")).cast("int")).over(ordered(keys, order)))
    runs = islands.where("active").withColumn("nth", F.row_number().over(Window.partitionBy(*keys, "island").orderBy("i")))
    found = runs.groupBy(*keys).agg((F.min(F.when(F.col("nth") == persist, F.col("i"))) - persist + 1).alias("start"), F.max("i").alias("end"))
    return found.where("start is not null and end > start")


def strokes(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str = "value") -> DataFrame:
    """Per series, of strict local maxima and the nearest minima on either side: peaks, and how interval, height, rise and fall vary (times in rows)."""
    w = ordered(keys, order)
    rows = numbered(df, keys, order).withColumns({"prev": F.lag(value).over(w), "next": F.lead(value).over(w)})
    v = F.col(value)
    rows = rows.withColumns({"peak": (v > F.col("prev")) & (v > F.col("next")), "valley": (v < F.col("prev")) & (v < F.col("next"))})
    low = F.when(F.col("valley"), F.struct("i", F.col(value).alias("v")))
    # what follows is looked for from the end: a frame that is open ahead would be read anew for each row
    back = Window.partitionBy(*keys).orderBy(F.desc("i"))
    last_low = lambda window: F.last(low, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, -1))
    tops = rows.withColumn("b", last_low(w)).withColumn("a", last_low(back)).where("peak")
    tops = tops.withColumn("interval", F.col("i") - F.lag("i").over(w))
    height = F.when(F.col("b").isNotNull() & F.col("a").isNotNull(), v - F.least("b.v", "a.v"))
    rise, fall = F.col("i") - F.col("b.i"), F.col("a.i") - F.col("i")
    return tops.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("peaks"), F.coalesce(cv(F.col("interval")), F.lit(0.0)).alias("interval_cv"), F.coalesce(cv(height), F.lit(0.0)).alias("stroke_amp_cv"),
        F.coalesce(F.avg(rise) / (F.avg(fall) + 1e-9), F.lit(0.0)).alias("rise_fall_ratio"), F.coalesce(cv(rise), F.lit(0.0)).alias("rise_time_cv"), F.coalesce(cv(fall), F.lit(0.0)).alias("fall_time_cv"),
    )


def spectrum(df: DataFrame, key: str, samples: str, fps: float, low: float, high: float) -> DataFrame:
    """key, frequency, power of an array of samples without its mean, by the discrete Fourier sum; bins from `low` to `high`."""
    x = F.transform(samples, lambda v: v.cast("double"))
    rows = df.select(key, x.alias("x")).withColumn("n", F.size("x"))
    rows = rows.withColumn("m", F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.col("n")).withColumn("k", F.explode(F.expr("sequence(0, n div 2)")))
    rows = rows.withColumn("frequency", F.col("k") * F.lit(float(fps)) / F.col("n")).where(F.col("frequency").between(low, high))
    angle = lambda j: F.lit(6.283185307179586) * F.col("k") * j / F.col("n")
    part = lambda f: F.aggregate(F.transform("x", lambda v, j: (v - F.col("m")) * f(angle(j))), F.lit(0.0), lambda a, v: a + v)
    re, im = part(F.cos), part(F.sin)
    return rows.select(key, "frequency", (re * re + im * im).alias("power"))


def band_summary(spectra: DataFrame, key: str) -> DataFrame:
    """Per series: power, the frequency of most power (of equals the lowest), natural entropy of the shares."""
    share = F.col("power") / (F.sum("power").over(Window.partitionBy(key)) + F.lit(1e-9))
    return spectra.withColumn("p", share).groupBy(key).agg(F.sum("power").alias("band_power"), F.max_by("frequency", F.struct("power", -F.col("frequency"))).alias("top_hz"), F.sum(-F.col("p") * F.log(F.col("p") + F.lit(1e-12))).alias("entropy"))


def windows(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, hop: int, value: str = "value") -> DataFrame:
    """keys, window (from 0) and samples: the whole windows of `size` rows of each series, one beginning every `hop` rows.

    A row is dealt to the windows that hold it, so no group is larger than a window, however long a series is. A
    window with a null value is left out, as a series that is shorter than a window is.
    """
    first = F.greatest(F.ceil((F.col("i") - (size - 1)) / hop), F.lit(0))
    held = numbered(df, keys, order).select(*keys, "i", F.col(value).cast("double").alias("v"), F.explode(F.when(first <= F.floor(F.col("i") / hop), F.sequence(first, F.floor(F.col("i") / hop)))).alias("window"))
    found = held.groupBy(*keys, "window").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("rows"), F.count("v").alias("n")).where(F.col("n") == size)
    return found.select(*keys, "window", F.col("rows.v").alias("samples"))


def periodograms(held: DataFrame, keys: Sequence[str], size: int, fps: float, tapered: bool = True) -> DataFrame:
    """keys, window, bin, frequency and power of each window (see `windows`) without its mean: its one-sided power density under a Hann taper, or the plain squares of its Fourier sums."""
    weights = hann(size) if tapered else np.ones(size)
    scale = np.ones(size // 2 + 1)
    if tapered:
        scale /= fps * (weights * weights).sum()
        scale[1 : -1 if size % 2 == 0 else None] *= 2
    names = [*keys, "window"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(names)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            power = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * weights, axis=1)) ** 2 * scale
            offsets = pa.array(np.arange(batch.num_rows + 1) * power.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(power.reshape(-1)))], [*names, "powers"])

    kind = T.StructType([*[held.schema[c] for c in names], T.StructField("powers", T.ArrayType(T.DoubleType()))])
    rows = held.select(*names, "samples").mapInArrow(run, kind).select(*names, F.posexplode("powers").alias("bin", "power"))
    return rows.select(*names, "bin", (F.col("bin") * F.lit(float(fps)) / size).alias("frequency"), "power")


def welch(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, fps: float, value: str = "value") -> DataFrame:
    """keys, frequency and power: the mean of the periodograms of a series' half-overlapping windows, as an aggregate over them."""
    held = windows(df, keys, order, size, size - size // 2, value)
    return periodograms(held, keys, size, fps).groupBy(*keys, "bin", "frequency").agg(F.avg("power").alias("power")).drop("bin")


def stability(df: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, hop: int, fps: float, low: float, high: float, value: str = "value") -> DataFrame:
    """Per series: how the frequency of most power, from `low` to `high`, varies over its windows, and their number."""
    rows = periodograms(windows(df, keys, order, size, hop, value), keys, size, fps, tapered=False).where(F.col("frequency").between(low, high))
    tops = rows.groupBy(*keys, "window").agg(F.max_by("frequency", F.struct("power", -F.col("frequency"))).alias("top"))
    return tops.groupBy(*keys).agg(F.stddev_pop("top").alias("freq_stability_std"), F.count(F.lit(1)).alias("windows"))


def variance_mask(df: DataFrame, key: str, cell: str, value: str, factor: float = 0.5) -> DataFrame:
    """Per series: the share of its cells whose variance is above `factor` times the cells' mean variance."""
    cells = df.groupBy(key, cell).agg(F.var_pop(value).alias("v"))
    mean = cells.groupBy(key).agg(F.avg("v").alias("m"))
    return cells.join(mean, key).groupBy(key).agg(F.avg((F.col("v") > F.col("m") * factor).cast("double")).alias("active_fraction"), F.count(F.lit(1)).alias("cells"))


#: Rows of a series that are folded at once.
CHUNK = 256


def hysteresis(df: DataFrame, keys: Sequence[str], order: Sequence[str], active: Column, top: int = 5) -> DataFrame:
    """keys, order and `level`: up by one on an active row, down on another, within 0 and `top`; and `motion` where it is `top`.

    What a chunk of rows does to a level x is min(max(x + a, lo), hi), with lo and hi what becomes of 0
    and of `top`. Chunks are folded by themselves, then CHUNK of their (a, lo, hi) at a time: no row grows with a series.
    """
    clamp = lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(top))
    rows = numbered(df, keys, order).withColumn("chunk", F.expr(f"i div {CHUNK}"))
    chunks = rows.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list(F.struct("i", F.when(active, F.lit(1)).otherwise(F.lit(-1)).alias("step"), *[o for o in order if o not in keys]))).alias("rows"))
    run = lambda start: F.aggregate("rows", start, lambda x, r: clamp(x + r["step"]))
    chunks = chunks.withColumns({"a": F.aggregate("rows", F.lit(0), lambda x, r: x + r["step"]), "lo": run(F.lit(0)), "hi": run(F.lit(top))})
    after = lambda x, c: F.least(F.greatest(x + c["a"], c["lo"]), c["hi"])
    # summaries of CHUNK summaries, level by level, until one is left of each series; then starts go down again
    levels, most = [], chunks.agg(F.max("chunk")).first()[0] or 0
    lower = chunks.select(*keys, "chunk", "a", "lo", "hi")
    while True:
        up = lower.groupBy(*keys, F.expr(f"chunk div {CHUNK}").alias("up")).agg(F.sort_array(F.collect_list(F.struct("chunk", "a", "lo", "hi"))).alias("cs"))
        levels.append(up)
        if (most := most // CHUNK) == 0:
            break
        fold = lambda start: F.aggregate("cs", start, after)
        lower = up.select(*keys, F.col("up").alias("chunk"), F.aggregate("cs", F.lit(0), lambda x, c: x + c["a"]).alias("a"), fold(F.lit(0)).alias("lo"), fold(F.lit(top)).alias("hi"))
    begun = None
    for up in reversed(levels):
        above = up.withColumn("start", F.lit(0)) if begun is None else up.join(begun.withColumnRenamed("chunk", "up"), [*keys, "up"])
        starts = F.aggregate("cs", F.array("start"), lambda xs, c: F.concat(xs, F.array(after(F.element_at(xs, -1), c))))
        begun = above.select(*keys, F.explode(F.arrays_zip(F.col("cs.chunk").alias("chunk"), F.slice(starts, F.lit(1), F.size("cs")).alias("start"))).alias("x")).select(*keys, "x.chunk", "x.start")
    levels = F.aggregate("rows", F.array("start"), lambda xs, r: F.concat(xs, F.array(clamp(F.element_at(xs, -1) + r["step"]))))
    out = chunks.join(begun, [*keys, "chunk"]).select(*keys, F.explode(F.arrays_zip("rows", F.slice(levels, F.lit(2), F.size("rows")).alias("levels"))).alias("x"))
    return out.select(*keys, *[F.col(f"x.rows.{c}").alias(c) for c in order if c not in keys], F.col("x.levels").alias("level")).withColumn("motion", F.col("level") == top)


def sessions(df: DataFrame, keys: Sequence[str], order: Sequence[str], gap_s: float, longest_s: float | None = None) -> DataFrame:
    """Per series its sessions: rows nearer than `gap_s` to the one before; a session is cut into pieces of `longest_s` from its start."""
    w = ordered(keys, order)
    t = seconds(F.col(order[0]))
    rows = df.withColumn("t", t).withColumn("new", F.coalesce((F.col("t") - F.lag("t").over(w) > gap_s).cast("int"), F.lit(1)))
    rows = rows.withColumn("session", F.sum("new").over(w))
    by = [*keys, "session"]
    if longest_s is not None:
        start = F.min("t").over(Window.partitionBy(*by))
        rows = rows.withColumn("piece", F.floor((F.col("t") - start) / longest_s))
        by.append("piece")
    return rows.groupBy(*by).agg(F.min(order[0]).alias("start"), F.max(order[0]).alias("end"), F.count(F.lit(1)).alias("n"))


def rates(df: DataFrame, keys: Sequence[str], ts: str, width: str) -> DataFrame:
    """Rows in each window of event time."""
    return df.groupBy(*keys, F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("start"), "n")
