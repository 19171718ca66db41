"""Which features stay: by what shuffling them does to the scores, and one of each correlated pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.config import KEEP_OF_PAIR, LEAST_IMPORTANCE, SAME_PAIR
from pulsegrid.functions.tables import pinned


def ensemble_score(df: DataFrame, scores: Sequence[str], name: str = "score") -> DataFrame:
    """The mean of the scores, each brought to 0..1 over all rows; a score without spread stays as it is."""
    row = df.agg(*[f(c).alias(f"{n}_{c}") for c in scores for n, f in (("lo", F.min), ("hi", F.max))]).first()
    parts = []
    for c in scores:
        lo, hi = row[f"lo_{c}"], row[f"hi_{c}"]
        parts.append((F.col(c) - F.lit(lo)) / F.lit(hi - lo) if lo is not None and hi > lo else F.col(c))
    return df.withColumn(name, sum(parts[1:], parts[0]) / len(parts))


def shuffled(number: np.ndarray, n: int, key: int, seed: int, rounds: int = 4) -> np.ndarray:
    """Where each of the numbers below n goes in a permutation of 0 .. n - 1 that hangs on the key: Feistel rounds over the next power of 4, again while a place is n or above."""
    half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    salts = np.random.default_rng((seed, key)).integers(1, 1 << 62, rounds, dtype=np.uint64) | np.uint64(1)
    out = number.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for salt in salts:
            x = (right + salt) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((x >> np.uint64(32)) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def numbered_rows(df: DataFrame, features: Sequence[str]) -> tuple[int, DataFrame]:
    """The number of rows, and `number` (from 0, without gaps) and `x` (the features) of each: its place in its partition and the rows of the partitions before."""
    x = F.array(*[F.col(f).cast("double") for f in features]).alias("x")
    rows = pinned(df.select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"), x), "numbered")
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    before = counts.select("part", "first", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.count(), rows.join(F.broadcast(before), "part").select((F.col("id") - F.col("first") + F.col("before")).alias("number"), "x")


def permutation_importance(df: DataFrame, features: Sequence[str], score: Callable[[np.ndarray], np.ndarray], repeats: int = 30, seed: int = 42) -> DataFrame:
    """Per feature: mean and deviation over `repeats` shuffles of how much the scores of all rows move.

    A shuffle is a permutation of row numbers, computed for each value where it stands; the values that a row
    gets in all shuffles (features * repeats of them) meet there, and the row is scored with each.
    """
    p = len(features)
    n, rows = numbered_rows(df, features)
    rows = pinned(rows, "numbered")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, x = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
            for task in range(p * repeats):
                goes = shuffled(number, n, task, seed)
                yield pa.RecordBatch.from_arrays([pa.array(goes), pa.array(np.full(len(goes), task, np.int32)), pa.array(x[:, task // repeats])], ["number", "task", "value"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p * repeats)
        for batch in batches:
            x, values = (c.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in batch.columns)
            base = score(x)
            for task in range(p * repeats):
                other = x.copy()
                other[:, task // repeats] = values[:, task]
                total[task] += np.abs(score(other) - base).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p * repeats, dtype=np.int32)), pa.array(total)], ["task", "moved"])

    got = rows.mapInArrow(send, "number long, task int, value double").groupBy("number").agg(F.array_sort(F.collect_list(F.struct("task", "value"))).alias("got"))
    given = rows.join(got, "number").select("x", F.col("got.value").alias("values"))
    moved = given.mapInArrow(move, "task int, moved double").groupBy("task").agg((F.sum("moved") / max(n, 1)).alias("moved"))
    names = F.array(*map(F.lit, features))
    return moved.select(F.get(names, F.floor(F.col("task") / repeats).cast("int")).alias("feature"), "moved").groupBy("feature").agg(F.avg("moved").alias("importance"), F.stddev_pop("moved").alias("spread"))


def correlations(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Every pair a < b (in the order given) and its correlation, from one pass over df."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    packed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{k}").alias("r")) for k, (a, b) in enumerate(pairs)])
    return row.select(F.explode(packed).alias("x")).select("x.*")


def correlated_losers(pairs: DataFrame, importance: DataFrame, keep: Sequence[str] = KEEP_OF_PAIR, least: float = SAME_PAIR) -> DataFrame:
    """Of each pair of |r| of `least` or more the feature that goes: the one not in `keep`, else the less important (the second of equals)."""
    a, b = importance.select(F.col("feature").alias("a"), F.col("importance").alias("ia")), importance.select(F.col("feature").alias("b"), F.col("importance").alias("ib"))
    near = pairs.where(F.abs("r") >= least).join(a, "a").join(b, "b")
    kept = list(keep)
    loser = F.when(F.col("a").isin(kept), F.col("b")).when(F.col("b").isin(kept), F.col("a")).when(F.col("ia") >= F.col("ib"), F.col("b")).otherwise(F.col("a"))
    return near.select(loser.alias("feature")).distinct()


def selected(importance: DataFrame, losers: DataFrame | None = None, keep: int | None = None, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """The `keep` most important features, or all of `least` importance or more, without the losers, most important first."""
    ranked = importance.withColumn("place", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))
    ranked = ranked.where(F.col("place") <= keep) if keep is not None else ranked.where(F.col("importance") >= least)
    return (ranked.join(losers, "feature", "left_anti") if losers is not None else ranked).orderBy("place")


def enough(features: Sequence[str], least: int = 3) -> list[str]:
    if len(features) < least:
        raise ValueError(f"only {len(features)} features selected")
    return list(features)


def importance_states(importance: DataFrame, losers: DataFrame, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """What the bars of the importance figure show: kept, correlated (gone for its partner) or unimportant."""
    gone = losers.select("feature", F.lit(True).alias("gone"))
    state = F.when(F.col("importance") < least, "unimportant").when(F.col("gone"), "correlated").otherwise("kept")
    return importance.join(gone, "feature", "left").withColumn("state", state).drop("gone")
