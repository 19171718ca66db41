"""Exact quantiles that don't gather a column in one task.

`percentile` keeps all distinct values of a group in one aggregation buffer. Here the values are
counted in bins between their bounds, and only the bins that hold a wanted rank are looked into
again, until few values are left; each pass sends BINS counts for each column at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.functions.columns import known, long_form

BINS, FEW = 2048, 4096
#: Ranges that ordered values are dealt to, and rows of a range at least.
RANGES, RANGE_ROWS = 256, 10_000


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """For each column its quantiles, linear between neighbours; nulls and NaNs are left out. None where nothing is left."""
    found = grouped_quantiles(df, [], columns, shares)
    return {c: found.get((c,), [None] * len(shares)) for c in columns}


def grouped_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], shares: Sequence[float]) -> dict[tuple, list[float]]:
    """(column, *key) to quantiles, for groups that are few: the driver holds BINS counts for each at most. A level of bins is one job for all of them."""
    own = [f"_k{i}" for i in range(len(keys))]
    long = long_form(df.select(*[F.col(f"`{k}`").alias(o) for k, o in zip(keys, own, strict=True)], *[F.col(f"`{c}`") for c in columns]), own, columns, "_c", "_v")
    long = long.withColumn("_v", known(F.col("_v"))).where("_v is not null")
    todo, places, values = [], {}, {}
    for row in long.groupBy("_c", *own).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect():
        group = (row["_c"], *[row[o] for o in own])
        places[group] = [s * (row["n"] - 1) for s in shares]
        ranks = sorted({int(p) for p in places[group]} | {min(int(p) + 1, row["n"] - 1) for p in places[group]})
        todo.append((group, ranks, 0, row["n"], row["lo"], row["hi"]))
        values[group] = {}
    kind = T.StructType([T.StructField("_id", T.IntegerType()), T.StructField("_lo", T.DoubleType()), T.StructField("_hi", T.DoubleType()), T.StructField("_step", T.DoubleType()), T.StructField("_g", T.StructType([T.StructField(c, long.schema[c].dataType) for c in ("_c", *own)]))])
    while todo:
        for group, ranks, _, _, lo, _ in (x for x in todo if x[4] == x[5]):
            values[group] |= dict.fromkeys(ranks, lo)
        todo = [x for x in todo if x[4] < x[5]]
        # below FEW rows, or where bins are finer than the numbers, which are then BINS at most, each value is a bin
        steps = [0.0 if n <= FEW or lo + (hi - lo) / BINS == lo or hi - (hi - lo) / BINS == hi else (hi - lo) / BINS for _, _, _, n, lo, hi in todo]
        if not todo:
            break
        looked = df.sparkSession.createDataFrame([(i, x[4], x[5], step, x[0]) for i, (x, step) in enumerate(zip(todo, steps, strict=True))], kind)
        here = F.col("_v").between(F.col("_lo"), F.col("_hi"))
        for c in ("_c", *own):
            here = here & F.col(c).eqNullSafe(F.col(f"_g.{c}"))
        place = F.when(F.col("_step") > 0, F.least(F.floor((F.col("_v") - F.col("_lo")) / F.col("_step")), F.lit(BINS - 1)).cast("double")).otherwise(F.col("_v"))
        bins = long.join(F.broadcast(looked), here).groupBy("_id", place.alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        more, at, last = [], 0, None
        for k, _, count, least, most in sorted(map(tuple, bins.collect())):
            if k != last:
                at, last = todo[k][2], k
            if inside := [r for r in todo[k][1] if at <= r < at + count]:
                more.append((todo[k][0], inside, at, count, least, most))
            at += count
        todo = more
    return {g: [values[g][int(p)] + (p - int(p)) * (values[g][min(int(p) + 1, max(values[g]))] - values[g][int(p)]) for p in ps] for g, ps in places.items()}


def range_of(values: DataFrame, column: str, ranges: int = RANGES) -> Column:
    """The number of the range of `column` that a value lies in, in order; ranges hold about equal numbers of rows.

    Bounds come from a sketch and are fixed from then on, so every use of the column deals alike. Nulls are in the first range.
    """
    found, n = values.agg(F.percentile_approx(column, [k / ranges for k in range(1, ranges)], 10 * ranges), F.count(column)).first()
    every = max(1, ranges * RANGE_ROWS // max(n, 1))
    bounds = sorted({float(b) for b in (found or [])[every - 1 :: every] if b == b})

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(column) >= F.lit(bounds[mid]), search(mid + 1, hi)).otherwise(search(lo, mid))

    return search(0, len(bounds))
