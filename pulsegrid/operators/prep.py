"""Cleaning of feature tables: columns that say nothing, outliers, scale."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.config import META, NEAR_CONSTANT
from pulsegrid.functions.columns import clipped, known, long_form, scaled
from pulsegrid.functions.quantiles import exact_quantiles

Params = dict[str, tuple[float, float, float, float]]  # lo, hi, center, scale


def feature_columns(df: DataFrame, meta: Sequence[str] = META) -> list[str]:
    """All columns but those of `meta`, in their order."""
    return [c for c in df.columns if c not in meta]


def without_rows(df: DataFrame, files: Sequence[str]) -> DataFrame:
    return df.where(~F.col("file").isin(list(files))) if files else df


def require(df: DataFrame, features: Sequence[str]) -> None:
    if missing := [f for f in features if f not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def medians(df: DataFrame, features: Sequence[str]) -> dict[str, float]:
    return {f: q[0] if q[0] is not None else 0.0 for f, q in exact_quantiles(df, features, [0.5]).items()}


def filled(df: DataFrame, fills: dict[str, float]) -> DataFrame:
    return df.withColumns({f: F.coalesce(known(F.col(f).cast("double")), F.lit(float(v))) for f, v in fills.items()})


def live_vector(df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("file",)) -> DataFrame:
    """The features in their order; what is absent, null or NaN is 0."""
    return df.select(*keys, *[(F.coalesce(known(F.col(f).cast("double")), F.lit(0.0)) if f in df.columns else F.lit(0.0)).alias(f) for f in features])


def zero_variance(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature its sample deviation and whether that is 0."""
    wide = df.agg(*[F.stddev_samp(F.col(f).cast("double")).alias(f) for f in features])
    return long_form(wide, [], features, value="std").withColumn("dropped", F.col("std") == 0)


def near_constant(df: DataFrame, features: Sequence[str], share: float = NEAR_CONSTANT) -> DataFrame:
    """Per feature the share of its most common value and whether that is above `share`."""
    counts = long_form(df, [], features).groupBy("feature", "value").count()
    return counts.groupBy("feature").agg((F.max("count") / F.sum("count")).alias("top_share")).withColumn("dropped", F.col("top_share") > share)


def pruned(df: DataFrame, features: Sequence[str], excluded: Sequence[str] = ()) -> list[str]:
    """The features that vary, without `excluded` (of which those that are absent are warned of); a feature's verdict comes from aggregates, one row for each."""
    if absent := [f for f in excluded if f not in features]:
        warnings.warn(f"excluded, but not there: {', '.join(absent)}", stacklevel=2)
    gone = {r.feature for r in zero_variance(df, features).where("dropped").collect()}
    left = [f for f in features if f not in gone]
    gone |= {r.feature for r in near_constant(df, left).where("dropped").collect()} if left else set()
    return [f for f in features if f not in gone and f not in excluded]


def fit_bounds(df: DataFrame, features: Sequence[str], lo: float = 0.01, hi: float = 0.99) -> dict[str, tuple[float, float]]:
    return {f: (q[0], q[1]) for f, q in exact_quantiles(df, features, [lo, hi]).items()}


def clip(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f: clipped(F.col(f).cast("double"), F.lit(float(lo)), F.lit(float(hi))) for f, (lo, hi) in bounds.items()})


def fit(df: DataFrame, features: Sequence[str]) -> Params:
    """Bounds, and of the values within them median and quartile range; df may have been clipped before, as the published model's was."""
    bounds = fit_bounds(df, features)
    quartiles = exact_quantiles(clip(df, bounds), features, [0.25, 0.5, 0.75])
    return {f: (*bounds[f], quartiles[f][1], quartiles[f][2] - quartiles[f][0]) for f in features}


def transform(df: DataFrame, params: Params, clip_first: bool = True) -> DataFrame:
    """Clipped, if asked for, and scaled by median and quartile range (a range of 0 counts as 1)."""
    if clip_first:
        df = clip(df, {f: p[:2] for f, p in params.items()})
    return df.withColumns({f: scaled(F.col(f).cast("double"), F.lit(float(p[2])), F.lit(float(p[3]))) for f, p in params.items()})


def low_variance(df: DataFrame, features: Sequence[str], least: float = 1e-3) -> list[str]:
    row = df.agg(*[F.stddev_samp(f).alias(f) for f in features]).first()
    return [f for f in features if row[f] is not None and row[f] < least]
