"""Column expressions that the operators share. Averages and deviations are of the population unless the name says sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pulsegrid.config import EPS


def cv(c: Column) -> Column:
    return F.stddev_pop(c) / (F.avg(c) + F.lit(EPS))


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b isn't above 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def known(c: Column) -> Column:
    """Null for NaN."""
    return F.when(~F.isnan(c), c)


def clipped(c: Column, lo: Column, hi: Column) -> Column:
    """c within its bounds; null and NaN stay null (greatest and least would skip them)."""
    return F.when(known(c).isNotNull(), F.least(F.greatest(c, lo), hi))


def scaled(c: Column, center: Column, scale: Column) -> Column:
    return (c - center) / F.when(scale == 0, F.lit(1.0)).otherwise(scale)


def stem(file: Column) -> Column:
    """The name without folders and extension."""
    return F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.[^.]*$", "")


def file_time(file: Column) -> Column:
    """The time in a name like 20260401_150817.mp4, or null; whatever the extension."""
    return F.try_to_timestamp(stem(file), F.lit("yyyyMMdd_HHmmss"))


def day_hour(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / 60 + F.floor(F.second(ts)) / 3600


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp with or without zone (in UTC)."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def eccentricity(x: Column, y: Column) -> Column:
    """Of the point cloud (x, y): sqrt(1 - smaller / larger eigenvalue of the covariance), in closed form."""
    a, b, c = F.var_samp(x), F.covar_samp(x, y), F.var_samp(y)
    half = F.sqrt(((a - c) / 2) * ((a - c) / 2) + b * b)
    return F.sqrt(F.lit(1.0) - ((a + c) / 2 - half) / ((a + c) / 2 + half + F.lit(EPS)))


def ordered(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def long_form(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), list(columns), name, value)
