"""Schedules: learned from activations, and activations checked against them. All keyed by machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.columns import day_hour, seconds


def dated(df: DataFrame) -> DataFrame:
    """machine, ts, duration with date and hour."""
    return df.withColumn("date", F.to_date("ts")).withColumn("hour", day_hour(F.col("ts")))


def complete_days(df: DataFrame) -> DataFrame:
    """Rows of the days that have at least the machine's median number of activations (cut to a whole number), with `per_day`."""
    counts = df.groupBy("machine", "date").agg(F.count(F.lit(1)).alias("n"))
    usual = counts.groupBy("machine").agg(F.median("n").cast("int").alias("per_day"))
    days = counts.join(usual, "machine").where("n >= per_day").select("machine", "date", "per_day")
    return df.join(days, ["machine", "date"])


def intervals(df: DataFrame, mode: str = "reference") -> DataFrame:
    """Seconds between activations. intra_day: between followers of one day. reference: between those that have a predecessor on their day, whatever day the one before that in this list is of; so nights count, and each day's first gap does not."""
    by_time = Window.partitionBy("machine").orderBy("ts", "id")
    later = df.withColumn("before", F.lag("ts").over(by_time)).withColumn("date_before", F.lag("date").over(by_time)).where("date = date_before")
    if mode == "reference":
        later = later.withColumn("before", F.lag("ts").over(by_time)).where("before is not null")
    return later.select("machine", "id", "date", (seconds(F.col("ts")) - seconds(F.col("before"))).alias("interval_s"))


def slots(df: DataFrame) -> DataFrame:
    """Per machine and place within the day: the mean hour, its deviation and on how many days."""
    placed = df.withColumn("slot", F.row_number().over(Window.partitionBy("machine", "date").orderBy("ts", "id")) - 1).where("slot < per_day")
    return placed.groupBy("machine", "slot").agg(F.round(F.avg("hour"), 6).alias("hour"), F.stddev_pop("hour").alias("spread"), F.count(F.lit(1)).alias("days"))


def fit(df: DataFrame, mode: str = "reference") -> DataFrame:
    """df: machine, id, ts, duration. A row for each machine; a slot that no day has stays as a null in expected_hours."""
    full = complete_days(dated(df))
    gaps = intervals(full, mode).groupBy("machine").agg(F.round(F.avg("interval_s"), 3).alias("interval_mean"), F.round(F.stddev_samp("interval_s"), 3).alias("interval_std"))
    durations = full.groupBy("machine").agg(F.count_distinct("date").alias("n_training_days"), F.count(F.lit(1)).alias("n_training_cycles"), F.round(F.avg("duration"), 3).alias("duration_mean"), F.round(F.stddev_samp("duration"), 3).alias("duration_std"), F.max("per_day").alias("expected_cycles_per_day"))
    hours = slots(full).groupBy("machine").agg(F.map_from_entries(F.collect_list(F.struct("slot", "hour"))).alias("by_slot"))
    out = durations.join(gaps, "machine", "left").join(hours, "machine", "left")
    every = F.when(F.col("expected_cycles_per_day") > 0, F.sequence(F.lit(0), F.col("expected_cycles_per_day") - 1)).otherwise(F.array().cast("array<int>"))
    return out.withColumn("expected_hours", F.transform(every, lambda i: F.element_at("by_slot", i))).drop("by_slot")


def labels(interval: Column, duration: Column, hour: Column, slot: Column) -> Column:
    """Anomalies of an activation against the model's columns, in the order interval, duration, time."""
    wrong_interval = F.when(F.abs(interval - F.col("interval_mean")) > 3 * F.col("interval_std"), F.when(interval > F.col("interval_mean"), F.lit("missed_cycle")).otherwise(F.lit("extra_cycle")))
    wrong_duration = F.when(F.abs(duration - F.col("duration_mean")) > 3 * F.col("duration_std"), F.lit("wrong_duration"))
    wrong_time = F.when(F.abs(hour - F.get("expected_hours", slot)) > 0.5, F.lit("wrong_time"))
    return F.array_compact(F.array(wrong_interval, wrong_duration, wrong_time))


def check(df: DataFrame, model: DataFrame) -> DataFrame:
    """df: machine, id, ts, duration; with interval, slot and anomalies. A machine's first activation has no interval; machines without a model have no anomalies."""
    by_time = Window.partitionBy("machine").orderBy("ts", "id")
    placed = dated(df).withColumn("interval_s", seconds(F.col("ts")) - seconds(F.lag("ts").over(by_time))).withColumn("slot", F.row_number().over(Window.partitionBy("machine", "date").orderBy("ts", "id")) - 1)
    checked = placed.join(model, "machine", "left")
    return checked.select(*df.columns, "date", "hour", "interval_s", "slot", F.coalesce(labels(F.col("interval_s"), F.col("duration"), F.col("hour"), F.col("slot")), F.array().cast("array<string>")).alias("anomalies"))
