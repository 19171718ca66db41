"""spark-submit entry: learns a schedule from a CSV of activations and writes it as JSON."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.columns import file_time
from pulsegrid.operators import schedule
from pulsegrid.sources.files import write_json


def main() -> None:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("--csv", required=True, help="columns file (YYYYMMDD_HHMMSS.*) and pump_duration_s or pump_dur_s")
    args.add_argument("--out", required=True, help="folder for the JSON")
    args.add_argument("--mode", choices=("reference", "intra_day"), default="reference")
    given = args.parse_args()
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    runs = spark.read.option("header", True).csv(given.csv)
    duration = next(c for c in ("pump_duration_s", "pump_dur_s") if c in runs.columns)
    runs = runs.select(F.lit(1).alias("machine"), F.col("file").alias("id"), file_time(F.col("file")).alias("ts"), F.col(duration).cast("double").alias("duration"))
    write_json(schedule.fit(runs, given.mode).withColumn("trained_at", F.current_timestamp()), given.out)


if __name__ == "__main__":
    main()
