"""Tables that a job reads several times."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def pinned(df: DataFrame, name: str) -> DataFrame:
    """df as a table in spark.checkpoint.dir, which every executor reaches (below the warehouse where that is unset): numbers given to its rows stay, and no executor that is lost takes any with it."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
