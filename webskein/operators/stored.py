"""Rows kept between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """df, worked out once and written to the session's checkpoint folder, or to one in the warehouse where none is set:
    later rounds read it, also when an executor is lost."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")
    return df.checkpoint()
