"""The driver's tables seen as frames and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinesieve.functions import grids


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as gray 8 x 8 frames: video (the label), frame_order (the id), px."""
    rows = read(spark, sf_dir, "embeddings")
    return rows.select(F.col("label").cast("long").alias("video"), F.col("vec_id").alias("frame_order"), grids.gray(F.col("embedding")).alias("px"))


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a timeline of each user: key, t, order, value."""
    rows = read(spark, sf_dir, "events")
    return rows.select(F.col("user_id").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").alias("order"), "value")
