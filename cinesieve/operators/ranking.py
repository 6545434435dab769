"""Ranks by score inside videos, and numbers for output files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ranked(scored: DataFrame, by: str = "total") -> DataFrame:
    """scored (video, frame_order, total, ...) with rank from 1: highest total first, ties in frame order."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("video").orderBy(F.desc(by), "frame_order")))


def top(scored: DataFrame, n: int, by: str = "total") -> DataFrame:
    """The first n of each video; Spark limits each task's rows to n a video before the shuffle."""
    return ranked(scored, by).where(F.col("rank") <= n)


def numbered(frames: DataFrame, column: str = "unique_no") -> DataFrame:
    """frames with their number from 0 in frame order in each video."""
    return frames.withColumn(column, F.row_number().over(W.partitionBy("video").orderBy("frame_order")) - 1)
