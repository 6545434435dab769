"""The blur filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judged(frames: DataFrame, threshold: float) -> DataFrame:
    """frames (with blur_score, null for unreadable ones, which score 0) and is_sharp: the score is at or over the threshold."""
    scored = frames.withColumn("blur_score", F.coalesce("blur_score", F.lit(0.0)))
    return scored.withColumn("is_sharp", F.col("blur_score") >= threshold)
