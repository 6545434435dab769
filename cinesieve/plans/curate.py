"""Curation as one plan: blur filter, greedy deduplication of the sharp frames, scores and ranks of the survivors.

Every step adds columns; no frame is lost on the way, and every output is a view over the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinesieve.operators import blur, dedup, ranking, rounds


def disposed(frames: DataFrame, blur_threshold: float, similarity_threshold: float, method: str = "phash", size: int = 256, long_videos: bool = False) -> DataFrame:
    """frames (video, frame_order, blur_score, item, ...) with is_sharp, disposition and similarity.

    Blurry frames never meet the deduplication; its result is joined back to the sharp ones by video and order. With
    `long_videos`, frames are counted first and videos too long for one task are deduplicated in rounds, with equal results.
    """
    judged = blur.judged(frames, blur_threshold)
    greedy = rounds.deduplicated if long_videos else dedup.greedy
    found = greedy(judged.where("is_sharp"), similarity_threshold, method, size)
    joined = judged.drop("item").join(found, ["video", "frame_order"], "left")
    return joined.withColumn("disposition", F.coalesce("disposition", F.lit("blurry")))


def curated(frames: DataFrame, blur_threshold: float, similarity_threshold: float, method: str = "phash", size: int = 256) -> DataFrame:
    """frames (.., scores struct with total) with disposition, similarity, unique_no and rank; the last two for unique frames."""
    rows = disposed(frames, blur_threshold, similarity_threshold, method, size)
    unique = rows.where("disposition = 'unique'").select("video", "frame_order", F.col("scores.total").alias("total"))
    numbers = ranking.ranked(ranking.numbered(unique)).select("video", "frame_order", "unique_no", "rank")
    return rows.join(numbers, ["video", "frame_order"], "left")
