"""Counts over videos and batches from frames with a disposition.

disposition is blurry, duplicate, hash_error, unreadable or unique; all but blurry and unique count as duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinesieve.functions.columns import reduction_of_batch, reduction_of_video


def funnel(frames: DataFrame) -> DataFrame:
    """A row a video: frames raw, after blur, after dedup, final, and removed by either step; one aggregate with partial sums."""
    blurry, unique = F.count_if(F.col("disposition") == "blurry"), F.count_if(F.col("disposition") == "unique")
    counted = frames.groupBy("video").agg(F.count("*").alias("total_raw_frames"), blurry.alias("removed_blurry"), unique.alias("final_unique_frames"))
    return counted.select(
        "video",
        "total_raw_frames",
        (F.col("total_raw_frames") - F.col("removed_blurry")).alias("after_blur"),
        F.col("final_unique_frames").alias("after_dedup"),
        "removed_blurry",
        (F.col("total_raw_frames") - F.col("removed_blurry") - F.col("final_unique_frames")).alias("removed_duplicate"),
        "final_unique_frames",
    )


def removed_lists(frames: DataFrame, name: str = "file") -> DataFrame:
    """A row a video: its blurry files and its duplicates (file, similarity), in frame order: what a report of it holds."""
    blurry = F.when(F.col("disposition") == "blurry", F.struct("frame_order", F.col(name).alias("file")))
    duplicate = F.when(~F.col("disposition").isin("blurry", "unique"), F.struct("frame_order", F.col(name).alias("file"), "similarity"))
    lists = frames.groupBy("video").agg(F.array_sort(F.collect_list(blurry)).alias("b"), F.array_sort(F.collect_list(duplicate)).alias("d"))
    return lists.select("video", F.transform("b", lambda x: x["file"]).alias("blurry_files_removed"), F.transform("d", lambda x: F.struct(x["file"].alias("file"), x["similarity"].alias("similarity"))).alias("duplicate_files_removed"))


def reductions(counts: DataFrame) -> DataFrame:
    return counts.withColumn("reduction", reduction_of_video(F.col("total_raw_frames"), F.col("final_unique_frames")))


def batch(videos: DataFrame) -> DataFrame:
    """One row: sums of the counters over successful videos, how many videos have each status, and the batch's reduction."""
    ok = F.col("status") == "success"
    counters = ("total_raw_frames", "removed_blurry", "removed_duplicate", "final_unique_frames")
    sums = [F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(c) for c in counters]
    by_status = [F.count_if(F.col("status") == s).alias(s) for s in ("success", "skipped", "error")]
    row = videos.agg(F.count("*").alias("total_videos"), *by_status, F.count_if(~ok).alias("failed"), *sums)
    return row.withColumn("overall_reduction", reduction_of_batch(F.col("total_raw_frames"), F.col("final_unique_frames")))


def by_status(videos: DataFrame) -> DataFrame:
    """Videos and frames by status, with a total where status is null."""
    return videos.rollup("status").agg(F.count("*").alias("videos"), F.sum("total_raw_frames").alias("frames"))


def failures(videos: DataFrame) -> DataFrame:
    """One row: how many videos failed and their names, in order."""
    failed = F.when(F.col("status") != "success", F.col("video"))
    return videos.agg(F.count(failed).alias("n_failed"), F.array_join(F.array_sort(F.collect_list(failed)), ", ").alias("names"))
