"""Report files: schemas, readers, and the batch view that falls back from a summary to single reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinesieve.functions.columns import reduction_of_batch
from cinesieve.sources.frames import decoded

#: The keys of a report, in their order, with types.
REPORT = """video string, generated_at string, total_raw_frames int, removed_blurry int, removed_duplicate int, final_unique_frames int,
reduction_rate string, scorer_enabled boolean, top_n_requested int, top_n_selected int, top_frames_dir string, score_report_path string,
output_folder string, blur_threshold_used double, similarity_threshold_used double, blurry_files_removed array<string>,
duplicate_files_removed array<struct<file:string,similarity:double>>"""
RESULT = "index int, video_name string, status string, total_raw_frames int, removed_blurry int, removed_duplicate int, final_unique_frames int, top_n_selected int, output_folder string, error string"
SUMMARY = "total_videos int, success int, skipped int, error int, failed int, input_folder string, output_folder string, generated_at string, video_results array<struct<" + ",".join(c.strip().replace(" ", ":") for c in RESULT.split(",")) + ">>"
COUNTERS = ("total_raw_frames", "removed_blurry", "removed_duplicate", "final_unique_frames")


def _json(spark: SparkSession, path: str, schema: str, mode: str = "DROPMALFORMED") -> DataFrame | None:
    """One document a file; None where no file is there. Malformed files are dropped, or fail the read in mode FAILFAST."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", mode).json(path).withColumn("path", decoded(F.input_file_name()))
    except AnalysisException:
        return None


def report(spark: SparkSession, folder: str, video: str) -> DataFrame | None:
    """One report; None where there is none. A malformed one fails the read."""
    return _json(spark, f"{folder.rstrip('/')}/{video}/report.json", REPORT, "FAILFAST")


def reports(spark: SparkSession, folder: str) -> DataFrame | None:
    """All <folder>/*/report.json, older ones with video_name for video too; a report without a name has its folder's."""
    found = _json(spark, f"{folder.rstrip('/')}/*/report.json", REPORT + ", video_name string")
    if found is None:
        return None
    of_folder = F.element_at(F.split("path", "/"), -2)
    return found.withColumn("video_name", F.coalesce("video_name", "video", of_folder))


def downloaded(spark: SparkSession, folder: str) -> DataFrame | None:
    """The report of a downloaded video: of the folder with the exact name first, else of the first one with that beginning."""
    found = _json(spark, f"{folder.rstrip('/')}/downloaded_video*/report.json", REPORT)
    if found is None:
        return None
    of_folder = F.element_at(F.split("path", "/"), -2)
    order = F.struct((of_folder != "downloaded_video").alias("other"), F.col("path").alias("path"))
    return found.orderBy(order).limit(1)


def batch_results(spark: SparkSession, folder: str) -> DataFrame | None:
    """One row a video as in a summary's video_results; without a usable summary, of the single reports, all successful."""
    summary = _json(spark, f"{folder.rstrip('/')}/_batch_summary.json", SUMMARY)
    if summary is not None:
        rows = summary.select(F.explode("video_results").alias("r")).select("r.*")
        if not rows.isEmpty():
            return rows
    found = reports(spark, folder)
    if found is None or found.isEmpty():
        return None
    index = F.row_number().over(W.orderBy("path")).cast("int")
    return found.select(index.alias("index"), "video_name", F.lit("success").alias("status"), *COUNTERS, "top_n_selected", "output_folder", F.lit(None).cast("string").alias("error"))


def batch_stats(results: DataFrame) -> DataFrame:
    """One row over a batch's results: videos by status, sums of the counters, reduction."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS]
    of = {"videos_processed": "success", "videos_skipped": "skipped", "videos_failed": "error"}
    by_status = [F.count_if(F.col("status") == s).alias(n) for n, s in of.items()]
    row = results.agg(F.count("*").alias("total_videos"), *by_status, F.count_if(F.col("status") != "success").alias("videos_non_success"), *sums)
    return row.withColumn("reduction", reduction_of_batch(F.col("total_raw_frames"), F.col("final_unique_frames")))
