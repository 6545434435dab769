"""Curation of videos, or of folders of their frames, from end to end."""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinesieve.config import Config
from cinesieve.functions import images
from cinesieve.operators import ranking
from cinesieve.plans.curate import disposed
from cinesieve.plans.jobs import Job
from cinesieve.sinks import files, reports
from cinesieve.sources import frames as source
from cinesieve.sources import video as video_source
from cinesieve.sources.reports import RESULT
from cinesieve.sources.storage import released, scratch

SIDE = 256
FEATURES = "blur_score double, item binary"
SCORES = "sharpness double, colorfulness double, brightness double, contrast double, composition double, total double, error string"
SCORE_STRUCT = "struct<" + SCORES.replace(" ", ":").replace(",:", ",") + ">"
#: Images that one scan for scores lists by name.
LISTED = 100_000
NO_FRAMES = "No frames came out of it: empty, shorter than a frame's period, or damaged"


def _pixels(image) -> object:
    bgr = images.decode(int(image["height"]), int(image["width"]), int(image["nChannels"]), image["data"])
    if bgr is None:
        raise ValueError("unreadable")
    return bgr


def features(frames: DataFrame, config: Config) -> DataFrame:
    """frames (video, frame_order, file, origin, image) -> the same without the image, with blur_score and item.

    Pixels are decoded in Arrow batches and never shuffled. A frame that can't be read, or whose features fail, has a blur
    score of 0 and no item; it doesn't fail the others.
    """
    method, size = config.filter.dedup_method, config.filter.phash_size

    def of(image: dict) -> tuple:
        try:
            gray = images.to_gray(_pixels(image))
            return images.laplacian_variance(gray), images.comparable(gray, SIDE) if method == "ssim" else images.phash(gray, size)
        except Exception:  # noqa: BLE001  one bad frame is a row without features
            return 0.0, None

    @F.pandas_udf(FEATURES)
    def extract(image: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([of(r) for r in image.to_dict("records")], columns=["blur_score", "item"])

    kept = frames.select("video", "frame_order", "file", "origin", extract("image").alias("f"))
    return kept.select("video", "frame_order", "file", "origin", "f.*")


def scored(survivors: DataFrame, path: str) -> DataFrame:
    """origin and scores of the frames that survive (origin), written to path; an error in the scores of one that can't be read.

    A scan decodes what it lists, so that survivors are listed by name, LISTED at a time, and no other image is read again.
    """
    spark = survivors.sparkSession

    def of(image: dict) -> dict:
        try:
            return images.scores(_pixels(image))
        except Exception:  # noqa: BLE001  one bad frame is a row with an error
            return images.scores(None)

    @F.pandas_udf(SCORES)
    def score(image: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([of(r) for r in image.to_dict("records")], columns=[c.split()[0] for c in SCORES.split(", ")])

    spark.createDataFrame([], f"origin string, scores {SCORE_STRUCT}").write.parquet(path)
    names = (r.origin for r in survivors.select("origin").toLocalIterator())
    while some := list(islice(names, LISTED)):
        source.read_images(spark, some).select("origin", score("image").alias("scores")).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def curate(frames: DataFrame, config: Config) -> DataFrame:
    """All frames with blur_score, is_sharp, disposition, similarity, unique_no, scores and rank.

    Unique frames alone are scored and ranked, in a second pass over the images, and only with the scorer on; the others
    have null there.
    """
    spark = frames.sparkSession
    path = scratch(spark, "features")
    features(frames, config).write.parquet(path)
    # numbers in each video's order of files: ties in the names' numbers and names without one are told apart
    order = W.partitionBy("video").orderBy("frame_order", "file", "origin")
    rows = spark.read.parquet(path).withColumn("frame_order", F.row_number().over(order).cast("long"))
    size = SIDE if config.filter.dedup_method == "ssim" else config.filter.phash_size**2
    done_path = scratch(spark, "disposed")
    disposed(rows, config.filter.blur_threshold, config.filter.similarity_threshold, config.filter.dedup_method, size, long_videos=True).write.parquet(done_path)
    done = spark.read.parquet(done_path)
    unique = done.where("disposition = 'unique'")
    numbers = ranking.numbered(unique.select("video", "frame_order", "origin"))
    if config.scorer.enabled:
        numbers = numbers.join(scored(unique, scratch(spark, "scores")), "origin", "left").withColumn("total", F.col("scores.total"))
        numbers = ranking.ranked(numbers).select("video", "frame_order", "unique_no", "scores", "rank")
    else:
        numbers = numbers.select("video", "frame_order", "unique_no", F.lit(None).cast(SCORE_STRUCT).alias("scores"), F.lit(None).cast("int").alias("rank"))
    return done.join(numbers, ["video", "frame_order"], "left")


@dataclass
class Result:
    curated: DataFrame
    reports: DataFrame
    results: DataFrame
    notes: list[str]


def _inputs(spark: SparkSession, source_path: str, folder: str, config: Config) -> tuple[DataFrame, str, list[str], str | None]:
    """The videos (index, video, video_name, error), where their frames are, notes, and a folder of raw frames made here.

    A video file, or a folder with any, is extracted; else each folder with images, or the folder itself, is a video.
    """
    rows = source.videos(spark, source_path)
    if not rows.isEmpty():
        raw = f"{folder.rstrip('/')}/_raw"
        files.remove(spark, raw)
        done = scratch(spark, "extracted")
        video_source.extract(spark, rows.select("video", "path"), raw, config.extraction).write.parquet(done)
        errors = spark.read.parquet(done).select("video", "error")
        return rows.join(errors, "video", "left").select("index", "video", "video_name", "error"), raw, [], raw
    found = files.entries(spark, source_path)
    images_here = any(not is_folder and name.lower().endswith(source.IMAGE_ENDINGS) for name, _, is_folder in found)
    names = [source_path.rstrip("/").rsplit("/", 1)[-1]] if images_here else [name for name, _, is_folder in found if is_folder]
    rows = spark.createDataFrame([(i, name, name) for i, name in enumerate(names, 1)], "index int, video string, video_name string")
    note = "frames are extracted already: mode, fps, scene_threshold and jpeg_quality have no effect on them"
    return rows.select("index", "video", "video_name", F.lit(None).cast("string").alias("error")), source_path, [note] if config.extraction_given else [], None


def results(videos: DataFrame, report: DataFrame) -> DataFrame:
    """One row a video, those without a frame and those that failed too: the columns of a summary's video_results."""
    joined = videos.join(report.drop("index", "video_name", "error"), "video", "left")
    some = F.coalesce(F.col("total_raw_frames") > 0, F.lit(False))
    status = F.when(F.col("error").isNotNull(), "error").when(some, "success").otherwise("skipped")
    counters = [F.coalesce(F.when(F.col("error").isNull(), F.col(c)), F.lit(0)).cast("int").alias(c) for c in ("total_raw_frames", "removed_blurry", "removed_duplicate", "final_unique_frames")]
    of_success = lambda c: F.when(status == "success", F.col(c))
    rows = joined.select(
        F.col("index"), "video_name", status.alias("status"), *counters, of_success("top_n_selected").alias("top_n_selected"),
        F.coalesce(of_success("output_folder"), F.lit("")).alias("output_folder"), F.when(status == "skipped", NO_FRAMES).otherwise(F.col("error")).alias("error"),
    )
    return rows.select(*[c.split()[0] for c in RESULT.split(", ")])


def process(spark: SparkSession, source_path: str, folder: str, config: Config, copy: bool = True) -> Result:
    """Curates the videos or frames under source_path and writes what the configuration asks for under folder."""
    with Job(spark, folder, source_path) as job:
        job.step("extract")
        videos, frames_path, notes, raw = _inputs(spark, source_path, folder, config)
        failed = [r.error for r in videos.where("error IS NOT NULL").limit(1).collect()]
        at = scratch(spark, "curated")
        job.step("curate")
        rows = source.read_frames(spark, frames_path) if raw is None or files.exists(spark, raw) else source.no_frames(spark)
        with released(spark):  # features, dispositions and scores, once they are in one table
            curate(rows, config).write.parquet(at)
        done = spark.read.parquet(at)
        report = reports.report_rows(done, folder, config)
        notes = [*config.warnings, *notes, *(f"a video could not be read: {e}" for e in failed)]
        if copy:
            job.step("copy")
            earlier = F.explode(F.array(*[F.concat_ws("/", F.lit(folder.rstrip("/")), "video", F.lit(n)) for n in ("unique_frames", "top_frames")]))
            files.clear(report.select(earlier.alias("path")))
            files.copy(files.unique_manifest(done, folder), folder)
        if config.scorer.enabled:
            if copy:
                files.copy(files.top_manifest(done, folder, config.scorer.top_n), folder)
            if config.scorer.save_score_report:
                reports.write_score_reports(done, folder)
        job.step("report")
        if config.output.report_json:
            reports.write_reports(report, folder)
        if config.output.generate_html_preview:
            notes += reports.write_previews(report, done, folder, config.output.preview_columns)
        if raw and not config.output.keep_raw:
            files.remove(spark, raw)
        return Result(done, report, results(videos, report), notes)


def process_batch(spark: SparkSession, source_path: str, folder: str, config: Config, copy: bool = True) -> Result:
    """process, and a summary of the batch and, where a video has frames, a page over its galleries. Nothing to do is a note."""
    result = process(spark, source_path, folder, config, copy)
    if result.results.isEmpty():
        return replace(result, notes=[*result.notes, f"no videos and no folders of frames in {source_path}"])
    reports.write_summary(spark, reports.summary_row(result.results, source_path, folder), folder)
    bad = [r.video_name for r in result.results.where("status <> 'success'").orderBy("index").select("video_name").limit(100).collect()]
    if copy and config.output.generate_html_preview and not result.results.where("status = 'success'").isEmpty():
        reports.write_gallery(spark, source.outputs(spark, folder), folder)
    return replace(result, notes=[*result.notes, *([f"without success: {', '.join(bad)}"] if bad else [])])
