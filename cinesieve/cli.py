"""python -m cinesieve.cli: curation of frame folders from a shell."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from cinesieve import config as settings
from cinesieve.plans import jobs, run
from cinesieve.sinks import files, reports
from cinesieve.sources import frames as source


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Drops blurry and near-duplicate frames, ranks the others and reports on them.")
    where = p.add_mutually_exclusive_group()
    where.add_argument("--input", "-i", help="a video, or a folder as for --batch")
    where.add_argument("--batch", "-b", help="folder of videos, or with a folder of frames for each video; a summary is written too")
    where.add_argument("--url", "-u", help="not supported: fetch the video first")
    p.add_argument("--output", "-o", help="folder for what is written")
    p.add_argument("--config", help="JSON file with settings")
    p.add_argument("--mode", choices=["fps", "scene"])
    p.add_argument("--fps", type=float)
    p.add_argument("--blur", type=float, help="least Laplacian variance; a higher one drops more frames")
    p.add_argument("--sim", type=float, help="frames at least this similar to a kept one are dropped")
    p.add_argument("--method", choices=["phash", "ssim"])
    p.add_argument("--top", type=int, help="rank the frames and copy this many of each video")
    for flag, what in (("--keep-raw", "keep the frames that were extracted from videos"), ("--no-html", "write no pages"), ("--no-report", "write no report.json"), ("--gen-batch-html", "only write the page over existing outputs"), ("--clean-empty", "only list output folders without frames"), ("--jobs", "only list the last runs")):
        p.add_argument(flag, action="store_true", help=what)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    if not args.output:
        p.error("--output is needed")
    utility = args.gen_batch_html or args.clean_empty or args.jobs
    if not utility and not (args.input or args.batch or args.url):
        p.error("one of --input and --batch is needed")
    if args.url:
        p.error("--url is not supported: fetch the video and extract its frames first")
    spark = spark or SparkSession.builder.appName("cinesieve").getOrCreate()
    if (args.gen_batch_html or args.clean_empty) and not files.is_folder(spark, args.output):
        p.error(f"{args.output} is not a folder")
    if args.gen_batch_html:
        print(reports.write_gallery(spark, source.outputs(spark, args.output), args.output) or "no frames")
        return 0
    if args.clean_empty:
        everything = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(args.output).select(source.local_path(source.F.col("path")).alias("path"))
        root = len(args.output.rstrip("/").split("/"))
        folders = everything.select(source.F.element_at(source.F.split(source.F.regexp_replace("path", "^file:", ""), "/"), root + 1).alias("video")).distinct()
        for row in source.folders_without_frames(folders, source.outputs(spark, args.output)).toLocalIterator():
            print(row.video)
        return 0
    if args.jobs:
        jobs.recent(spark, args.output).select("job_id", "status", "step", "source", "error").show(truncate=False)
        return 0
    where = args.batch or args.input
    if not files.exists(spark, where):
        p.error(f"{where} is not there")
    if args.batch and not files.is_folder(spark, where):
        p.error(f"{where} is not a folder")
    base = settings.load(spark, args.config) if args.config else settings.Config()
    config = settings.overridden(base, args.mode, args.fps, args.blur, args.sim, args.method, args.top, args.keep_raw, args.no_html, args.no_report)
    work = run.process_batch if files.is_folder(spark, where) else run.process
    result = work(spark, where, args.output, config)
    for note in result.notes:
        print(f"note: {note}")
    if config.scorer.enabled:
        best = result.curated.where(source.F.col("rank") <= min(10, config.scorer.top_n))
        best.select("video", "rank", "file", "scores.total", "scores.sharpness", "scores.colorfulness", "scores.brightness", "scores.composition").orderBy("video", "rank").show(truncate=False)
    result.reports.select("video", "total_raw_frames", "removed_blurry", "removed_duplicate", "final_unique_frames", "reduction_rate").show(truncate=False)
    # in a batch a video's error is its row of the summary
    return int(work is run.process and not result.results.where("status = 'error'").isEmpty())


if __name__ == "__main__":
    raise SystemExit(main())
