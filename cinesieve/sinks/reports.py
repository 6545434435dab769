"""Report rows as DataFrames; their JSON, HTML and console forms."""

from __future__ import annotations

from base64 import b64encode
from html import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinesieve.config import Config
from cinesieve.functions.columns import exactly_rounded, html_escape, percent, reduction_of_video
from cinesieve.operators import stats
from cinesieve.sinks import files

PREVIEW, LARGE = 150, 10 << 20
_STYLE = "body{font-family:sans-serif;margin:2em}.g{display:grid;gap:8px}img{width:100%}figure{margin:0}.n b{display:block;font-size:1.4em}.n{display:flex;gap:2em}"


def report_rows(curated: DataFrame, folder: str, config: Config) -> DataFrame:
    """One row a video with the keys of a report, in their order."""
    counts = stats.funnel(curated).join(stats.removed_lists(curated), "video")
    scored, root = config.scorer.enabled, folder.rstrip("/")
    n, unique = F.lit(config.scorer.top_n), F.col("final_unique_frames")
    nothing = lambda kind: F.lit(None).cast(kind)
    at = lambda name: F.concat_ws("/", F.lit(root), "video", F.lit(name))
    some = F.lit(scored) & (unique > 0)
    return counts.select(
        "video",
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("generated_at"),
        *[F.col(c).cast("int").alias(c) for c in ("total_raw_frames", "removed_blurry", "removed_duplicate", "final_unique_frames")],
        percent(reduction_of_video(F.col("total_raw_frames"), unique)).alias("reduction_rate"),
        F.lit(scored).alias("scorer_enabled"),
        (n if scored else nothing("int")).cast("int").alias("top_n_requested"),
        (F.least(n, unique).cast("int") if scored else nothing("int")).alias("top_n_selected"),
        F.when(some, at("top_frames")).alias("top_frames_dir"),
        F.when(some & F.lit(config.scorer.save_score_report), at("score_report.json")).alias("score_report_path"),
        at("unique_frames").alias("output_folder"),
        F.lit(float(config.filter.blur_threshold)).alias("blur_threshold_used"),
        F.lit(float(config.filter.similarity_threshold)).alias("similarity_threshold_used"),
        "blurry_files_removed",
        F.transform("duplicate_files_removed", lambda x: F.struct(x["file"].alias("file"), exactly_rounded(x["similarity"], 3).alias("similarity"))).alias("duplicate_files_removed"),
    )


def as_json(rows: DataFrame, *columns: str) -> Column:
    """The row as a JSON object with its nulls, which mean something here."""
    return F.to_json(F.struct(*(columns or rows.columns)), {"ignoreNullFields": "false", "pretty": "true"})


def _at(folder: str, name: str) -> Column:
    return F.concat_ws("/", F.lit(folder.rstrip("/")), "video", F.lit(name)).alias("path")


def write_reports(rows: DataFrame, folder: str) -> int:
    """<folder>/<video>/report.json for each row, written by the tasks."""
    return files.write(rows.select(_at(folder, "report.json"), as_json(rows).alias("text")), folder)


def score_rows(curated: DataFrame) -> DataFrame:
    """One row a scored frame: video, rank and a score report's keys."""
    rows = curated.where("disposition = 'unique' AND scores IS NOT NULL")
    return rows.select("video", "rank", "file", F.col("origin").alias("path"), "scores.*")


def write_score_reports(curated: DataFrame, folder: str) -> int:
    """<folder>/<video>/score_report.json: an array of all scored frames, best first; error only where there is one."""
    keys = ("file", "path", "sharpness", "colorfulness", "brightness", "contrast", "composition", "total", "error")
    rows = score_rows(curated).select("video", "rank", F.to_json(F.struct(*keys)).alias("json"))
    lists = rows.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("rank", "json"))).alias("all"))
    text = F.concat(F.lit("[\n"), F.array_join(F.transform("all", lambda x: x["json"]), ",\n"), F.lit("\n]\n"))
    return files.write(lists.select(_at(folder, "score_report.json"), text.alias("text")), folder)


def summary_row(results: DataFrame, source: str, folder: str) -> DataFrame:
    """The batch summary as one row; results (index, video_name, status, ...) become its video_results, by index."""
    ok = F.col("status") == "success"
    one = results.agg(
        F.count("*").alias("total_videos"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("success", "skipped", "error")],
        F.count_if(~ok).alias("failed"),
        F.array_sort(F.collect_list(F.struct(*results.columns))).alias("video_results"),
    )
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    return one.select("total_videos", "success", "skipped", "error", "failed", F.lit(source).alias("input_folder"), F.lit(folder).alias("output_folder"), now.alias("generated_at"), "video_results")


def write_summary(spark: SparkSession, summary: DataFrame, folder: str) -> str:
    return files.write_text(spark, f"{folder.rstrip('/')}/_batch_summary.json", summary.select(as_json(summary).alias("j")).first().j)


def preview_rows(curated: DataFrame) -> DataFrame:
    """The first frames of each video in their order: video, frames (unique_no, file, origin)."""
    shown = curated.where((F.col("disposition") == "unique") & (F.col("unique_no") < PREVIEW))
    return shown.groupBy("video").agg(F.array_sort(F.collect_list(F.struct("unique_no", "file", "origin"))).alias("frames"))


def _uri(frame: dict) -> str:
    """The frame's bytes as a data URI; nothing for a file that can't be read."""
    try:
        content = files.read_bytes(frame["origin"])
    except OSError:
        return ""
    mime = "image/png" if frame["file"].lower().endswith(".png") else "image/jpeg"
    return f"data:{mime};base64,{b64encode(content).decode()}"


def preview_html(row: dict, columns: int) -> str:
    """A page for one video: its counters and at most PREVIEW frames."""
    numbers = [("raw", row["total_raw_frames"]), ("blurry", row["removed_blurry"]), ("duplicate", row["removed_duplicate"]), ("unique", row["final_unique_frames"]), ("reduced", row["reduction_rate"])]
    counters = "".join(f"<div><b>{escape(str(v))}</b>{k}</div>" for k, v in numbers)
    figures = "".join(f'<figure><img src="{_uri(f)}" alt=""><figcaption>{f["unique_no"] + 1:03d} {escape(f["file"])}</figcaption></figure>' for f in row["frames"])
    left = row["final_unique_frames"] - len(row["frames"])
    note = f"<p>The first {len(row['frames'])} of {row['final_unique_frames']} frames are shown.</p>" if left > 0 else ""
    title = escape(row["video"])
    return f'<!doctype html><meta charset="utf-8"><title>{title}</title><style>{_STYLE}.g{{grid-template-columns:repeat({columns},1fr)}}</style><h1>{title}</h1><div class="n">{counters}</div>{note}<div class="g">{figures}</div>\n'


def write_previews(reports: DataFrame, curated: DataFrame, folder: str, columns: int) -> list[str]:
    """preview.html of each video with a unique frame; returns notes on large pages. A task holds one page at a time."""
    counters = reports.select("video", "total_raw_frames", "removed_blurry", "removed_duplicate", "final_unique_frames", "reduction_rate")
    pages = counters.join(preview_rows(curated), "video").withColumn("path", _at(folder, "preview.html"))
    return files.commit(pages, lambda row: iter([preview_html(row, columns).encode("utf-8")]), folder, LARGE)[1]


def _quoted(text: Column) -> Column:
    """Percent-encoded, for a link."""
    for java, own in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        text = F.replace(F.url_encode(text) if java == "+" else text, F.lit(java), F.lit(own))
    return text


def gallery_lines(shown: DataFrame) -> DataFrame:
    """The page over a batch's frames (video, kind, file), a figure a line: value, in the order of the page; no rows give none.

    A section a video, files in their order with links relative to the page. Each line is made of its own row and its
    video's count, so that Spark sorts and cuts the page by ranges and no task or driver holds a section.
    """
    order = ("video", "kind", "file")
    counts = shown.groupBy("video").agg(F.count("*").alias("n"))
    total = counts.agg(F.count("*").alias("videos"), F.sum("n").alias("frames")).first()
    if not total.videos:
        return shown.select(F.col("file").alias("value")).limit(0)
    rows = shown.select(*order).join(counts, "video").withColumn("i", F.row_number().over(W.partitionBy("video").orderBy("kind", "file")))
    link = F.concat(_quoted(F.col("video")), F.lit("/unique_frames/"), _quoted(F.col("file")))
    number = F.format_string("%03d ", F.col("i"))
    figure = F.concat(F.lit('<figure><img loading="lazy" src="'), link, F.lit('" alt=""><figcaption>'), number, html_escape(F.col("file")), F.lit("</figcaption></figure>"))
    head = F.concat(F.lit("<h2>"), html_escape(F.col("video")), F.lit(" ("), F.col("n").cast("string"), F.lit(')</h2><div class="g">'))
    first, last = F.when(F.col("i") == 1, head).otherwise(""), F.when(F.col("i") == F.col("n"), "</div>").otherwise("")
    top = f'<!doctype html><meta charset="utf-8"><title>Batch</title><style>{_STYLE}.g{{grid-template-columns:repeat(5,1fr)}}</style><h1>{total.videos} videos, {total.frames} frames</h1>'
    title = shown.sparkSession.createDataFrame([(0, "", 0, "", top)], "part int, video string, kind int, file string, value string")
    body = rows.select(F.lit(1).alias("part"), *order, F.concat(first, figure, last).alias("value"))
    return title.unionByName(body).orderBy("part", *order).select("value")


def write_gallery(spark: SparkSession, shown: DataFrame, folder: str) -> str | None:
    """_batch_preview.html over existing outputs (sources.frames.outputs); None where there are no frames."""
    if shown.isEmpty():
        return None
    return files.concatenate(spark, gallery_lines(shown), f"{folder.rstrip('/')}/_batch_preview.html")
