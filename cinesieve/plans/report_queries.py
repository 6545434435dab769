"""Queries over curated frames and reports, small text operators, and the streaming form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinesieve.functions import columns, grids
from cinesieve.operators import dedup, stats
from cinesieve.plans import frame_queries as fq
from cinesieve.plans.curate import disposed
from cinesieve.sources.bindings import grid_frames, read
from cinesieve.sources.storage import scratch
from cinesieve.streaming import dedup as streaming
from cinesieve.streaming import ordered

GALLERY, EMPTY = 150, 700.0


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All grid frames with their disposition."""
    px = F.col("px")
    scored = grid_frames(spark, sf_dir).select("video", "frame_order", grids.laplacian_variance(px).alias("blur_score"), dedup.grid_hash(px).alias("item"))
    return disposed(scored, fq.BLUR, fq.SIMILARITY, "phash", 64)


def q20_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.funnel(frames(spark, sf_dir))


def q21_removed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = frames(spark, sf_dir).withColumn("file", F.format_string("frame_%05d.jpg", "frame_order"))
    lists = stats.removed_lists(named)
    return lists.select("video", F.array_join("blurry_files_removed", ",").alias("blurry"), F.array_join(F.transform("duplicate_files_removed", lambda x: x["file"]), ",").alias("duplicates"))


def q22_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.reductions(stats.funnel(frames(spark, sf_dir))).select("video", "reduction")


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funnel with a status that stands for the outcomes of a batch."""
    status = F.when(F.col("video") % 5 == 4, "error").when(F.col("video") % 5 == 3, "skipped").otherwise("success")
    return stats.funnel(frames(spark, sf_dir)).withColumn("status", status)


def q23_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.batch(videos(spark, sf_dir))


def q24_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.by_status(videos(spark, sf_dir))


def q25_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.failures(videos(spark, sf_dir).withColumn("video", F.concat(F.lit("video"), F.col("video").cast("string"))))


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of videos that have a unique frame: jpg before png, each by path, numbered from 1."""
    all_frames = frames(spark, sf_dir)
    shown = all_frames.where("disposition = 'unique'")
    kind = F.when(F.col("frame_order") % 4 == 0, "png").otherwise("jpg")
    files = all_frames.join(shown.select("video").distinct(), "video", "left_semi").select("video", F.concat(F.format_string("frame_%05d.", "frame_order"), kind).alias("file"))
    jpg, png = (files.where(F.col("file").endswith(e)).withColumn("kind", F.lit(i)) for i, e in enumerate(("jpg", "png")))
    order = W.partitionBy("video").orderBy("kind", "file")
    return jpg.unionByName(png).withColumn("number", F.row_number().over(order).cast("long")).drop("kind")


def q32_gallery_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first files of each gallery, and how many the page leaves out."""
    rows = gallery(spark, sf_dir)
    counts = rows.groupBy("video").agg(F.count("*").alias("n"))
    shown = rows.where(F.col("number") <= GALLERY).join(counts, "video")
    return shown.select("video", "number", "file", F.greatest(F.lit(0), F.col("n") - GALLERY).alias("left_out"))


def q33_without_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos none of whose frames is sharp by a strict threshold."""
    scored = fq.scored_blur(spark, sf_dir)
    sharp = scored.where(F.col("blur_score") >= EMPTY)
    return scored.select("video").distinct().join(sharp.select("video"), "video", "left_anti")


def q34_summary_or_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a batch summary where there are any, else of single reports; each side has videos that the other lacks."""
    funnel = stats.funnel(frames(spark, sf_dir))
    reports = funnel.where("video % 3 < 2").select(F.col("video").alias("report_video"), F.col("final_unique_frames").alias("report_frames"))
    summary = funnel.where("video % 2 = 0").select(F.col("video").alias("summary_video"), F.col("total_raw_frames").alias("summary_frames"))
    rows = summary.join(reports, F.col("summary_video") == F.col("report_video"), "full_outer")
    return rows.select(
        F.coalesce("summary_video", "report_video").alias("video"),
        F.when(F.col("summary_video").isNull(), "report").otherwise("summary").alias("origin"),
        F.coalesce("summary_frames", "report_frames").alias("frames"),
    )


def q35_progress_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda line: ~columns.is_progress_line(line))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("long").alias("lines"), F.size(kept).cast("long").alias("kept"))


def q36_path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", r"[?#].*$", "")
    end = columns.suffix(path)
    video = F.lower(end).isin(".mp4", ".mov", ".avi", ".mkv", ".webm", ".m4v")
    return read(spark, sf_dir, "pages").select("page_id", columns.basename(path).alias("name"), columns.stem(path).alias("stem"), end.alias("suffix"), video.alias("is_video"))


def q37_html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    escaped = columns.html_escape(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", F.length(escaped).cast("long").alias("chars"), F.md5(escaped.cast("binary")).alias("digest"))


def q38_json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("events"), F.count(k).alias("with_k"), F.sum(k).alias("sum_k"))


def q39_streaming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unique frames of one trigger over all that the stream holds."""
    schema = read(spark, sf_dir, "embeddings").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/{{embeddings.parquet}}")  # a stream takes a file by a pattern only: of this name alone
    px = rows.select(F.col("label").cast("long").alias("video"), F.col("vec_id").alias("frame_order"), dedup.grid_hash(grids.gray(F.col("embedding"))).alias("item"))
    out, state = scratch(spark, "stream"), scratch(spark, "stream-state")
    query = streaming.greedy(px, fq.SIMILARITY, 64).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(streaming.OUTPUT).parquet(out).where("disposition = 'unique'").select("video", "frame_order")


#: Frames are a millisecond apart and arrive at most DISORDER of them late, in ARRIVALS parts, one a trigger.
DISORDER, ARRIVALS = 200, 3


def q42_streaming_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames from a stream whose parts overlap and are shuffled; the last one holds a row that moves the clock on. The
    query is started again from its checkpoint for each part."""
    arriving, out, state = (scratch(spark, label) for label in ("arriving", "stream", "stream-state"))
    rows = fq.hashed(spark, sf_dir)
    first, last = (n or 0 for n in rows.agg(F.min("frame_order"), F.max("frame_order")).first())
    place = F.col("frame_order") - first + 1  # the watermark begins at 0
    frames_ = rows.select("video", "frame_order", "item", F.timestamp_millis(place).alias("t"))
    number = F.floor((place + F.pmod(F.xxhash64("frame_order"), F.lit(DISORDER))) * ARRIVALS / (last - first + DISORDER + 1))
    clock = spark.range(1).select(F.lit(None).cast("long").alias("video"), F.lit(None).cast("long").alias("frame_order"), F.lit(None).cast("binary").alias("item"), F.timestamp_millis(F.lit(last - first + 3 * DISORDER + 1)).alias("t"))
    parts = [frames_.where(number == i) for i in range(ARRIVALS)]
    for part in [*parts[:-1], parts[-1].unionByName(clock)]:
        part.repartition(F.xxhash64("item")).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(clock.schema).parquet(arriving)
        with ordered.rocksdb(spark):
            query = ordered.greedy(stream, fq.SIMILARITY, 64, f"{2 * DISORDER} milliseconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
            query.awaitTermination()
    return spark.read.schema(ordered.OUTPUT).parquet(out)


QUERIES = {
    "q20_funnel": q20_funnel,
    "q21_removed_lists": q21_removed_lists,
    "q22_reductions": q22_reductions,
    "q23_batch": q23_batch,
    "q24_by_status": q24_by_status,
    "q25_failures": q25_failures,
    "q31_gallery": gallery,
    "q32_gallery_cap": q32_gallery_cap,
    "q33_without_frames": q33_without_frames,
    "q34_summary_or_report": q34_summary_or_report,
    "q35_progress_lines": q35_progress_lines,
    "q36_path_parts": q36_path_parts,
    "q37_html_escape": q37_html_escape,
    "q38_json_field": q38_json_field,
    "q39_streaming_dedup": q39_streaming_dedup,
    "q42_streaming_out_of_order": q42_streaming_out_of_order,
}

_SHARP = f"{fq.HASHED}, {fq.BLURRED.removeprefix(fq.FRAMES + ', ')}, sharp AS (SELECT h.* FROM hashed h JOIN blurred b ON h.video = b.video AND h.frame_order = b.frame_order WHERE b.blur_score >= {fq.BLUR})"
_SIMS = f"{_SHARP}, sims AS (SELECT a.video, a.frame_order AS a, b.frame_order AS b, {fq._HAMMING} AS sim, {fq._HAMMING} >= {fq.SIMILARITY} AS hit FROM sharp a JOIN sharp b ON a.video = b.video AND a.frame_order < b.frame_order)"
_DISPOSED = f"""WITH RECURSIVE {fq.folded(_SIMS, "sharp")}, disposed AS (SELECT b.video, b.frame_order, CASE WHEN b.blur_score < {fq.BLUR} THEN 'blurry' WHEN k.frame_order IS NULL THEN 'duplicate' ELSE 'unique' END AS disposition
FROM blurred b LEFT JOIN kept k ON b.video = k.video AND b.frame_order = k.frame_order)"""
_FUNNEL = f"""{_DISPOSED}, funnel AS (SELECT video, count(*) AS total_raw_frames, count(*) FILTER (disposition <> 'blurry') AS after_blur, count(*) FILTER (disposition = 'unique') AS after_dedup, count(*) FILTER (disposition = 'blurry') AS removed_blurry,
count(*) FILTER (disposition = 'duplicate') AS removed_duplicate, count(*) FILTER (disposition = 'unique') AS final_unique_frames FROM disposed GROUP BY video),
videos AS (SELECT *, CASE video % 5 WHEN 4 THEN 'error' WHEN 3 THEN 'skipped' ELSE 'success' END AS status FROM funnel)"""
_OK = "CAST(coalesce(sum({0}) FILTER (status = 'success'), 0) AS BIGINT)"
_BATCH = f"""{_FUNNEL}, batch AS (SELECT count(*) AS total_videos, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status <> 'success') AS failed,
{', '.join(f'{_OK.format(c)} AS {c}' for c in ('total_raw_frames', 'removed_blurry', 'removed_duplicate', 'final_unique_frames'))} FROM videos)"""
_GALLERY = f"""{_DISPOSED}, files AS (SELECT video, printf('frame_%05d.', frame_order) || CASE WHEN frame_order % 4 = 0 THEN 'png' ELSE 'jpg' END AS file FROM disposed WHERE video IN (SELECT video FROM disposed WHERE disposition = 'unique')),
gallery AS (SELECT video, file, row_number() OVER (PARTITION BY video ORDER BY CASE WHEN file LIKE '%jpg' THEN 0 ELSE 1 END, file) AS number FROM files)"""
_ESCAPED = "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"

ORACLE_SQL = {
    "q20_funnel": f"{_FUNNEL} SELECT * FROM funnel",
    "q21_removed_lists": f"""{_DISPOSED} SELECT video, coalesce(string_agg(printf('frame_%05d.jpg', frame_order), ',' ORDER BY frame_order) FILTER (disposition = 'blurry'), '') AS blurry,
coalesce(string_agg(printf('frame_%05d.jpg', frame_order), ',' ORDER BY frame_order) FILTER (disposition = 'duplicate'), '') AS duplicates FROM disposed GROUP BY video""",
    "q22_reductions": f"{_FUNNEL} SELECT video, (1 - final_unique_frames / greatest(total_raw_frames, 1)) * 100 AS reduction FROM funnel",
    "q23_batch": f"{_BATCH} SELECT *, CASE WHEN total_raw_frames = 0 THEN 0.0 ELSE CAST(printf('%.1f', CAST(100.0 AS DOUBLE) * (total_raw_frames - final_unique_frames) / total_raw_frames) AS DOUBLE) END AS overall_reduction FROM batch",
    "q24_by_status": f"{_FUNNEL} SELECT status, count(*) AS videos, CAST(sum(total_raw_frames) AS BIGINT) AS frames FROM videos GROUP BY ROLLUP (status)",
    "q25_failures": f"{_FUNNEL} SELECT count(*) FILTER (status <> 'success') AS n_failed, coalesce(string_agg('video' || video, ', ' ORDER BY 'video' || video) FILTER (status <> 'success'), '') AS names FROM videos",
    "q31_gallery": f"{_GALLERY} SELECT video, file, number FROM gallery",
    "q32_gallery_cap": f"{_GALLERY} SELECT video, number, file, greatest(0, count(*) OVER (PARTITION BY video) - {GALLERY}) AS left_out FROM gallery QUALIFY number <= {GALLERY}",
    "q33_without_frames": f"WITH {fq.BLURRED} SELECT DISTINCT video FROM blurred WHERE video NOT IN (SELECT video FROM blurred WHERE blur_score >= {EMPTY})",
    "q34_summary_or_report": f"{_FUNNEL} SELECT video, 'summary' AS origin, total_raw_frames AS frames FROM funnel WHERE video % 2 = 0 UNION ALL SELECT video, 'report', final_unique_frames FROM funnel WHERE video % 3 < 2 AND video % 2 <> 0",
    "q35_progress_lines": r"SELECT doc_id, len(string_split(text, chr(10))) AS lines, len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '\d+%\|'))) AS kept FROM documents",
    "q36_path_parts": r"""WITH p AS (SELECT page_id, split_part(regexp_replace(url, '[?#].*$', ''), '/', -1) AS name FROM pages)
SELECT page_id, name, regexp_replace(name, '^(.+)\.[^.]+$', '\1') AS stem, regexp_extract(name, '^.+(\.[^.]+)$', 1) AS suffix, lower(regexp_extract(name, '^.+(\.[^.]+)$', 1)) IN ('.mp4', '.mov', '.avi', '.mkv', '.webm', '.m4v') AS is_video FROM p""",
    "q37_html_escape": f"SELECT page_id, length({_ESCAPED}) AS chars, md5({_ESCAPED}) AS digest FROM pages",
    "q38_json_field": "SELECT event_type, count(*) AS events, count(k) AS with_k, CAST(sum(k) AS BIGINT) AS sum_k FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type",
    "q39_streaming_dedup": f"{fq.DEDUPED} SELECT video, frame_order FROM kept",
    "q42_streaming_out_of_order": fq.ORACLE_SQL["q40_greedy_rounds"],
}
