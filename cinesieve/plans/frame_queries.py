"""Queries over frames: features, blur filter, ranks and deduplication.

BLUR, SIMILARITY and STRUCTURE are the thresholds for the grid frames.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinesieve.functions import grids, images
from cinesieve.functions.columns import exactly_rounded
from cinesieve.operators import blur, dedup, ranking, rounds
from cinesieve.sources.bindings import grid_frames

BLUR, SIMILARITY, STRUCTURE, TOP = 450.0, 0.60, 0.60, 5
#: Frames of a block and of a share where a video is deduplicated in rounds; the threshold for counting compared pairs.
BLOCK, SHARE, ALIKE = 64, 64, 0.998


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_frames(spark, sf_dir).select("video", "frame_order", dedup.grid_hash(F.col("px")).alias("item"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_frames(spark, sf_dir).select("video", "frame_order", dedup.grid_bytes(F.col("px")).alias("item"))


def q01_frame_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_frames(spark, sf_dir).select("video", "frame_order", F.size("px").cast("long").alias("n_px"))


def q02_pixel_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_frames(spark, sf_dir).select("video", "frame_order", F.array_join("px", ",").alias("pixels"))


def scored_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_frames(spark, sf_dir).select("video", "frame_order", grids.laplacian_variance(F.col("px")).alias("blur_score"))


def q04_sharp_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blur.judged(scored_blur(spark, sf_dir), BLUR).where("is_sharp").drop("is_sharp")


def q05_blurry_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blur.judged(scored_blur(spark, sf_dir), BLUR).where("NOT is_sharp").drop("is_sharp")


def q06_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_blur(spark, sf_dir).select("video", "frame_order", grids.sharpness(F.col("blur_score")).alias("sharpness"))


def q07_brightness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_frames(spark, sf_dir).select("video", "frame_order", grids.brightness(F.col("px")).alias("brightness"))


def q08_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_frames(spark, sf_dir).select("video", "frame_order", grids.contrast(F.col("px")).alias("contrast"))


def q09_colorfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid_frames(spark, sf_dir).select("video", "frame_order", grids.colorfulness(F.col("px")).alias("colorfulness"))


def q10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def composed(px: pd.Series) -> pd.Series:
        grids_ = np.stack(px.to_list()).astype(np.uint8).reshape(-1, 8, 8) if len(px) else np.zeros((0, 8, 8), np.uint8)
        return pd.Series(images.composition(grids_), dtype="float64")

    return grid_frames(spark, sf_dir).select("video", "frame_order", composed("px").alias("composition"))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted totals of four scores; composition has no place in them."""
    px = F.col("px")
    parts = grid_frames(spark, sf_dir).select(
        "video",
        "frame_order",
        grids.sharpness(grids.laplacian_variance(px)).alias("sharpness"),
        grids.colorfulness(px).alias("colorfulness"),
        grids.brightness(px).alias("brightness"),
        grids.contrast(px).alias("contrast"),
    )
    four = {n: F.col(n) for n in ("sharpness", "colorfulness", "brightness", "contrast")}
    return parts.select("video", "frame_order", exactly_rounded(grids.weighted(**four), 3).alias("total"))


def q12_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(totals(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


def q13_top_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranking.top(totals(spark, sf_dir), TOP)
    return rows.select("video", F.col("rank").cast("long").alias("rank"), "frame_order", "total", F.format_string("top_%03d.jpg", "rank").alias("file"))


def chunks(item):
    """A 64-bit binary hash as two longs of 32 bits."""
    return F.array(*[F.conv(F.hex(F.substring(item, a, 4)), 16, 10).cast("long") for a in (1, 5)])


def q14_grid_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hashed(spark, sf_dir).select("video", "frame_order", chunks(F.col("item"))[0].alias("hash_high"), chunks(F.col("item"))[1].alias("hash_low"))


def q15_hash_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame to the one before it in its video."""
    rows = hashed(spark, sf_dir).select("video", "frame_order", chunks(F.col("item")).alias("h"))
    w = W.partitionBy("video").orderBy("frame_order")
    pairs = rows.withColumns({"before": F.lag("frame_order").over(w), "hb": F.lag("h").over(w)}).where("before IS NOT NULL")
    return pairs.select("video", "frame_order", "before", grids.hamming_similarity(F.col("h"), F.col("hb"), 64).alias("similarity"))


def deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.greedy(hashed(spark, sf_dir), SIMILARITY, "phash", 64)


def q16_unique_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark, sf_dir).where("disposition = 'unique'").select("video", "frame_order")


def q17_duplicate_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(spark, sf_dir).where("disposition = 'duplicate'").select("video", "frame_order", "similarity")


def q18_structure_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame to the one before it in its video."""
    @F.pandas_udf("double")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        grids_ = lambda s: np.frombuffer(b"".join(s), np.uint8).reshape(-1, 8, 8)
        return pd.Series(images.ssim(grids_(a), grids_(b)), dtype="float64")

    w = W.partitionBy("video").orderBy("frame_order")
    pairs = pixels(spark, sf_dir).withColumns({"before": F.lag("frame_order").over(w), "old": F.lag("item").over(w)}).where("before IS NOT NULL")
    return pairs.select("video", "frame_order", "before", exactly_rounded(similar("old", "item"), 6).alias("similarity"))


def q19_structure_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup.greedy(pixels(spark, sf_dir), STRUCTURE, "ssim", 8)
    return rows.select("video", "frame_order", "disposition", exactly_rounded(F.col("similarity"), 6).alias("similarity"))


def q40_greedy_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every video in rounds: blocks in order, all later frames against each block's kept ones."""
    return rounds.greedy(hashed(spark, sf_dir), SIMILARITY, "phash", 64, BLOCK, SHARE)


def q41_structure_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the pairs that deduplication by structure is offered, those that it has to compare in full."""
    return dedup.structure_pairs(pixels(spark, sf_dir), ALIKE, 8)


QUERIES = {
    "q01_frame_scan": q01_frame_scan,
    "q02_pixel_grid": q02_pixel_grid,
    "q03_laplacian_variance": scored_blur,
    "q04_sharp_frames": q04_sharp_frames,
    "q05_blurry_frames": q05_blurry_frames,
    "q06_sharpness": q06_sharpness,
    "q07_brightness": q07_brightness,
    "q08_contrast": q08_contrast,
    "q09_colorfulness": q09_colorfulness,
    "q10_composition": q10_composition,
    "q11_weighted_total": totals,
    "q12_rank": q12_rank,
    "q13_top_frames": q13_top_frames,
    "q14_grid_hash": q14_grid_hash,
    "q15_hash_similarity": q15_hash_similarity,
    "q16_unique_frames": q16_unique_frames,
    "q17_duplicate_frames": q17_duplicate_frames,
    "q18_structure_similarity": q18_structure_similarity,
    "q19_structure_unique": q19_structure_unique,
    "q40_greedy_rounds": q40_greedy_rounds,
    "q41_structure_pairs": q41_structure_pairs,
}

# The oracle: the same definitions in SQL, from the embeddings on.
PX = "list_transform(embedding, lambda x: CAST(least(255, greatest(0, floor(128 + 40 * CAST(x AS DOUBLE) + 0.5))) AS BIGINT))"
FRAMES = f"frames AS (SELECT CAST(label AS BIGINT) AS video, vec_id AS frame_order, {PX} AS px FROM embeddings)"
_ROW = "px[1 + 8 * (CASE WHEN {0} < 0 THEN 1 WHEN {0} > 7 THEN 6 ELSE {0} END) + i % 8]"
_COLUMN = "px[1 + 8 * (i // 8) + (CASE WHEN {0} < 0 THEN 1 WHEN {0} > 7 THEN 6 ELSE {0} END)]"
_LAP = " + ".join([_ROW.format("i // 8 - 1"), _ROW.format("i // 8 + 1"), _COLUMN.format("i % 8 - 1"), _COLUMN.format("i % 8 + 1")]) + " - 4 * px[1 + i]"
_VARIANCE = "(CAST(64 * list_sum(list_transform({0}, lambda v: v * v)) AS DOUBLE) - pow(CAST(list_sum({0}) AS DOUBLE), 2)) / 4096.0"
BLURRED = f"""{FRAMES}, laps AS (SELECT *, list_transform(range(64), lambda i: {_LAP}) AS lap FROM frames),
blurred AS (SELECT *, {_VARIANCE.format("lap")} AS blur_score FROM laps)"""
_SHARP = "least(blur_score / 600.0, 1.0)"
_BRIGHT = "1 - abs(list_sum(px) / 64.0 - 128.0) / 128.0"
_CONTRAST = f"least(sqrt({_VARIANCE.format('px')}) / 80.0, 1.0)"
_RG = "list_sum(list_transform(range(16), lambda i: abs(px[4 * i + 3] - px[4 * i + 2]))) / 16.0"
_YB = "list_sum(list_transform(range(16), lambda i: abs(px[4 * i + 3] + px[4 * i + 2] - 2 * px[4 * i + 1]))) / 32.0"
_COLOR = f"least(({_RG} + {_YB}) / 80.0, 1.0)"
TOTALS = f"""{BLURRED}, totals AS (SELECT video, frame_order, CAST(printf('%.3f', {_SHARP} * 0.35 + {_COLOR} * CAST(0.2 AS DOUBLE) + ({_BRIGHT}) * CAST(0.2 AS DOUBLE) + {_CONTRAST} * 0.15) AS DOUBLE) AS total FROM blurred)"""
RANKED = f"{TOTALS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY total DESC, frame_order) AS rank FROM totals)"
_COS = "(SELECT list(c) FROM (SELECT u, list(CAST(floor(cos((2 * x + 1) * u * pi() / 16) * 4096 + 0.5) AS BIGINT) ORDER BY x) AS c FROM range(8) a(u), range(8) b(x) GROUP BY u ORDER BY u))"
HASHED = f"""{FRAMES}, cosines AS (SELECT {_COS} AS c),
half AS (SELECT video, frame_order, c, list_transform(range(64), lambda k: list_sum(list_transform(range(8), lambda y: c[1 + k // 8][1 + y] * px[1 + 8 * y + k % 8]))) AS h FROM frames, cosines),
low AS (SELECT video, frame_order, list_transform(range(64), lambda k: CAST(list_sum(list_transform(range(8), lambda x: h[1 + 8 * (k // 8) + x] * c[1 + k % 8][1 + x])) AS BIGINT)) AS low FROM half),
bits AS (SELECT video, frame_order, list_transform(low, lambda v: CASE WHEN 2 * v > list_sort(low)[32] + list_sort(low)[33] THEN 1 ELSE 0 END) AS bits FROM low),
hashed AS (SELECT video, frame_order, CAST(list_sum(list_transform(range(32), lambda k: bits[1 + k] * (CAST(1 AS BIGINT) << (31 - k)))) AS BIGINT) AS hash_high, CAST(list_sum(list_transform(range(32), lambda k: bits[33 + k] * (CAST(1 AS BIGINT) << (31 - k)))) AS BIGINT) AS hash_low FROM bits)"""
_HAMMING = "1 - (bit_count(xor(a.hash_high, b.hash_high)) + bit_count(xor(a.hash_low, b.hash_low))) / 64.0"


def folded(sims: str, source: str) -> str:
    """The greedy rule as a recursion over frame numbers: kept lists grow by frames without an earlier kept match."""
    return f"""{sims},
hits AS (SELECT video, b AS frame_order, list(a ORDER BY a) AS dups FROM sims WHERE hit GROUP BY video, b),
numbered AS (SELECT s.video, s.frame_order, coalesce(h.dups, CAST([] AS BIGINT[])) AS dups, row_number() OVER (PARTITION BY s.video ORDER BY s.frame_order) AS rn FROM {source} s LEFT JOIN hits h ON h.video = s.video AND h.frame_order = s.frame_order),
fold(video, rn, kept) AS (SELECT DISTINCT video, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM numbered
  UNION ALL SELECT f.video, n.rn, CASE WHEN len(list_intersect(f.kept, n.dups)) = 0 THEN list_append(f.kept, n.frame_order) ELSE f.kept END FROM fold f JOIN numbered n ON n.video = f.video AND n.rn = f.rn + 1),
kept AS (SELECT f.video, unnest(f.kept) AS frame_order FROM fold f JOIN (SELECT video, max(rn) AS rn FROM numbered GROUP BY video) m ON m.video = f.video AND m.rn = f.rn),
first_hit AS (SELECT s.video, s.b AS frame_order, arg_min(s.sim, s.a) AS similarity FROM sims s JOIN kept k ON k.video = s.video AND k.frame_order = s.a WHERE s.hit GROUP BY s.video, s.b)"""


_HASH_SIMS = f"{HASHED}, sims AS (SELECT a.video, a.frame_order AS a, b.frame_order AS b, {_HAMMING} AS sim, {_HAMMING} >= {SIMILARITY} AS hit FROM hashed a JOIN hashed b ON a.video = b.video AND a.frame_order < b.frame_order)"
DEDUPED = "WITH RECURSIVE " + folded(_HASH_SIMS, "hashed")
_PLACES = "list_transform(range(49), lambda k: 1 + 8 * (w // 2 + k // 7) + w % 2 + k % 7)"
STRUCTURES = f"""{FRAMES}, windows AS (SELECT video, frame_order, w, list_transform({_PLACES}, lambda k: px[k]) AS v FROM frames, range(4) r(w)),
moments AS (SELECT *, CAST(list_sum(v) AS BIGINT) / 49.0 AS m, CAST(list_sum(list_transform(v, lambda x: x * x)) AS BIGINT) / 49.0 AS m2 FROM windows)"""
_S = """((2 * a.m * b.m + 6.5025) * (2 * (49.0 / 48 * (list_sum(list_transform(range(49), lambda k: a.v[1 + k] * b.v[1 + k])) / 49.0 - a.m * b.m)) + 58.5225))
/ ((a.m * a.m + b.m * b.m + 6.5025) * (49.0 / 48 * (a.m2 - a.m * a.m) + 49.0 / 48 * (b.m2 - b.m * b.m) + 58.5225))"""
_LUMINANCE = "(2 * a.m * b.m + 6.5025) / (a.m * a.m + b.m * b.m + 6.5025)"
_DEVIATIONS = "(2 * 49.0 / 48 * sqrt(greatest(0, (a.m2 - a.m * a.m) * (b.m2 - b.m * b.m))) + 58.5225) / (49.0 / 48 * (a.m2 - a.m * a.m + b.m2 - b.m * b.m) + 58.5225)"


def structure_sims(threshold: float) -> str:
    """Pairs with their similarity, the bound on it that means and variances give, and that after half of the windows."""
    return f"""{STRUCTURES}, sims AS (SELECT video, a, b, sim, bound, halfway, sim >= {threshold} AS hit FROM (SELECT a.video, a.frame_order AS a, b.frame_order AS b, sum({_S}) / 4 AS sim, sum({_LUMINANCE} * {_DEVIATIONS}) / 4 AS bound, sum(CASE WHEN a.w < 2 THEN {_S} ELSE {_LUMINANCE} * {_DEVIATIONS} END) / 4 AS halfway
FROM moments a JOIN moments b ON a.video = b.video AND a.frame_order < b.frame_order AND a.w = b.w GROUP BY ALL))"""


#: Pairs with a kept frame, up to the later frame's first match.
_OFFERED = f"""WITH RECURSIVE {folded(structure_sims(ALIKE), "frames")},
firsts AS (SELECT s.video, s.b, min(s.a) AS a FROM sims s JOIN kept k ON k.video = s.video AND k.frame_order = s.a WHERE s.hit GROUP BY s.video, s.b),
offered AS (SELECT s.video, s.bound, s.halfway FROM sims s JOIN kept k ON k.video = s.video AND k.frame_order = s.a LEFT JOIN firsts f ON f.video = s.video AND f.b = s.b WHERE f.a IS NULL OR s.a <= f.a)"""

_AT = "px[1 + 8 * least(7, greatest(0, y + ({0}))) + least(7, greatest(0, x + ({1})))]"
_SIDES = [" + ".join(f"{abs(w)} * {_AT.format(*at)}" for at, w in side) for side in (
    [((-1, 1), 1), ((0, 1), 2), ((1, 1), 1)], [((-1, -1), 1), ((0, -1), 2), ((1, -1), 1)], [((1, -1), 1), ((1, 0), 2), ((1, 1), 1)], [((-1, -1), 1), ((-1, 0), 2), ((-1, 1), 1)],
)]
#: Edges by gradients, suppression along them, and reachability of weak ones from strong ones as a recursion over pixels.
EDGES = f"""{FRAMES}, gradients AS (SELECT video, frame_order, y, x, ({_SIDES[0]}) - ({_SIDES[1]}) AS dx, ({_SIDES[2]}) - ({_SIDES[3]}) AS dy FROM frames, range(8) a(y), range(8) b(x)),
sized AS (SELECT *, abs(dx) + abs(dy) AS size, abs(dy) > tan(pi() * 3 / 8) * abs(dx) AS steep, abs(dy) < tan(pi() / 8) * abs(dx) AS flat FROM gradients),
aimed AS (SELECT *, CASE WHEN flat THEN 0 ELSE 1 END AS oy, CASE WHEN flat THEN 1 WHEN steep THEN 0 WHEN (dx >= 0) = (dy >= 0) THEN 1 ELSE -1 END AS ox FROM sized),
peaks AS (SELECT s.* FROM aimed s LEFT JOIN sized b ON b.video = s.video AND b.frame_order = s.frame_order AND b.y = s.y - s.oy AND b.x = s.x - s.ox
  LEFT JOIN sized a ON a.video = s.video AND a.frame_order = s.frame_order AND a.y = s.y + s.oy AND a.x = s.x + s.ox
  WHERE s.size > {images.EDGE_LOW} AND s.size > coalesce(b.size, 0) AND (s.size > coalesce(a.size, 0) OR (s.flat OR s.steep) AND s.size = coalesce(a.size, 0))),
edges AS (SELECT video, frame_order, y, x FROM peaks WHERE size > {images.EDGE_HIGH}
  UNION SELECT p.video, p.frame_order, p.y, p.x FROM edges e JOIN peaks p ON p.video = e.video AND p.frame_order = e.frame_order AND abs(p.y - e.y) <= 1 AND abs(p.x - e.x) <= 1),
edge_counts AS (SELECT video, frame_order, CAST(255 * count(*) AS DOUBLE) AS whole, CAST(255 * count(*) FILTER (y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5) AS DOUBLE) AS middle FROM edges GROUP BY video, frame_order)"""

ORACLE_SQL = {
    "q10_composition": f"WITH RECURSIVE {EDGES} SELECT f.video, f.frame_order, least(coalesce(middle, 0) / (coalesce(whole, 0) + CAST(1e-6 AS DOUBLE)) * CAST(1.5 AS DOUBLE), CAST(1 AS DOUBLE)) AS composition FROM frames f LEFT JOIN edge_counts c ON c.video = f.video AND c.frame_order = f.frame_order",
    "q01_frame_scan": f"WITH {FRAMES} SELECT video, frame_order, len(px) AS n_px FROM frames",
    "q02_pixel_grid": f"WITH {FRAMES} SELECT video, frame_order, array_to_string(px, ',') AS pixels FROM frames",
    "q03_laplacian_variance": f"WITH {BLURRED} SELECT video, frame_order, blur_score FROM blurred",
    "q04_sharp_frames": f"WITH {BLURRED} SELECT video, frame_order, blur_score FROM blurred WHERE blur_score >= {BLUR}",
    "q05_blurry_frames": f"WITH {BLURRED} SELECT video, frame_order, blur_score FROM blurred WHERE blur_score < {BLUR}",
    "q06_sharpness": f"WITH {BLURRED} SELECT video, frame_order, {_SHARP} AS sharpness FROM blurred",
    "q07_brightness": f"WITH {FRAMES} SELECT video, frame_order, {_BRIGHT} AS brightness FROM frames",
    "q08_contrast": f"WITH {FRAMES} SELECT video, frame_order, {_CONTRAST} AS contrast FROM frames",
    "q09_colorfulness": f"WITH {FRAMES} SELECT video, frame_order, {_COLOR} AS colorfulness FROM frames",
    "q11_weighted_total": f"WITH {TOTALS} SELECT video, frame_order, total FROM totals",
    "q12_rank": f"WITH {RANKED} SELECT video, frame_order, total, rank FROM ranked",
    "q13_top_frames": f"WITH {RANKED} SELECT video, rank, frame_order, total, printf('top_%03d.jpg', rank) AS file FROM ranked WHERE rank <= {TOP}",
    "q14_grid_hash": f"WITH {HASHED} SELECT video, frame_order, hash_high, hash_low FROM hashed",
    "q15_hash_similarity": f"WITH {HASHED}, n AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY frame_order) AS rn FROM hashed) SELECT a.video, a.frame_order, b.frame_order AS before, {_HAMMING} AS similarity FROM n a JOIN n b ON a.video = b.video AND a.rn = b.rn + 1",
    "q16_unique_frames": f"{DEDUPED} SELECT video, frame_order FROM kept",
    "q17_duplicate_frames": f"{DEDUPED} SELECT video, frame_order, similarity FROM first_hit",
    "q18_structure_similarity": f"""WITH {STRUCTURES}, n AS (SELECT *, dense_rank() OVER (PARTITION BY video ORDER BY frame_order) AS rn FROM moments)
SELECT b.video, b.frame_order, a.frame_order AS before, CAST(printf('%.6f', sum({_S}) / 4) AS DOUBLE) AS similarity FROM n a JOIN n b ON a.video = b.video AND b.rn = a.rn + 1 AND a.w = b.w GROUP BY ALL""",
    "q19_structure_unique": f"""WITH RECURSIVE {folded(structure_sims(STRUCTURE), "frames")} SELECT video, frame_order, 'unique' AS disposition, CAST(NULL AS DOUBLE) AS similarity FROM kept
UNION ALL SELECT video, frame_order, 'duplicate', CAST(printf('%.6f', greatest(0, similarity)) AS DOUBLE) FROM first_hit""",
    "q40_greedy_rounds": f"{DEDUPED} SELECT video, frame_order, 'unique' AS disposition, CAST(NULL AS DOUBLE) AS similarity FROM kept UNION ALL SELECT video, frame_order, 'duplicate', similarity FROM first_hit",
    "q41_structure_pairs": f"""{_OFFERED}, counts AS (SELECT video, count(*) AS offered, count(*) FILTER (bound >= {ALIKE} - 1e-6 AND halfway >= {ALIKE} - 1e-6) AS compared FROM offered GROUP BY video)
SELECT f.video, f.frames, coalesce(offered, 0) AS offered, coalesce(compared, 0) AS compared FROM (SELECT video, count(*) AS frames FROM frames GROUP BY video) f LEFT JOIN counts USING (video)""",
}
