"""Sampling frames from a timeline: at a fixed rate, or one in the middle of each scene.

A timeline is a DataFrame of key (the video), t (microseconds), order (breaks ties in t) and value (what a frame shows).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The least change that counts as a cut and the frames on either side that it is compared with.
LEAST_CHANGE, REACH = 15.0, 2


def by_rate(timeline: DataFrame, period_us: int) -> DataFrame:
    """The first frame of each period of each video: key, bucket, t, order, value. One aggregate with partial sums."""
    bucket = F.expr(f"t div {period_us}")
    return timeline.groupBy("key", bucket.alias("bucket")).agg(F.min_by(F.struct("t", "order", "value"), F.struct("t", "order")).alias("f")).select("key", "bucket", "f.*")


def cuts(timeline: DataFrame, threshold: float = 27.0) -> DataFrame:
    """timeline with change (to the frame before), ratio (to the neighbours' mean change) and cut.

    A cut changes at least LEAST_CHANGE and `threshold` / 10 times the mean of the two frames on either side; frames without
    two neighbours on each side are no cuts.
    """
    w = W.partitionBy("key").orderBy("t", "order")
    near = w.rowsBetween(-REACH, REACH)
    changes = timeline.withColumn("change", F.abs(F.col("value") - F.lag("value").over(w)))
    around = changes.withColumns({"near_sum": F.sum("change").over(near), "near_n": F.count("change").over(near)})
    mean = (F.col("near_sum") - F.col("change")) / (2 * REACH)
    ratio = F.when(F.col("near_n") == 2 * REACH + 1, F.when(mean == 0, F.lit(255.0)).otherwise(F.col("change") / mean))
    cut = F.coalesce((F.col("change") >= LEAST_CHANGE) & (ratio >= threshold / 10), F.lit(False))
    return around.withColumn("ratio", ratio).withColumn("cut", cut).drop("near_sum", "near_n")


Find = Callable[[DataFrame, float], DataFrame]


def _spanned(timeline: DataFrame, threshold: float, find: Find) -> DataFrame:
    """The frames of videos with a cut, with scene (from 0), start_us and end_us: windows over one shuffle by key."""
    w = W.partitionBy("key").orderBy("t", "order")
    numbered = find(timeline, threshold).withColumn("scene", F.sum(F.col("cut").cast("long")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    own, by_scene = W.partitionBy("key", "scene"), W.partitionBy("key").orderBy("scene")
    spans = numbered.withColumns({
        "start_us": F.min("t").over(own),
        "last_us": F.max("t").over(own),
        "next_us": F.min("t").over(by_scene.rangeBetween(1, 1)),
        "last_scene": F.max("scene").over(W.partitionBy("key")),
    })
    return spans.where("last_scene > 0").withColumn("end_us", F.coalesce("next_us", "last_us")).drop("next_us", "last_us", "last_scene")


def scenes(timeline: DataFrame, threshold: float = 27.0, find: Find = cuts) -> DataFrame:
    """key, scene (from 0), start_us, end_us of videos with a cut; videos without one have no scenes.

    A scene ends where the next begins, the last one at the last frame. `find` marks the cuts: `cuts` by the timeline's value, or
    operators.detector.cuts by its change.
    """
    return _spanned(timeline, threshold, find).select("key", "scene", "start_us", "end_us").distinct()


def scene_frames(timeline: DataFrame, threshold: float = 27.0, find: Find = cuts) -> DataFrame:
    """The frame nearest to each scene's midpoint (ties: the earlier): key, scene, start_us, end_us, t, order, value.

    Frames know their scene and its span from the windows, so the nearest one is an aggregate and no join is needed.
    """
    away = F.abs(F.col("t") - F.expr("(start_us + end_us) div 2"))
    best = F.min_by(F.struct("t", "order", "value"), F.struct("away", "t", "order"))
    rows = _spanned(timeline, threshold, find).withColumn("away", away)
    return rows.groupBy("key", "scene", "start_us", "end_us").agg(best.alias("f")).select("key", "scene", "start_us", "end_us", "f.*")


def by_scene_or_rate(timeline: DataFrame, threshold: float = 27.0, period_us: int = 1_000_000, find: Find = cuts) -> DataFrame:
    """Scene frames, and for videos without scenes one frame a period: key, mode, number, t, order, value."""
    of_scenes = scene_frames(timeline, threshold, find).select("key", F.lit("scene").alias("mode"), F.col("scene").alias("number"), "t", "order", "value")
    without = timeline.join(of_scenes.select("key").distinct(), "key", "left_anti")
    of_rate = by_rate(without, period_us).select("key", F.lit("fps").alias("mode"), F.col("bucket").alias("number"), "t", "order", "value")
    return of_scenes.unionByName(of_rate)


def sample(timeline: DataFrame, mode: str = "fps", fps: float = 5.0, threshold: float = 27.0, find: Find = cuts) -> DataFrame:
    """By scenes for mode "scene" (at one frame a second where there are none), at the rate for any other."""
    if mode == "scene":
        return by_scene_or_rate(timeline, threshold, find=find)
    return by_rate(timeline, round(1_000_000 / fps)).select("key", F.lit("fps").alias("mode"), F.col("bucket").alias("number"), "t", "order", "value")
