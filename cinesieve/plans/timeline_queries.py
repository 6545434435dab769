"""Queries over timelines: sampling at a rate and by scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinesieve.operators import detector, sampling
from cinesieve.sources.bindings import timeline

PERIOD = 6 * 3600 * 1_000_000
#: The threshold of adaptive cuts, as events change more from one to the next than frames do.
CALM = 13.0


def q26_fixed_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.by_rate(timeline(spark, sf_dir), PERIOD).select("key", "bucket", "t", "value")


def q27_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.cuts(timeline(spark, sf_dir)).where("cut").select("key", "t", F.col("order").alias("event"), grids_rounded("change").alias("change"))


def grids_rounded(column: str):
    return F.floor(F.col(column) * 10000.0 + 0.5) / 10000.0


def q28_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.scenes(timeline(spark, sf_dir))


def q29_scene_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.scene_frames(timeline(spark, sf_dir)).select("key", "scene", F.col("order").alias("event"), "t")


def q30_scene_or_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.by_scene_or_rate(timeline(spark, sf_dir), period_us=PERIOD).select("key", "mode", "number", F.col("order").alias("event"), "t")


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of one pixel each, whose hue, saturation and brightness are digits of their values."""
    hundredths = F.floor(F.abs(F.col("value")) * 100).cast("long")
    line = timeline(spark, sf_dir)
    return detector.changes(line.select("*", (hundredths % 180).alias("hue"), F.expr("CAST(floor(abs(value) * 7) AS BIGINT) % 256").alias("saturation"), F.expr("CAST(floor(abs(value)) AS BIGINT) % 256").alias("brightness")))


def q43_adaptive_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts by three channels, with scenes of 15 frames at least."""
    return detector.cuts(channels(spark, sf_dir), CALM).where("cut").select("key", "number", F.col("order").alias("event"), "t", "change")


def q44_adaptive_scene_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.scene_frames(channels(spark, sf_dir), CALM, detector.cuts)
    return rows.select("key", "scene", "start_us", "end_us", F.col("order").alias("event"), "t")


QUERIES = {f.__name__: f for f in (q26_fixed_rate, q27_cuts, q28_scenes, q29_scene_frames, q30_scene_or_rate, q43_adaptive_cuts, q44_adaptive_scene_frames)}

_T = "line AS (SELECT user_id AS key, epoch_us(ts) AS t, event_id, value FROM events)"
_CUTS = f"""{_T}, changes AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY key ORDER BY t, event_id)) AS change FROM line),
around AS (SELECT *, sum(change) OVER w AS s, count(change) OVER w AS n FROM changes WINDOW w AS (PARTITION BY key ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
cuts AS (SELECT *, coalesce(n = 5 AND change >= 15 AND (CASE WHEN (s - change) / 4 = 0 THEN 255.0 ELSE change / ((s - change) / 4) END) >= 2.7, false) AS cut FROM around)"""
def _scenes(cuts: str) -> str:
    return f"""{cuts}, numbered AS (SELECT *, CAST(sum(CAST(cut AS BIGINT)) OVER (PARTITION BY key ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS scene FROM cuts),
ends AS (SELECT key, scene, min(t) AS start_us, max(t) AS last_us FROM numbered GROUP BY key, scene),
scenes AS (SELECT key, scene, start_us, end_us FROM (SELECT *, coalesce(lead(start_us) OVER (PARTITION BY key ORDER BY scene), last_us) AS end_us, count(*) OVER (PARTITION BY key) AS k FROM ends) WHERE k > 1),
middle AS (SELECT n.key, n.scene, n.event_id AS event, n.t, row_number() OVER (PARTITION BY n.key, n.scene ORDER BY abs(n.t - (s.start_us + s.end_us) // 2), n.t, n.event_id) AS r FROM numbered n JOIN scenes s ON n.key = s.key AND n.scene = s.scene)"""


_SCENES = _scenes(_CUTS)
#: The last cut is carried from frame to frame by the recursion.
_ADAPTIVE = f"""{_T}, channels AS (SELECT *, CAST(floor(abs(value) * 100) AS BIGINT) % 180 AS h, CAST(floor(abs(value) * 7) AS BIGINT) % 256 AS s, CAST(floor(abs(value)) AS BIGINT) % 256 AS b FROM line),
deltas AS (SELECT *, coalesce(abs(h - lag(h) OVER o) + abs(s - lag(s) OVER o) + abs(b - lag(b) OVER o), 0) AS change, row_number() OVER o - 1 AS number FROM channels WINDOW o AS (PARTITION BY key ORDER BY t, event_id)),
near AS (SELECT *, sum(change) OVER w AS near_sum, count(*) OVER w AS near_n FROM deltas WINDOW w AS (PARTITION BY key ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
marked AS (SELECT *, near_n = 5 AND change >= 45 AND (near_sum = change OR least(change / ((near_sum - change) / 4.0), 255.0) >= {CALM} / 10) AS marked FROM near),
carried AS (SELECT key, number, CAST(0 AS BIGINT) AS last, false AS cut FROM marked WHERE number = 0
  UNION ALL SELECT m.key, m.number, CASE WHEN m.marked AND m.number - c.last >= 15 THEN m.number ELSE c.last END, m.marked AND m.number - c.last >= 15 FROM carried c JOIN marked m ON m.key = c.key AND m.number = c.number + 1),
cuts AS (SELECT m.*, c.cut FROM marked m JOIN carried c ON c.key = m.key AND c.number = m.number)"""
_RATE = f"SELECT key, t // {PERIOD} AS bucket, t, event_id, value, row_number() OVER (PARTITION BY key, t // {PERIOD} ORDER BY t, event_id) AS r FROM line"

ORACLE_SQL = {
    "q43_adaptive_cuts": f"WITH RECURSIVE {_ADAPTIVE} SELECT key, number, event_id AS event, t, CAST(change AS DOUBLE) AS change FROM cuts WHERE cut",
    "q44_adaptive_scene_frames": f"WITH RECURSIVE {_scenes(_ADAPTIVE)} SELECT m.key, m.scene, s.start_us, s.end_us, m.event, m.t FROM middle m JOIN scenes s ON s.key = m.key AND s.scene = m.scene WHERE r = 1",
    "q26_fixed_rate": f"WITH {_T} SELECT key, bucket, t, value FROM ({_RATE}) WHERE r = 1",
    "q27_cuts": f"WITH {_CUTS} SELECT key, t, event_id AS event, floor(change * 10000.0 + 0.5) / 10000.0 AS change FROM cuts WHERE cut",
    "q28_scenes": f"WITH {_SCENES} SELECT key, scene, start_us, end_us FROM scenes",
    "q29_scene_frames": f"WITH {_SCENES} SELECT key, scene, event, t FROM middle WHERE r = 1",
    "q30_scene_or_rate": f"""WITH {_SCENES} SELECT key, 'scene' AS mode, scene AS number, event, t FROM middle WHERE r = 1
UNION ALL SELECT key, 'fps', bucket, event_id, t FROM ({_RATE}) WHERE r = 1 AND key NOT IN (SELECT key FROM scenes)""",
}
