import pytest
from pyspark.sql import functions as F

from cinesieve.functions import columns, grids
from cinesieve.operators import blur, detector, ranking, sampling, stats

LINE = "key string, t long, order long, value double"


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_fixed_rate_takes_the_first_of_each_period(spark):
    line = spark.createDataFrame([("a", t, i, float(i)) for i, t in enumerate((0, 10, 999_999, 1_000_000, 3_500_000, 3_500_000))] + [("b", 5, 0, 1.0)], LINE)
    assert rows(sampling.by_rate(line, 1_000_000), "key", "bucket", "order") == [("a", 0, 0), ("a", 1, 3), ("a", 3, 4), ("b", 0, 0)]
    assert rows(sampling.sample(line, "anything", fps=1.0), "key", "number", "order") == [("a", 0, 0), ("a", 1, 3), ("a", 3, 4), ("b", 0, 0)]


def test_scenes_and_the_fallback(spark):
    values = [1.0] * 6 + [90.0] * 6
    line = spark.createDataFrame([("cut", 1000 * i, i, v) for i, v in enumerate(values)] + [("still", 1000 * i, i, 5.0) for i in range(4)], LINE)
    assert rows(sampling.cuts(line).where("cut"), "key", "order") == [("cut", 6)]
    assert rows(sampling.scenes(line), "key", "scene", "start_us", "end_us") == [("cut", 0, 0, 6000), ("cut", 1, 6000, 11000)]
    assert rows(sampling.scene_frames(line), "scene", "order") == [(0, 3), (1, 8)]
    both = sampling.sample(line, "scene")
    assert rows(both, "key", "mode", "number", "order") == [("cut", "scene", 0, 3), ("cut", "scene", 1, 8), ("still", "fps", 0, 0)]
    assert sampling.scenes(line.limit(0)).count() == 0


def test_cuts_keep_a_least_length(spark):
    """Frames that stand out every 10 of them; of these, the first at least 15 after the last cut is the next."""
    line = [("a", i, 0, 0.0 if i % 10 or not i else 90.0) for i in range(100)] + [(None, i, 0, 0.0 if i != 20 else 46.0) for i in range(30)] + [("c", 0, 0, 0.0)]
    line += [("d", i, 0, {12: 300.0, 13: 60.0}.get(i, 10.0)) for i in range(30)]
    frames = spark.createDataFrame(line, "key string, t long, order long, change double").repartition(5)
    assert rows(detector.cuts(frames, 27.0, 1).where("cut AND key = 'a'"), "number") == [(i,) for i in range(10, 100, 10)]
    assert rows(detector.cuts(frames).where("cut AND key = 'a'"), "number") == [(20,), (40,), (60,), (80,)]
    assert rows(detector.cuts(frames).where("cut AND key IS NULL"), "number") == [(20,)]
    assert rows(detector.cuts(frames, 27.0, 12).where("cut AND key = 'd'"), "number") == [(12,)] and detector.cuts(frames, 27.0).where("cut AND key = 'd'").isEmpty()
    assert detector.cuts(frames).count() == len(line) and detector.cuts(frames.limit(0)).count() == 0
    colours = spark.createDataFrame([("v", i, 0, *c) for i, c in enumerate([(10, 0, 0), (170, 0, 5), (170, 255, 5)])], "key string, t long, order long, hue long, saturation long, brightness long")
    assert rows(detector.changes(colours), "t", "change") == [(0, 0.0), (1, 165.0), (2, 255.0)]


def test_a_threshold_is_inclusive_and_unreadable_frames_score_zero(spark):
    frames = spark.createDataFrame([(1, 80.0), (2, 79.999), (3, None)], "frame_order long, blur_score double")
    assert rows(blur.judged(frames, 80), "frame_order", "is_sharp", "blur_score") == [(1, True, 80.0), (2, False, 79.999), (3, False, 0.0)]
    assert rows(blur.judged(frames, 0).where("is_sharp"), "frame_order") == [(1,), (2,), (3,)]


def test_ties_keep_their_order(spark):
    scored = spark.createDataFrame([("v", 3, 0.5), ("v", 1, 0.5), ("v", 2, 0.9), ("w", 1, 0.1)], "video string, frame_order long, total double")
    assert rows(ranking.ranked(scored), "video", "rank", "frame_order") == [("v", 1, 2), ("v", 2, 1), ("v", 3, 3), ("w", 1, 1)]
    assert rows(ranking.top(scored, 1), "video", "frame_order") == [("v", 2), ("w", 1)]
    assert rows(ranking.numbered(scored), "video", "unique_no", "frame_order") == [("v", 0, 1), ("v", 1, 2), ("v", 2, 3), ("w", 0, 1)]


def test_the_two_reductions_differ(spark):
    df = spark.createDataFrame([(80, 29), (0, 0)], "raw long, final long")
    got = df.select(columns.reduction_of_video(F.col("raw"), F.col("final")).alias("v"), columns.reduction_of_batch(F.col("raw"), F.col("final")).alias("b")).collect()
    assert [(round(r.v, 6), r.b) for r in got] == [(63.75, 63.8), (100.0, 0.0)]


def test_batch_statistics(spark):
    schema = "video string, status string, total_raw_frames long, removed_blurry long, removed_duplicate long, final_unique_frames long"
    videos = spark.createDataFrame([("b.mp4", "success", 10, 2, 3, 5), ("a.mp4", "error", 9, 9, 9, 9), ("c.mp4", "skipped", 0, 0, 0, 0)], schema)
    r = stats.batch(videos).first()
    assert (r.total_videos, r.success, r.skipped, r.error, r.failed, r.total_raw_frames, r.overall_reduction) == (3, 1, 1, 1, 2, 10, 50.0)
    assert tuple(stats.failures(videos).first()) == (2, "a.mp4, c.mp4")
    assert stats.batch(videos.limit(0)).first().overall_reduction == 0.0


@pytest.mark.parametrize(("path", "name", "stem", "suffix"), [("/x/a.b.MP4", "a.b.MP4", "a.b", ".MP4"), ("clip", "clip", "clip", ""), ("d/.hidden", ".hidden", ".hidden", "")])
def test_path_parts(spark, path, name, stem, suffix):
    c = F.lit(path)
    assert tuple(spark.range(1).select(columns.basename(c), columns.stem(c), columns.suffix(c)).first()) == (name, stem, suffix)


def test_text_helpers(spark):
    import html

    for text in ("a & b < c > \"d\" 'e' &amp;", ""):
        assert spark.range(1).select(columns.html_escape(F.lit(text))).first()[0] == html.escape(text)
    lines = [" 50%|####", "", "  ", "50% done", "12%|x"]
    assert [spark.range(1).select(columns.is_progress_line(F.lit(x))).first()[0] for x in lines] == [True, False, False, False, True]


def test_rounding_is_that_of_the_exact_double(spark):
    pairs = [(r, f) for r in range(1, 400) for f in range(0, r + 1)]
    got = spark.createDataFrame(pairs, "raw long, final long").select(
        "raw", "final", columns.percent(columns.reduction_of_video(F.col("raw"), F.col("final"))).alias("v"), columns.reduction_of_batch(F.col("raw"), F.col("final")).alias("b")
    ).collect()
    assert len(got) == len(pairs)
    for r in got:
        assert r.v == f"{(1 - r.final / max(r.raw, 1)) * 100:.1f}%" and r.b == round(100.0 * (r.raw - r.final) / r.raw, 1)
    values = [i / 1000 for i in range(1001)] + [1 - d / 256 for d in range(257)] + [1 - d / 64 for d in range(65)] + [0.1235, 0.0005, -0.0625, 2.5e-7, 5e-324, 1023.9375, 0.0]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", *[columns.exactly_rounded(F.col("v"), d).alias(f"d{d}") for d in range(7)], columns.fixed(F.col("v"), 2).alias("s")).collect()
    for r in got:
        assert all(r[f"d{d}"] == round(r.v, d) for d in range(7)) and r.s == f"{r.v:.2f}", r.v
    assert spark.range(1).select(columns.exactly_rounded(F.lit(None).cast("double"), 1), columns.exactly_rounded(F.lit(float("nan")), 1), columns.exactly_rounded(F.lit(2000.0), 1)).first() == (None, None, None)
