import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cinesieve.functions import images
from cinesieve.operators import dedup, rounds


def naive(items, threshold, similarity):
    """(kept or the first kept hit's similarity) of each item, one by one."""
    kept, out = [], []
    for item in items:
        hits = [s for k in kept if (s := similarity(k, item)) >= threshold]
        out.append(hits[0] if hits else None)
        if not hits:
            kept.append(item)
    return out


def bits_alike(a, b):
    return 1 - sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True)) / (8 * len(a))


@settings(deadline=None, max_examples=60)
@given(st.lists(st.binary(min_size=2, max_size=2), max_size=40), st.sampled_from([0.3, 0.5, 0.7, 1.0]))
def test_state_is_the_naive_fold(items, threshold):
    held = dedup.HashState(threshold, 16)
    assert [held.offer(i) for i in items] == naive(items, threshold, bits_alike)


def test_greedy_is_the_naive_fold_however_rows_are_dealt(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, (6, 4), np.uint8)
    rows = [(f"v{v}", o, bytes(base[rng.integers(6)] ^ (1 << rng.integers(0, 8, 4)).astype(np.uint8) * rng.integers(0, 2, 4).astype(np.uint8))) for v in range(3) for o in range(50)]
    rows += [("v0", 50, None), ("v1", 50, None)]
    schema = "video string, frame_order long, item binary"
    expected = {}
    for v in ("v0", "v1", "v2"):
        own = sorted(((o, i) for w, o, i in rows if w == v and i is not None))
        for (o, _), found in zip(own, naive([i for _, i in own], 0.8, bits_alike), strict=True):
            expected[v, o] = ("unique", None) if found is None else ("duplicate", found)
    expected |= {("v0", 50): ("hash_error", None), ("v1", 50): ("hash_error", None)}
    for parts in (1, 7):
        df = spark.createDataFrame(rows[::-1], schema).repartition(parts)
        got = {(r.video, r.frame_order): (r.disposition, r.similarity) for r in dedup.greedy(df, 0.8, "phash", 32).collect()}
        assert got == expected
    assert dedup.greedy(spark.createDataFrame([], schema), 0.8, "phash", 32).collect() == []


def test_removed_frames_do_not_suppress(spark):
    a, b, c = bytes([0b0000]), bytes([0b0011]), bytes([0b1111])
    rows = spark.createDataFrame([("v", i, x) for i, x in enumerate((a, b, c))], "video string, frame_order long, item binary")
    got = {r.frame_order: r.disposition for r in dedup.greedy(rows, 0.7, "phash", 8).collect()}
    assert got == {0: "unique", 1: "duplicate", 2: "unique"}


def slow_ssim(a, b, w=7):
    h, wd = a.shape
    out = []
    for y in range(h - w + 1):
        for x in range(wd - w + 1):
            p, q = a[y : y + w, x : x + w].astype(float).ravel(), b[y : y + w, x : x + w].astype(float).ravel()
            v = np.cov(p, q)
            out.append((2 * p.mean() * q.mean() + images.C1) * (2 * v[0, 1] + images.C2) / ((p.mean() ** 2 + q.mean() ** 2 + images.C1) * (v[0, 0] + v[1, 1] + images.C2)))
    return np.mean(out)


def test_structural_similarity():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 256, (2, 12, 15), np.uint8)
    assert abs(images.ssim(a[None], b)[0] - slow_ssim(a, b)) < 1e-9
    assert images.ssim(a[None], a)[0] == 1.0


def rows_of(df):
    return sorted(map(tuple, df.select("video", "frame_order", "disposition", "similarity").collect()), key=str)


@pytest.mark.parametrize(("block", "share"), [(9, 7), (25, 1000)])
def test_rounds_are_the_sequential_rule(spark, block, share):
    """Random graphs, a chain in which each frame is similar to the next alone, copies, ties and nulls."""
    rng = np.random.default_rng(4)
    items = [("random", i, rng.integers(0, 256, 2, np.uint8).tobytes()) for i in range(60)]
    chain = 0
    for i in range(30):
        chain ^= 0b11 << (i % 16 * 2) % 16
        items.append(("chain", i, chain.to_bytes(2, "big")))
    items += [("copies", i // 2, b"ab") for i in range(20)] + [("nulls", i, None) for i in range(3)] + [(None, i, bytes([i, 0])) for i in range(9)] + [("one", 0, b"xy")]
    df = spark.createDataFrame(items, "video string, frame_order long, item binary").repartition(3)
    for threshold in (0.6, 0.8, 1.5):
        assert rows_of(rounds.greedy(df, threshold, "phash", 16, block, share)) == rows_of(dedup.greedy(df, threshold, "phash", 16)), threshold
    assert rows_of(rounds.greedy(df.limit(0), 0.8, "phash", 16)) == []


def test_only_long_videos_take_rounds(spark, monkeypatch):
    df = spark.createDataFrame([(v, i, bytes([i * 7 % 256, i % 5])) for v, n in (("a", 40), ("b", 5), (None, 30)) for i in range(n)], "video string, frame_order long, item binary")
    seen = []
    monkeypatch.setattr(rounds, "greedy", lambda items, *a, of=rounds.greedy: seen.append(items.select("video").distinct().count()) or of(items, *a, 8, 8))
    assert rows_of(rounds.deduplicated(df, 0.8, "phash", 16, longest=10)) == rows_of(dedup.greedy(df, 0.8, "phash", 16)) and seen == [2]
    assert rows_of(rounds.deduplicated(df, 0.8, "phash", 16)) == rows_of(dedup.greedy(df, 0.8, "phash", 16)) and seen == [2]


def test_a_video_of_a_million_frames_is_compared_in_many_tasks(spark, monkeypatch):
    """Every frame after the first 300 is a copy of one of them; a share's task sees a part of the video."""
    df = spark.range(1_000_000, numPartitions=8).select(F.lit("v").alias("video"), F.col("id").alias("frame_order"), F.unhex(F.sha2((F.col("id") % 300).cast("string"), 256)).alias("item"))
    found = rounds.greedy(df, 0.9, "phash", 256, 256, 1 << 16)
    assert found.groupBy("disposition").count().orderBy("disposition").collect() == [("duplicate", 999_700), ("unique", 300)]
    assert found.where("disposition = 'unique'").agg(F.max("frame_order")).first()[0] == 299 and found.agg(F.min("similarity")).first()[0] == 1.0


def scenes(n, side, seed):
    """Smooth images of a few scenes, each shown some times with a little noise."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:side, 0:side] / side
    base = []
    for _ in range(n):
        a, b, c, d = rng.uniform(-4, 4, 4)
        base.append(128 + 60 * np.sin(6 * (a * x + b * y)) * np.cos(5 * (c * x * y + d * x)) + rng.uniform(-60, 60))
    return [np.clip(base[i % n] + rng.normal(0, 2, (side, side)), 0, 255).astype(np.uint8) for i in rng.permutation(4 * n)]


@pytest.mark.parametrize("side", [8, 24, 64])
def test_bounds_never_lie_under_the_similarity(side):
    rng = np.random.default_rng(side)
    shown = scenes(6, side, side) + list(rng.integers(0, 256, (6, side, side), np.uint8)) + [np.full((side, side), v, np.uint8) for v in (0, 3, 255)]
    windows = [images.Windows(i) for i in shown]
    cells = np.stack([w.cells for w in windows])
    for i, w in enumerate(windows):
        coarse = w.coarse_bound(cells)
        for k, other in enumerate(windows):
            exact = images.ssim(shown[k][None], shown[i])[0]
            assert abs(w.similarity(other) - exact) < 1e-12
            assert exact <= coarse[k] + 1e-9
            for least in (0.3, 0.7, exact - 1e-9, exact + 1e-9):
                found = w.similarity(other, least)
                assert found == w.similarity(other) if found is not None else exact < least


def test_few_pairs_are_compared_in_full_and_nothing_changes(spark):
    shown = scenes(30, 64, 9)
    held, full = dedup.StructureState(0.7, 64), naive([i.tobytes() for i in shown], 0.7, lambda a, b: float(images.ssim(np.frombuffer(a, np.uint8).reshape(1, 64, 64), np.frombuffer(b, np.uint8).reshape(64, 64))[0]))
    got = [held.offer(i.tobytes()) for i in shown]
    assert [g is None for g in got] == [f is None for f in full] and all(g is None or abs(g - f) < 1e-12 for g, f in zip(got, full, strict=True))
    assert 0 < held.compared < held.offered / 5
    df = spark.createDataFrame([(v, i, image.tobytes()) for v in "ab" for i, image in enumerate(shown)] + [("c", 0, None)], "video string, frame_order long, item binary")
    assert sorted(map(tuple, dedup.structure_pairs(df, 0.7, 64).collect())) == [(v, 120, held.offered, held.compared) for v in "ab"]
    assert rows_of(rounds.greedy(df, 0.7, "ssim", 64, 32, 50)) == rows_of(dedup.greedy(df, 0.7, "ssim", 64))


def test_small_images_are_counted_many_at_a_time(monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 256, (40, 8, 8))
    shown = [np.clip(base[i % 40] + rng.integers(-i // 40 * 3 - 1, i // 40 * 3 + 2, (8, 8)), 0, 255).astype(np.uint8).tobytes() for i in range(400)]
    for threshold in (0.5, 0.9, 0.998):
        many, calls = dedup.StructureState(threshold, 8, counting=True), []
        one_by_one = images.Windows.similarity
        monkeypatch.setattr(images.Windows, "similarity", lambda *a: calls.append(a) or one_by_one(*a))
        got = [many.offer(i) for i in shown]
        assert not calls  # thousands of pairs, none of them alone
        monkeypatch.setattr(dedup, "SMALL", 0)
        single = dedup.StructureState(threshold, 8, counting=True)
        assert [g is None for g in got] == [f is None for f in map(single.offer, shown)]
        assert (many.offered, many.compared) == (single.offered, single.compared) and many.compared
        monkeypatch.undo()
