"""Streams of frames out of order against the batch operator."""

import numpy as np
from pyspark.sql import functions as F

from cinesieve.operators import dedup
from cinesieve.streaming import ordered

SCHEMA = "video long, frame_order long, item binary, t timestamp"


def arrived(spark, rows, folder):
    """One file of its own for these rows (video, frame_order, item, milliseconds)."""
    df = spark.createDataFrame(rows, "video long, frame_order long, item binary, ms long")
    df.select("video", "frame_order", "item", F.timestamp_millis("ms").alias("t")).coalesce(1).write.mode("append").parquet(folder)


def test_results_do_not_depend_on_arrival(spark, tmp_path):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 256, (5, 4), np.uint8)
    frames = [(v, o, bytes(base[rng.integers(5)] ^ rng.integers(0, 4, 4).astype(np.uint8)), 1000 + 10 * o) for v in (1, 2, 3) for o in range(40)]
    frames += [(1, 40, None, 1400), (2, 7, frames[47][2], 1070)]
    wanted = sorted(map(tuple, dedup.greedy(spark.createDataFrame([f[:3] for f in frames], "video long, frame_order long, item binary"), 0.8, "phash", 32).collect()), key=str)
    place = np.argsort([f[3] + rng.integers(0, 100) for f in frames])  # at most 100 ms late
    early = []
    for i, part in enumerate(np.array_split(place, 3)):
        rows = [frames[k] for k in part]
        arrived(spark, rows[::-1] + ([(None, None, None, 99_000)] if i == 2 else []), str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        with ordered.rocksdb(spark):
            query = ordered.greedy(stream, 0.8, 32, "200 milliseconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination()
        early.append(spark.read.schema(ordered.OUTPUT).parquet(str(tmp_path / "out")).where("disposition <> 'hash_error'").count())
    assert sorted(map(tuple, spark.read.schema(ordered.OUTPUT).parquet(str(tmp_path / "out")).collect()), key=str) == wanted
    assert early[0] < early[1] < early[2] == len(frames) - 1  # frames come out as the watermark passes them, not all at the end
