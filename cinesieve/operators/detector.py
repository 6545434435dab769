"""Cuts where hue, saturation and brightness change more than around, with a least length of a scene.

A frame's `change` is the sum of its channels' mean changes to the frame before, 0 for the first one. Windows tell which frames
stand out; whether one of them is a cut depends on where the last cut was, and so on that one's last cut: a state that is
carried through a video's frames in their order, one number, by the tasks that the windows have sorted them in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The least mean change of a channel that counts as a cut, the frames on either side that it is compared with,
#: a mean that counts as nothing, the largest ratio, and the least frames of a scene.
LEAST_CHANGE, REACH, NOTHING, LARGEST, LEAST_SCENE = 15.0, 2, 0.00001, 255.0, 15
CHANNELS = ("hue", "saturation", "brightness")


def changes(timeline: DataFrame) -> DataFrame:
    """timeline (key, t, order, hue, saturation, brightness) with change."""
    w = W.partitionBy("key").orderBy("t", "order")
    return timeline.withColumn("change", F.coalesce(sum((F.abs(F.col(c) - F.lag(c).over(w)) for c in CHANNELS[1:]), F.abs(F.col(CHANNELS[0]) - F.lag(CHANNELS[0]).over(w))).cast("double"), F.lit(0.0)))


def _carried(least_scene: int):
    """Batches of frames by key and in order, with key first and number and stands_out last; a cut replaces the last one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, 0
        for batch in batches:
            keys, numbers = batch.column(0), batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False)
            cut = np.zeros(len(numbers), bool)
            marked = np.flatnonzero(batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))
            for i in marked:
                if key is None or keys[i] != key:
                    key, last = keys[i], 0  # a scene begins with the first frame
                if numbers[i] - last >= least_scene:
                    cut[i], last = True, numbers[i]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(cut)], names=[*batch.schema.names[:-1], "cut"])

    return run


def cuts(timeline: DataFrame, threshold: float = 27.0, least_scene: int = LEAST_SCENE) -> DataFrame:
    """timeline (key, t, order, change, ...) with number (from 0), ratio (to the neighbours' mean change) and cut.

    A frame stands out if its change is at least LEAST_CHANGE a channel and `threshold` / 10 times the mean of the two frames on
    either side; frames without two on each side don't. It is a cut if it is at least `least_scene` frames after the last cut,
    or after the first frame. One shuffle, by key; null keys are a video. An empty table gives no rows.
    """
    w = W.partitionBy("key").orderBy("t", "order")
    near = w.rowsBetween(-REACH, REACH)
    names = ["key", *[c for c in timeline.columns if c != "key"]]
    around = timeline.repartition("key").select(*names, (F.row_number().over(w) - 1).cast("long").alias("number"), F.sum("change").over(near).alias("near_sum"), F.count("change").over(near).alias("near_n"))
    mean = (F.col("near_sum") - F.col("change")) / (2 * REACH)
    least = LEAST_CHANGE * len(CHANNELS)
    alone = F.when(F.col("change") >= least, LARGEST).otherwise(0.0)
    ratio = F.when(F.col("near_n") == 2 * REACH + 1, F.when(mean < NOTHING * len(CHANNELS), alone).otherwise(F.least(F.col("change") / F.greatest(mean, F.lit(NOTHING)), F.lit(LARGEST))))
    marked = around.withColumn("ratio", ratio).select(*names, "ratio", "number", F.coalesce((F.col("change") >= least) & (F.col("ratio") >= threshold / 10), F.lit(False)).alias("stands_out"))
    schema = T.StructType([*marked.schema.fields[:-1], T.StructField("cut", T.BooleanType())])
    return marked.sortWithinPartitions("key", "t", "order").mapInArrow(_carried(least_scene), schema)
