"""Greedy deduplication of a stream of frames, with the kept hashes of each video as state.

Inside a trigger a video's frames are taken in their order; across triggers they count in the order of arrival. The result
equals the batch operator's where every trigger's frames follow all earlier ones of their video.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cinesieve.operators.dedup import HashState

OUTPUT = "video long, frame_order long, disposition string, similarity double"
STATE = "kept binary"


def _step(threshold: float, bits: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = HashState(threshold, bits)
        if state.exists:
            held.kept = np.frombuffer(state.get[0], np.uint8).reshape(-1, bits // 8).copy()
            held.count = len(held.kept)
        arrived = pd.concat(list(frames)).sort_values("frame_order", kind="stable")
        found = [held.offer(bytes(item)) for item in arrived["item"]]
        state.update((held.kept[: held.count].tobytes(),))
        yield pd.DataFrame({"video": key[0], "frame_order": arrived["frame_order"].to_numpy(), "disposition": ["unique" if f is None else "duplicate" for f in found], "similarity": found})

    return run


def greedy(stream: DataFrame, threshold: float, bits: int = 256) -> DataFrame:
    """stream (video long, frame_order long, item binary) -> video, frame_order, disposition, similarity, in append mode."""
    return stream.groupBy("video").applyInPandasWithState(_step(threshold, bits), OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
