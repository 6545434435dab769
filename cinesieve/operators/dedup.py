"""Greedy first-match deduplication: a frame is a duplicate if it is similar to a frame kept before it in its video.

The rule depends on the order and isn't transitive: removed frames never suppress others. Frames are dealt by video and
sorted by their order inside tasks; a task streams through them and holds the kept frames' hashes alone, never a whole
video, so that memory grows with what is kept (32 bytes a frame by perceptual hash). Comparisons are numpy blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinesieve.functions import images

BLOCK = 4096
#: How far rounding may put a similarity over its bound.
MARGIN = 1e-6
#: Images of at most this side are compared MANY at a time.
SMALL, MANY = 32, 128
#: So many at a time where bounds come first.
MANY_BOUNDED = 1024


class HashState:
    """Kept hashes of one video."""

    def __init__(self, threshold: float, bits: int):
        self.threshold, self.bits, self.count, self.kept = threshold, bits, 0, np.zeros((64, bits // 8), np.uint8)

    def similarities(self, item: np.ndarray, a: int, b: int) -> np.ndarray:
        return 1 - np.bitwise_count(self.kept[a:b] ^ item).sum(axis=1, dtype=np.int64) / self.bits

    def find(self, raw: bytes) -> float | None:
        """The similarity to the first kept one at or over the threshold."""
        item = np.frombuffer(raw, np.uint8).reshape(self.kept.shape[1:])
        for a in range(0, self.count, BLOCK):
            found = self.similarities(item, a, min(a + BLOCK, self.count))
            hits = found >= self.threshold
            if hits.any():
                return max(0.0, float(found[hits.argmax()]))
        return None

    def add(self, raw: bytes) -> None:
        if self.count == len(self.kept):
            self.kept = np.concatenate([self.kept, np.zeros_like(self.kept)])
        self.kept[self.count] = np.frombuffer(raw, np.uint8).reshape(self.kept.shape[1:])
        self.count += 1

    def offer(self, raw: bytes) -> float | None:
        """find, and add where nothing is found."""
        found = self.find(raw)
        if found is None:
            self.add(raw)
        return found


class StructureState(HashState):
    """The same over images of side x side, by structural similarity.

    A kept image's window sums are worked out once. Most pairs never meet in full: the similarity of two images has an upper
    bound from their windows' means and variances, over a coarse grid for all kept ones at once, then window by window, and
    while windows are compared, from these and the others' bounds. A pair whose bound is under the threshold can't match.
    `offered` counts the pairs up to each image's first match, `compared` those of which every window was compared. Some 450 KB
    a kept image of 256 x 256.
    """

    def __init__(self, threshold: float, side: int, counting: bool = False):
        self.threshold, self.side, self.images, self.counting = threshold, side, [], counting
        self.cells, self.offered, self.compared = np.zeros((0, 0, 0)), 0, 0
        #: Of small kept images that are counted: pixels, means and variances of their windows.
        self.stacked = (np.zeros((0, 0, 0)),) * 3

    @property
    def count(self) -> int:
        return len(self.images)

    def _windows(self, raw: bytes) -> images.Windows:
        return images.Windows(np.frombuffer(raw, np.uint8).reshape(self.side, self.side))

    def _find_small(self, item: images.Windows) -> float | None:
        """The same for images so small that many at a time are compared sooner than one is bounded; counts nothing."""
        for a in range(0, self.count, BLOCK):
            left = np.flatnonzero(item.coarse_bound(self.cells[a : min(a + BLOCK, self.count)]) >= self.threshold - MARGIN) + a
            for i in range(0, len(left), MANY):
                found = images.ssim(np.stack([self.images[k].image for k in left[i : i + MANY]]), item.image)
                hits = found >= self.threshold
                if hits.any():
                    return max(0.0, float(found[hits.argmax()]))
        return None

    def _count_small(self, item: images.Windows) -> float | None:
        """The same with counts: bounds and parts of the windows are worked out for many kept images at a time."""
        least = self.threshold - MARGIN
        for a in range(0, self.count, BLOCK):
            left = np.flatnonzero(item.coarse_bound(self.cells[a : min(a + BLOCK, self.count)]) >= least) + a
            for i in range(0, len(left), MANY_BOUNDED):
                places = left[i : i + MANY_BOUNDED]
                whole, found = item.similarities(*(x[places] for x in self.stacked), least)
                hits = found >= self.threshold
                if hits.any():
                    first = int(hits.argmax())
                    self.compared += int(np.searchsorted(whole, whole[first], "right"))
                    self.offered += int(places[whole[first]]) + 1
                    return max(0.0, float(found[first]))
                self.compared += len(whole)
        self.offered += self.count
        return None

    def _find(self, item: images.Windows) -> float | None:
        if self.side <= SMALL and self.counting:
            return self._count_small(item)
        if self.side <= SMALL and not self.counting:
            return self._find_small(item)
        least = self.threshold - MARGIN
        for a in range(0, self.count, BLOCK):
            bounds = item.coarse_bound(self.cells[a : min(a + BLOCK, self.count)])
            for k in np.flatnonzero(bounds >= least) + a:
                found = item.similarity(self.images[k], least)
                self.compared += found is not None
                if found is not None and found >= self.threshold:
                    self.offered += int(k) + 1
                    return max(0.0, found)
        self.offered += self.count
        return None

    def _add(self, item: images.Windows) -> None:
        if self.count == len(self.cells):
            self.cells = np.concatenate([self.cells, np.zeros((max(16, self.count), *item.cells.shape))]) if self.count else np.zeros((16, *item.cells.shape))
        self.cells[self.count] = item.cells
        if self.side <= SMALL and self.counting:
            own = (item.image, *item.moments())
            if self.count == len(self.stacked[0]):
                self.stacked = tuple(np.concatenate([x, np.zeros((max(16, len(x)), *y.shape), y.dtype)]) if len(x) else np.zeros((16, *y.shape), y.dtype) for x, y in zip(self.stacked, own, strict=True))
            for x, y in zip(self.stacked, own, strict=True):
                x[self.count] = y
        self.images.append(item)

    def find(self, raw: bytes) -> float | None:
        return self._find(self._windows(raw))

    def add(self, raw: bytes) -> None:
        self._add(self._windows(raw))

    def offer(self, raw: bytes) -> float | None:
        item = self._windows(raw)
        found = self._find(item)
        if found is None:
            self._add(item)
        return found


def state(method: str, threshold: float, size: int) -> HashState:
    """size: bits of a hash for "phash", the image's side for "ssim"; any other method counts as "phash"."""
    return StructureState(threshold, size) if method == "ssim" else HashState(threshold, size)


def _scan(method: str, threshold: float, size: int):
    unread = "unreadable" if method == "ssim" else "hash_error"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, kept = None, None
        for batch in batches:
            dispositions, similarities = [], []
            for key, item in zip(batch.column(0), batch.column(2), strict=True):
                if kept is None or key != video:
                    video, kept = key, state(method, threshold, size)
                if not item.is_valid:
                    dispositions.append(unread)
                    similarities.append(None)
                else:
                    found = kept.offer(item.as_py())
                    dispositions.append("unique" if found is None else "duplicate")
                    similarities.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dispositions), pa.array(similarities, pa.float64())], names=["video", "frame_order", "disposition", "similarity"])

    return run


def greedy(items: DataFrame, threshold: float, method: str = "phash", size: int = 256) -> DataFrame:
    """items (video, frame_order, item binary) -> video, frame_order, disposition, similarity.

    disposition: unique, duplicate (similarity: to the first kept frame that matched), or hash_error / unreadable for null
    items. Ties in frame_order are broken by the item. An empty table gives no rows.
    """
    rows = items.select("video", "frame_order", "item")
    kinds = {f.name: f.dataType for f in rows.schema}
    out = T.StructType([T.StructField("video", kinds["video"]), T.StructField("frame_order", kinds["frame_order"]), T.StructField("disposition", T.StringType()), T.StructField("similarity", T.DoubleType())])
    dealt = rows.repartition("video").sortWithinPartitions("video", "frame_order", "item")
    return dealt.mapInArrow(_scan(method, threshold, size), out)


def structure_pairs(items: DataFrame, threshold: float, side: int = 256) -> DataFrame:
    """What greedy deduplication by structure compares: video, frames, offered (pairs up to each frame's first match), compared
    (those that no bound could rule out). Null items are no frames. An empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, held, n = None, None, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([video.as_py()], video.type), *[pa.array([x], pa.int64()) for x in (n, held.offered, held.compared)]], names=["video", "frames", "offered", "compared"])
        for batch in batches:
            for key, item in zip(batch.column(0), batch.column(2), strict=True):
                if held is None or key != video:
                    if held is not None:
                        yield row()
                    video, held, n = key, StructureState(threshold, side, counting=True), 0
                held.offer(item.as_py())
                n += 1
        if held is not None:
            yield row()

    rows = items.where("item IS NOT NULL").select("video", "frame_order", "item")
    counts = [T.StructField(c, T.LongType()) for c in ("frames", "offered", "compared")]
    dealt = rows.repartition("video").sortWithinPartitions("video", "frame_order", "item")
    return dealt.mapInArrow(run, T.StructType([T.StructField("video", rows.schema["video"].dataType), *counts]))


def grid_hash(px: Column) -> Column:
    """The 64-bit hash of an 8 x 8 grid (array<bigint>), as bytes."""

    @F.pandas_udf("binary")
    def hashed(px: pd.Series) -> pd.Series:
        return pd.Series([h.tobytes() for h in images.grid_hash(np.stack(px.to_list()))] if len(px) else [], dtype=object)

    return hashed(px)


def grid_bytes(px: Column) -> Column:
    """The pixels of a grid as bytes."""

    @F.pandas_udf("binary")
    def packed(px: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(p, np.uint8).tobytes() for p in px], dtype=object)

    return packed(px)
