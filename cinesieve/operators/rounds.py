"""Greedy first-match deduplication of long videos in rounds, so that one video's frames are compared in many tasks.

The kept frames are the lexicographically first maximal independent set of the similarity graph in frame order. A round takes
the next BLOCK undecided frames of each video, decides them one after another in one task, and sends those that it keeps to
all shares of the video, where each later frame meets them: one that matches is a duplicate of the first that it matches, the
others wait for the next round. As blocks follow the order, a frame meets kept frames in their order, and the result is that of
the sequential rule for any graph, chains of similar frames as well. No pair is ever a row: a round makes a row a frame.

A task holds one block's kept items. Rounds are as many as blocks of frames that no earlier block has decided.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinesieve.operators import dedup
from cinesieve.sources.storage import forget, scratch

#: Frames of a block and of a share: hashes, or images by structure.
BLOCK, SHARE = {"ssim": 256}, {"ssim": 2048}
BLOCK_OF_HASHES, SHARE_OF_HASHES = 8192, 1 << 16
#: Rows that a task takes out of a batch at a time, as an image may be 64 KB.
PART = 512
_OUT = ("video", "frame_order", "item", "row", "disposition", "similarity")


def _decide(method: str, threshold: float, size: int):
    """Rows (video, share, in_block, frame_order, item, row, disposition, similarity), sorted by these: those of a block come
    first and are held where they are unique, the others come out with what they match."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, seen = None, None, set()
        parts = (batch.slice(at, PART) for batch in batches for at in range(0, batch.num_rows, PART))
        for batch in parts:
            out = []
            for r in batch.to_pylist():
                if place != (r["video"], r["share"]):
                    place, held, seen = (r["video"], r["share"]), dedup.state(method, threshold, size), set()
                if r["in_block"] == 0:
                    seen.add(r["row"])
                    if r["disposition"] == "unique":
                        held.add(r["item"])
                elif r["row"] not in seen:
                    found = held.find(r["item"])
                    out.append(r | {"disposition": None if found is None else "duplicate", "similarity": found})
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], batch.schema.field(c).type) for c in _OUT], names=list(_OUT))

    return run


def _in_order(method: str, threshold: float, size: int):
    """Rows of blocks, sorted by video and order, with what the sequential rule makes of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, held = None, None
        for batch in batches:
            dispositions, similarities = [], []
            for key, item in zip(batch.column(0), batch.column(2), strict=True):
                if held is None or key != video:
                    video, held = key, dedup.state(method, threshold, size)
                found = held.offer(item.as_py())
                dispositions.append("unique" if found is None else "duplicate")
                similarities.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dispositions, pa.string()), pa.array(similarities, pa.float64())], names=list(_OUT))

    return run


def greedy(items: DataFrame, threshold: float, method: str = "phash", size: int = 256, block: int | None = None, share: int | None = None) -> DataFrame:
    """What dedup.greedy returns, for videos of any length: video, frame_order, disposition, similarity.

    block: frames that one task decides one after another; share: frames of a video that one task compares with a block.
    Ties in frame_order are broken by the item; null items are hash_error or unreadable. An empty table gives no rows.
    """
    spark, block, share = items.sparkSession, block or BLOCK.get(method, BLOCK_OF_HASHES), share or SHARE.get(method, SHARE_OF_HASHES)
    kinds = {f.name: f.dataType for f in items.schema}
    table = T.StructType([T.StructField("video", kinds["video"]), T.StructField("frame_order", kinds["frame_order"]), T.StructField("item", T.BinaryType()), T.StructField("row", T.LongType()), T.StructField("disposition", T.StringType()), T.StructField("similarity", T.DoubleType())])

    def written(df: DataFrame, path: str) -> DataFrame:
        df.write.mode("append").parquet(path)
        return spark.read.schema(table).parquet(path)

    nothing = {"disposition": F.lit(None).cast("string"), "similarity": F.lit(None).cast("double")}
    # row numbers tell repeated rows apart; written first, as they must not change when a task is run again
    at = scratch(spark, "undecided")
    open_ = written(items.select("video", "frame_order", "item").withColumn("row", F.monotonically_increasing_id()).withColumns(nothing), at)
    unread = open_.where("item IS NULL").withColumn("disposition", F.lit("unreadable" if method == "ssim" else "hash_error"))
    done = scratch(spark, "decided")
    decided = written(unread, done)
    open_ = open_.where("item IS NOT NULL")
    longest = open_.groupBy("video").count().agg(F.max("count")).first()[0] or 0
    shares = max(1, -(-longest // share))
    order = ["frame_order", "item", "row"]
    while not open_.isEmpty():
        first = open_.withColumn("place", F.row_number().over(W.partitionBy("video").orderBy(*order))).where(F.col("place") <= block).select(*_OUT[:4])
        of_block = written(first.repartition("video").sortWithinPartitions("video", *order).mapInArrow(_in_order(method, threshold, size), table), scratch(spark, "block"))
        everywhere = of_block.withColumns({"share": F.explode(F.sequence(F.lit(0), F.lit(shares - 1))), "in_block": F.lit(0)})
        dealt = open_.withColumns({"share": F.pmod(F.xxhash64("row"), F.lit(shares)).cast("int"), "in_block": F.lit(1)})
        both = everywhere.unionByName(dealt).select("video", "share", "in_block", *_OUT[1:])
        after = scratch(spark, "undecided")
        met = written(both.repartition("video", "share").sortWithinPartitions("video", "share", "in_block", *order).mapInArrow(_decide(method, threshold, size), table), after)
        written(of_block, done)
        decided = written(met.where("disposition IS NOT NULL"), done)
        open_ = met.where("disposition IS NULL")
        forget(spark, at)
        at = after
    return decided.select("video", "frame_order", "disposition", "similarity")


def deduplicated(items: DataFrame, threshold: float, method: str = "phash", size: int = 256, longest: int | None = None) -> DataFrame:
    """dedup.greedy, with videos of more than `longest` frames (eight blocks) in rounds. Items are read three times."""
    longest = longest or 8 * BLOCK.get(method, BLOCK_OF_HASHES)
    long = items.groupBy("video").count().where(F.col("count") > longest).select("video")
    if long.isEmpty():
        return dedup.greedy(items, threshold, method, size)
    short = dedup.greedy(items.join(long, items["video"].eqNullSafe(long["video"]), "left_anti"), threshold, method, size)
    return short.unionByName(greedy(items.join(long, items["video"].eqNullSafe(long["video"]), "left_semi"), threshold, method, size))
