"""Exact deduplication by most-significant-digit radix partitioning.

A text is a string of digits: its first 64 bytes, the next 512, and so on. Texts that agree in all digits so far are a group;
a group ends when it has one text or when its texts do, and is split by the next digit otherwise. Digits are compared as they
are, no digest stands for a text.

First each task splits the texts of a window of its own rows to the end, so that a text of a third of all rows is one row a
window from there on. Then rounds of counts, without moving a text, find the groups of more bytes than a task should hold:
their prefixes are a trie whose nodes are at most total / least weight a level. Its nodes that have ended are classes already,
whatever their size, known from the counts. At last each of the other texts moves once, to the task of its leaf, a group of
bounded size, which the task splits to the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinesieve.llm.shared import col, salted, staged

#: Bytes of the first digit, how much wider each next one is, and the widest.
FIRST, GROWTH, WIDEST = 64, 8, 1 << 18
#: A window's bytes and rows.
WINDOW, ROWS = 16 << 20, 1 << 16
#: A leaf may weigh total / LEAVES, within these bounds; a text weighs its bytes and ROW more. Groups of fewer than FEW rows
#: are leaves in any case.
LEAVES, LEAST, MOST, ROW, FEW = 1 << 14, 256 << 10, 64 << 20, 64, 16
#: The trie's nodes of a level go to all executors up to this many bytes; beyond it texts are joined to them with salts.
BROADCAST = 32 << 20
PARTITION = 64 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
COLLAPSED = "ids array<long>, text binary"
_COLLAPSED = pa.schema([("ids", pa.list_(pa.int64())), ("text", pa.binary())])
FINISHED = "ids array<long>, owns boolean, keep_id long, group_size long, text_sha256 string"
_FINISHED = pa.schema([("ids", pa.list_(pa.int64())), ("owns", pa.bool_()), ("keep_id", pa.int64()), ("group_size", pa.int64()), ("text_sha256", pa.string())])


def width(at: int) -> int:
    """Bytes of the digit that begins after `at` bytes."""
    start, size = 0, FIRST
    while start < at:
        start, size = start + size, min(size * GROWTH, WIDEST)
    return size


def equal(texts: list[bytes], at: int = 0) -> Iterator[list[int]]:
    """The indexes of equal texts, group by group, in their order; all texts agree in their first `at` bytes."""
    groups = [(list(range(len(texts))), at)] if texts else []
    while groups:
        own, at = groups.pop()
        size, parts = width(at), {}
        for i in own:
            parts.setdefault(texts[i][at : at + size], []).append(i)
        for digit, members in parts.items():
            if len(members) == 1 or len(digit) < size:
                yield members
            else:
                groups.append((members, at + size))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text of a window, in lower case, with its ids, the largest first."""

    def classes() -> pa.RecordBatch:
        lists, own = [], []
        for members in equal(texts):
            lists.append(sorted((ids[i] for i in members), key=lambda x: (x is not None, x or 0), reverse=True))
            own.append(texts[members[0]])
        return pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.int64())), pa.array(own, pa.binary())], schema=_COLLAPSED)

    ids, texts, size = [], [], 0
    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), pc.cast(batch.column(1), pa.binary()), strict=True):
            ids.append(i)
            texts.append((text.as_py() or b"").translate(_LOWER))
            size += len(texts[-1])
            if size >= WINDOW or len(texts) >= ROWS:
                yield classes()
                ids, texts, size = [], [], 0
    if texts:
        yield classes()


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, ids, text, node, at, digit), sorted by the last three, leaf by leaf into classes."""

    def classes() -> Iterator[pa.RecordBatch]:
        out = []
        for members in equal([t for _, _, t in leaf], key[1]):
            own = [leaf[i] for i in members]
            best = max(own, key=lambda r: (r[1][0] is not None, r[1][0] or 0, -r[0]))
            n, digest = sum(len(r[1]) for r in own), sha256(own[0][2]).hexdigest()
            out += [{"ids": r[1], "owns": r is best, "keep_id": best[1][0], "group_size": n, "text_sha256": digest} for r in own]
        yield pa.RecordBatch.from_pylist(out, _FINISHED)

    key, leaf = None, []
    for batch in batches:
        for row, ids, text, *own in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if own != key:
                if leaf:
                    yield from classes()
                key, leaf = own, []
            leaf.append((row, ids, text))
    if leaf:
        yield from classes()


def _split(rows: DataFrame, nodes: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the nodes' leaves with what nodes know of them, and the other rows; size: the nodes' bytes."""
    if size <= BROADCAST:
        return rows.join(F.broadcast(nodes), "leaf"), rows.join(F.broadcast(nodes.select("leaf")), "leaf", "left_anti")
    both = staged(salted(rows, nodes, "leaf", F.col("row"), "left"), "met-nodes")
    return both.where("child IS NOT NULL"), both.where("child IS NULL").select(*rows.columns)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id_col, keep_id, group_size, kept, text_sha256 (of the text in lower case).

    Texts are equal that are identical after A-Z are lower-cased; null counts as empty. The row with the largest id stays; a
    null id is less than any, and of several rows with the largest id one stays. Whole texts of any length; repeated rows
    count each. An empty table gives no rows. Ids are integers; other columns are not read.
    """
    spark = docs.sparkSession
    collapsed = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text")).mapInArrow(_collapse, COLLAPSED)
    weight = (F.octet_length("text") + ROW).cast("long").alias("weight")
    # written before row numbers are grouped by, as they must not change when a task is run again
    rows = staged(collapsed.select(F.monotonically_increasing_id().alias("row"), "ids", "text", weight), "texts")
    total = rows.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    most = min(max(total // LEAVES, LEAST), MOST)
    walked = rows.withColumns({"node": F.lit(-1).cast("long"), "at": F.lit(0)})
    at, leaves, ended = 0, [], []
    while True:
        size = width(at)
        walked = walked.withColumn("leaf", F.struct("node", F.substring("text", at + 1, size).alias("digit")))
        owner = F.max(F.struct(F.get("ids", F.lit(0)).alias("keep_id"), (-F.col("row")).alias("back"))).alias("own")
        counted = walked.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.min("row").alias("child"), owner, F.sum(F.size("ids")).alias("documents"))
        heavy = counted.where((F.col("w") > most) & (F.col("n") >= FEW)).select("leaf", "child", (F.octet_length("leaf.digit") < size).alias("ended"), "own", "documents")
        nodes = staged(heavy, "trie")
        n, n_open, n_bytes = nodes.agg(F.count("*"), F.count_if(~F.col("ended")), F.coalesce(F.sum(F.octet_length("leaf.digit") + 64), F.lit(0))).first()
        # a row leaves the walk where its leaf is light or has ended, so that no later round reads or joins it again
        met, light = _split(walked, nodes, n_bytes) if n else (None, walked)
        leaves.append(light.select("row", "ids", "text", "node", "at", F.col("leaf.digit").alias("digit")))
        if n:
            own = F.col("row") == -F.col("own.back")
            ended.append(met.where("ended").select("ids", own.alias("owns"), "own.keep_id", F.col("documents").alias("group_size"), F.sha2("text", 256).alias("text_sha256")))
        if not n_open:
            break
        at += size
        deeper = met.where("NOT ended").select("row", "ids", "text", "weight", F.col("child").alias("node"), F.lit(at).alias("at"))
        walked = staged(deeper, "deeper")
    leaves = reduce(DataFrame.unionByName, leaves)
    dealt = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PARTITION)
    finished = leaves.repartition(dealt, "node", "at", "digit").sortWithinPartitions("node", "at", "digit").mapInArrow(_finish, FINISHED)
    each = reduce(DataFrame.unionByName, ended, finished).select(F.posexplode("ids").alias("place", id_col), "keep_id", "group_size", "owns", "text_sha256")
    return each.select(col(id_col), "keep_id", "group_size", (F.col("owns") & (F.col("place") == 0)).alias("kept"), "text_sha256")


def _depths(at: int) -> list[int]:
    """Where digits begin, up to `at`."""
    out = [0]
    while out[-1] < at:
        out.append(out[-1] + width(out[-1]))
    return out
