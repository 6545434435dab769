"""Sharding by a Feistel permutation over global row numbers.

Every row gets its number in the order of the ids; a keyed permutation of 0..n-1 sends it to p, and p mod shards and
p div shards are its shard and its slot there. The counts of the shards differ by one at most, the shuffle depends on
the key and n alone, and either direction is a computation: `place` of a row number, `row_at` of a shard and slot.

Row numbers come without one task that sees all rows: slim rows (no texts) are range-partitioned and sorted, each takes
its place in its partition, and the partitions' sizes, one number a partition, are summed up on the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinesieve.llm.shared import col, partitions, staged

ROUNDS, KEY, SHARDS = 6, 20_240_607, 16
_PART = 33  # monotonically_increasing_id puts the partition above this many bits


def _round(x: np.ndarray, number: int, key: int) -> np.ndarray:
    """A mixing function of 64 bits (splitmix64's finaliser over x, the key and the round)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((key + (number + 1) * 0x9E3779B97F4A7C15) & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _half(n: int) -> int:
    """Bits of each half, so that both together number at least n values and under 4n + 4."""
    return max(1, -(-max(n - 1, 1).bit_length() // 2))


def _walk(x: np.ndarray, n: int, key: int, numbers: range) -> np.ndarray:
    """Feistel rounds in the given order, again and again for those values that still lie beyond n."""
    half = _half(n)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    x = np.asarray(x, np.uint64).copy()
    left_over = np.arange(len(x))
    while len(left_over):
        a, b = x[left_over] >> shift, x[left_over] & mask
        if numbers.step > 0:
            for r in numbers:
                a, b = b, a ^ (_round(b, r, key) & mask)
        else:
            for r in numbers:
                a, b = b ^ (_round(a, r, key) & mask), a
        x[left_over] = (a << shift) | b
        left_over = left_over[x[left_over] >= np.uint64(n)]
    return x.astype(np.int64)


def permute(rows: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    return _walk(rows, n, key, range(ROUNDS))


def unpermute(places: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    return _walk(places, n, key, range(ROUNDS - 1, -1, -1))


def row_at(shard: int, slot: int, n: int, shards: int = SHARDS, key: int = KEY) -> int:
    """The row number that lies in a slot of a shard."""
    return int(unpermute(np.array([slot * shards + shard]), n, key)[0])


def numbered(rows: DataFrame, order: list[str], number_col: str = "row_number") -> tuple[DataFrame, int]:
    """rows with a gapless number from 0 in the order of the columns, and their count. Ties are numbered either way.

    Rows that agree in all columns of the order may fall to one partition; a random tie-breaker parts them, which can't
    show in the result where the order holds all columns.
    """
    spark = rows.sparkSession
    parts = partitions(rows)
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    ordered = tied.repartitionByRange(parts, *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    kept = staged(ordered.withColumn("_at", F.monotonically_increasing_id()), "row-numbers")
    part = F.shiftright("_at", _PART)
    sizes = sorted((r.part, r.n) for r in kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # as many as partitions
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    offsets = spark.createDataFrame(before, "_part long, _before long")
    joined = kept.withColumn("_part", part.cast("long")).join(F.broadcast(offsets), "_part")
    return joined.withColumn(number_col, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _PART) - 1))).drop("_part", "_before", "_at"), total


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, key: int = KEY) -> DataFrame:
    """One row a document: id_col, size (UTF-8 bytes + 1), text_crc32 (unsigned), row_number, shard, slot.

    A null text has size 1 and the checksum of an empty one. Rows are numbered by id (nulls first), checksum and size;
    repeated rows take neighbouring numbers and so fall to different places. A very long text is read once, for its size and
    checksum, and does not move. An empty table gives no rows. Other columns of docs are not read.
    """
    text = F.coalesce(col(text_col), F.lit(""))
    slim = docs.select(col(id_col).alias(id_col), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows, n = numbered(slim, [id_col, "text_crc32", "size"])

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), n, key))

    placed = rows.withColumn("_place", place("row_number"))
    return placed.select(id_col, "size", "text_crc32", "row_number", (F.col("_place") % shards).cast("int").alias("shard"), F.expr(f"_place div {shards}").alias("slot"))
