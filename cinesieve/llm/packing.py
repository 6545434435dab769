"""Harmonic packing of token sequences.

Pieces fall into reciprocal-capacity classes: a bin of class k takes exactly k pieces of at most C/k tokens, so no bin looks
at any other. Documents may be cut: whole capacities first, then pieces of exactly C/k tokens, k from CLASSES, until what is
left fills a C/k within `waste`, or is at most C / (the last class): such crumbs form the last class, whose bins take pieces
until the next one doesn't fit. Each worker fills its own classes' bins. Of a class it hands on at most k - 1 pieces, and it
closes its one open bin of crumbs as a short sequence.

What workers hand on is filled by class again, k pieces a bin, in groups of `fan_in` workers and one class: at most
fan_in * (k - 1) pieces each, however large the input is. A group's last bin may be short. No piece is ever placed outside
its class, and no group or worker leaves more than one short sequence a class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinesieve.llm.encoding import encoder
from cinesieve.llm.shared import col, staged

CAPACITY, WASTE, LEAST, FAN_IN = 2048, 0.01, 16, 8
CLASSES = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
#: Sequence numbers: the worker, or REST and more for a group and class, above these bits; the sequence in it below.
BITS, REST, PLACES = 36, 1 << 26, 64
ROWS = 5_000
SCHEMA = "id long, start long, length long, doc_tokens long, ids binary, class int, sequence_id long, offset long"
_ARROW = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary()), ("class", pa.int32()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def cuts(n: int, capacity: int = CAPACITY, classes: tuple[int, ...] = CLASSES, waste: float = WASTE, least: int = LEAST) -> list[int]:
    """The lengths of the pieces of a document of n tokens, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest > capacity // classes[-1]:
        fits = [capacity // k for k in classes if capacity // k >= rest]
        if fits and rest >= fits[-1] * (1 - waste):
            break
        part = next((p for p in (capacity // k for k in classes) if p <= rest - least or p == rest), (rest + 1) // 2)
        out.append(part)
        rest -= part
    return out + [rest] * (rest > 0)


def class_of(length: int, capacity: int = CAPACITY, classes: tuple[int, ...] = CLASSES) -> int:
    """The largest k whose C/k holds the piece; 0 for crumbs, which are under the last class's C/k."""
    return 0 if length < capacity // classes[-1] else max(k for k in classes if capacity // k >= length)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)] if rows else [pa.array([], f.type) for f in _ARROW], schema=_ARROW)


class _Bins:
    """A worker's open bins by class; gives the rows of each bin that is full."""

    def __init__(self, number: int, capacity: int, classes: tuple[int, ...]):
        self.next, self.capacity, self.classes, self.open, self.crumbs = number << BITS, capacity, classes, {}, 0

    def add(self, piece: tuple) -> list[tuple]:
        k, out = class_of(piece[2], self.capacity, self.classes), []
        if not k and self.crumbs + piece[2] > self.capacity:
            out = self.close(0)
        held = self.open.setdefault(k, [])
        held.append(piece)
        self.crumbs += 0 if k else piece[2]
        return self.close(k) if k and len(held) == k else out

    def close(self, k: int) -> list[tuple]:
        out, offset = [], 0
        for p in self.open.pop(k, []):
            out.append((*p, k, self.next, offset))
            offset += p[2]
        self.next += 1
        self.crumbs = self.crumbs if k else 0
        return out

    def rest(self) -> list[tuple]:
        return self.close(0) + [(*p, k, None, None) for k, held in self.open.items() for p in held]


def _fill(tokenizer: str, by_chunk: bool, end_id: int, capacity: int, classes: tuple[int, ...], waste: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, by_chunk), np.array([end_id], "<u4").tobytes()
        bins, rows = _Bins(TaskContext.get().partitionId(), capacity, classes), []
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                n, at = len(ids) // 4, 0
                for length in cuts(n, capacity, classes, waste, least):
                    rows += bins.add((doc, at, length, n, ids[4 * at : 4 * (at + length)]))
                    at += length
                    if len(rows) > ROWS:
                        yield _batch(rows)
                        rows = []
        yield _batch(rows + bins.rest())

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", by_chunk: bool = True, end_id: int = 1, capacity: int = CAPACITY, classes: tuple[int, ...] = CLASSES, waste: float = WASTE, least: int = LEAST, fan_in: int = FAN_IN) -> DataFrame:
    """One row a piece: id_col, start, length, doc_tokens, ids (little-endian unsigned 32-bit), class (0: crumbs), sequence_id, offset.

    A document's ids are those of its text and end_id; a null or empty text has end_id alone. Ids are integers; repeated
    rows and null ids are documents of their own, and ties stand in any order. An empty table gives no pieces. A very long
    text is encoded whole and cut into many pieces, which leave the task in batches; besides it a task holds its open bins.
    Other columns of docs are not read.
    """
    if len(classes) >= PLACES or classes[0] != 1 or list(classes) != sorted(set(classes)):
        raise ValueError("classes are under 64 rising numbers from 1 on")
    texts = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    filled = staged(texts.mapInArrow(_fill(tokenizer, by_chunk, end_id, capacity, classes, waste, least), SCHEMA).withColumn("worker", F.spark_partition_id()), "packing")
    group = F.floor(F.col("worker") / fan_in)
    rests = filled.where("sequence_id IS NULL").withColumn("group", group)
    own = W.partitionBy("class", "group")
    numbered = rests.withColumn("number", F.row_number().over(own.orderBy("id", "start", "worker", "ids")) - 1)
    of_bin = numbered.withColumn("bin", F.expr("number div class"))
    before = F.coalesce(F.sum("length").over(W.partitionBy("class", "group", "bin").orderBy("number").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.array_position(F.array(*[F.lit(k) for k in classes]), F.col("class")) - 1
    sequence = F.shiftleft(F.lit(REST) + F.col("group") * PLACES + place, BITS) + F.col("bin")
    joined = of_bin.withColumns({"sequence_id": sequence, "offset": before})
    columns = [col("id").alias(id_col), "start", "length", "doc_tokens", "ids", "class", "sequence_id", "offset"]
    return filled.where("sequence_id IS NOT NULL").select(*columns).unionByName(joined.select(*columns))
