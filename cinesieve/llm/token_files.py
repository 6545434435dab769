"""Token ids in binary segments with Elias-Fano document boundaries.

Documents are range-partitioned by id; each task encodes its texts in order and writes segments. A segment is one binary
image, so it can stand in any store that Spark writes:

    magic "EFTK", format 1, bytes an id (2 or 4), docs, ids, low bits, select step   header, little-endian
    low bits      docs + 1 numbers of `low` bits: the low parts of the boundaries
    high bits     unary: boundary i sets bit (boundary >> low) + i
    select        the position of every `step`-th set bit, unsigned 32-bit
    ids           all ids one after another

Boundary i is where document i begins; the last one is the number of ids. Elias-Fano takes 2 + log2(ids / docs) bits a
boundary. A segment holds at most `segment_ids` ids unless one document alone has more, so that positions fit 32 bits
without any 64-bit table; the start of a segment among all ids is the sum over the workers before it, of which there are
as many as partitions, and what its own worker wrote before.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinesieve.llm.encoding import encoder
from cinesieve.llm.shared import col, partitions, staged

MAGIC, HEADER, STEP = b"EFTK", struct.Struct("<4sHHQQHH"), 64
SEGMENT_IDS = 1 << 20


class EliasFano:
    """Non-decreasing integers: low bits side by side, high bits in unary, and samples for select."""

    def __init__(self, low: int, low_bits: np.ndarray, high_bits: np.ndarray, select: np.ndarray, count: int, step: int = STEP):
        self.low, self.low_bits, self.high_bits, self.samples, self.count, self.step = low, low_bits, high_bits, select, count, step

    @classmethod
    def of(cls, values: np.ndarray, step: int = STEP) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low = max(0, int(np.log2(top / n))) if n and top > n else 0
        lows = (values[:, None] >> np.arange(low)) & 1
        ones = (values >> low) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(low, np.packbits(lows.astype(np.uint8).ravel(), bitorder="little"), np.packbits(high, bitorder="little"), ones[::step].astype("<u4"), n, step)

    def get(self, i: int) -> int:
        """Value i, from the sample before it, a scan over at most a few words of high bits, and its low bits."""
        at, seen = int(self.samples[i // self.step]), i - i % self.step
        byte = at >> 3
        bits = int(self.high_bits[byte]) >> (at & 7) << (at & 7)
        while seen + bits.bit_count() <= i:
            seen += bits.bit_count()
            byte += 1
            bits = int(self.high_bits[byte])
        for _ in range(i - seen):
            bits &= bits - 1
        one = byte * 8 + (bits & -bits).bit_length() - 1
        first = i * self.low
        raw = int.from_bytes(self.low_bits[first >> 3 : (first + self.low + 7 >> 3)].tobytes(), "little")
        return (one - i) << self.low | raw >> (first & 7) & ((1 << self.low) - 1)

    def all(self) -> np.ndarray:
        """All values at once."""
        highs = np.flatnonzero(np.unpackbits(self.high_bits, bitorder="little"))[: self.count] - np.arange(self.count)
        lows = np.unpackbits(self.low_bits, bitorder="little", count=self.count * self.low).reshape(self.count, self.low).astype(np.int64)
        return (highs.astype(np.int64) << self.low) + lows @ (1 << np.arange(self.low, dtype=np.int64))


def write_segment(docs: list[bytes], width: int = 2) -> bytes:
    """The image of documents given as little-endian unsigned 32-bit ids."""
    ids = np.frombuffer(b"".join(docs), "<u4")
    if width == 2 and len(ids) and ids.max() > 0xFFFF:
        width = 4
    ef = EliasFano.of(np.concatenate([[0], np.cumsum([len(d) // 4 for d in docs])]))
    header = HEADER.pack(MAGIC, 1, width, len(docs), len(ids), ef.low, ef.step)
    return b"".join([header, ef.low_bits.tobytes(), struct.pack("<Q", len(ef.high_bits)), ef.high_bits.tobytes(), ef.samples.tobytes(), ids.astype(f"<u{width}").tobytes()])


class Segment:
    """Reads an image; `doc(i)` gives one document's ids without decoding the others' boundaries."""

    def __init__(self, image: bytes):
        view = memoryview(image)
        magic, form, self.width, self.docs, self.size, low, step = HEADER.unpack(view[: HEADER.size])
        if magic != MAGIC or form != 1:
            raise ValueError("not a token segment")
        count, at = self.docs + 1, HEADER.size
        low_bytes = (count * low + 7) // 8
        (high_bytes,) = struct.unpack_from("<Q", view, at + low_bytes)
        high = at + low_bytes + 8
        samples = -(-count // step)
        self.bounds = EliasFano(
            low, np.frombuffer(view, np.uint8, low_bytes, at), np.frombuffer(view, np.uint8, high_bytes, high), np.frombuffer(view, "<u4", samples, high + high_bytes), count, step
        )
        self.ids = np.frombuffer(view, f"<u{self.width}", self.size, high + high_bytes + 4 * samples)

    def doc(self, i: int) -> np.ndarray:
        return self.ids[self.bounds.get(i) : self.bounds.get(i + 1)]


_WRITTEN = pa.schema([("worker", pa.int64()), ("segment", pa.int64()), ("base", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("image", pa.binary())])
WRITTEN = "worker long, segment long, base long, n_ids long, doc_ids array<long>, image binary"
_READ = pa.schema([("id", pa.int64()), ("worker", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
READ = "id long, worker long, at long, n_tokens long, ids binary"


def _encode(tokenizer: str, by_chunk: bool, end_id: int, segment_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, by_chunk), np.array([end_id], "<u4").tobytes()
        worker, segment, base, size = TaskContext.get().partitionId(), 0, 0, 0
        names: list = []
        docs: list[bytes] = []

        def flush() -> pa.RecordBatch:
            row = {"worker": worker, "segment": segment, "base": base, "n_ids": size, "doc_ids": names, "image": write_segment(docs)}
            return pa.RecordBatch.from_pylist([row], _WRITTEN)

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                if docs and size + len(ids) // 4 > segment_ids:
                    yield flush()
                    segment, base, size, names, docs = segment + 1, base + size, 0, [], []
                names.append(name)
                docs.append(ids)
                size += len(ids) // 4
        if docs:
            yield flush()

    return run


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for worker, base, names, image in zip(*[batch.column(c) for c in ("worker", "base", "doc_ids", "image")], strict=True):
            read, names, start = Segment(image.as_py()), names.as_py(), base.as_py()
            last, rows = 0, []
            for i, name in enumerate(names):
                first, last = last, read.bounds.get(i + 1)  # select: the boundaries are never a table
                rows.append((name, worker.as_py(), start + first, last - first, read.ids[first:last].astype("<u4").tobytes()))
                if len(rows) == 500 or i + 1 == len(names):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)
                    rows = []


def write(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", by_chunk: bool = True, end_id: int = 2, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Writes the segments into the shared folder; returns them as rows: worker, segment, base, n_ids, doc_ids, image.

    Documents follow each other by id, nulls first, then by text hash; rows that are equal in both may stand either way.
    A null or empty text has end_id alone. Ids are integers; repeated rows stay. A very long text is encoded whole; one of
    more than `segment_ids` ids has a segment of its own. An empty table gives no segment. Whole texts are dealt into as
    many ranges as the scan has partitions, so a range is no larger for a larger table. Other columns of docs are not read.
    """
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    ordered = rows.repartitionByRange(partitions(docs), "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    return staged(ordered.mapInArrow(_encode(tokenizer, by_chunk, end_id, segment_ids), WRITTEN), "token-files")


def read(segments: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a document from the images: id_col, start (ids of all documents before it), n_tokens, ids (unsigned 32-bit).

    Where a document begins is asked of the image's select structure. No segments give no rows; null ids and repeats stay.
    """
    spark = segments.sparkSession
    totals = sorted((r.worker, r.n) for r in segments.groupBy("worker").agg(F.sum("n_ids").alias("n")).collect())  # as many as partitions
    starts, at = [], 0
    for worker, n in totals:
        starts.append((worker, at))
        at += n
    before = spark.createDataFrame(starts, "worker long, before long")
    rows = segments.select("worker", "base", "doc_ids", "image").mapInArrow(_decode, READ)
    return rows.join(F.broadcast(before), "worker").select(F.col("id").alias(id_col), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")
