"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint of 64 bits is seen as 32 segments of two bits and mapped to its vector of bit counts, each 0, 1 or 2, packed
into one long again. The Manhattan distance of two such vectors is never above the Hamming distance of the fingerprints.
Vectors at Manhattan distance 4 or less differ in at most four of eight groups of segments, so they agree in all counts of
some four groups: each choice of four groups lays a grid over the vectors, a fingerprint lies in one cell of each of the
70 grids, and linked fingerprints share a cell. Nothing is capped: candidates from the cells are compared by Manhattan
distance and then exactly.

A cell of many near copies isn't compared pair by pair. First every member is compared with two others alone, the cell's
first and the one before it in the cell's own order; the links found so give components. Hot cells are dealt in shares,
whose firsts meet again. Then only members of different components are compared: in each cell, those outside its largest
component against all others. A pair left out is linked already, so that the components are those of all links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinesieve.llm.graph import components
from cinesieve.llm.shared import col, salted, staged

SHINGLE, BITS, SEED = 4, 4, 42
_ODD = 0x5555555555555555
_CHUNK = 1 << 14
#: Shares of a hot cell, and how many mixed cells of 8 bytes each go to all executors.
SHARES, BROADCAST_ROWS = 64, 1 << 20
#: Fingerprints of over 1 / HOT of all rows are labelled by a broadcast.
HOT = 1 << 12


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def words_of(text: str | None) -> list[bytes]:
    """The words in lower case; of bytes, so that A-Z and ASCII white space alone count."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text as a signed long: bit set where over half the shingles' XXH64 (seed 42) have it."""
    words = words_of(text)
    return fingerprint_of(words, b" ".join(words), shingle)


def fingerprint_of(words: list[bytes], joined: bytes, shingle: int = SHINGLE) -> int:
    """The same of a text's words, which joined has with a space between them."""
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n]
    stops = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK].tolist(), stops[at : at + _CHUNK].tolist(), strict=True)])
        ones += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return signed(int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big"))


def hashing(shingle: int):
    """For mapInArrow: (id, text) to (id, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], names=["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    rows = docs.select(col(id_col).cast("long").alias("id"), col(text_col).alias("text"))
    return rows.mapInArrow(hashing(shingle), "id long, fp long")


def embedding(fp: Column) -> Column:
    """The bit counts of the 32 two-bit segments, each in its segment's place."""
    half = F.shiftrightunsigned(fp, 1)
    both = fp.bitwiseAND(half).bitwiseAND(F.lit(_ODD))
    return fp.bitwiseXOR(half).bitwiseAND(F.lit(_ODD)).bitwiseOR(F.shiftleft(both, 1))


def manhattan(a: Column, b: Column) -> Column:
    """Distance of two embeddings: counts differ by 1 where their low bits do, else by 2 where their high bits do."""
    x = a.bitwiseXOR(b)
    two = F.shiftrightunsigned(x, 1).bitwiseAND(F.bitwise_not(x)).bitwiseAND(F.lit(_ODD))
    return F.bit_count(x.bitwiseAND(F.lit(_ODD))) + 2 * F.bit_count(two)


def near(a: Column, b: Column, bits: int) -> Column:
    """The lower bound first, then the exact distance."""
    return (manhattan(embedding(a), embedding(b)) <= bits) & (F.bit_count(a.bitwiseXOR(b)) <= bits)


def _masks(bits: int, groups: int = 8) -> list[int]:
    """For each choice of groups - bits of the groups of eight bits, the bits of the others."""
    return [signed(sum(0xFF << 8 * g for g in range(groups) if g not in chosen)) for chosen in combinations(range(groups), groups - bits)]


def in_cells(prints: DataFrame, bits: int) -> DataFrame:
    """prints (fp, ...) once for each grid, with its cell there; the bits of unused groups are set, which no count does."""
    masks = F.array(*[F.lit(m) for m in _masks(bits)])
    return prints.withColumn("_e", embedding(F.col("fp"))).withColumn("_m", F.explode(masks)).withColumn("cell", F.col("_e").bitwiseOR(F.col("_m"))).drop("_e", "_m")


def dealt(prints: DataFrame) -> DataFrame:
    """Slim rows (fp, ...) over as many tasks as a shuffle has, before each becomes 70: a written table of them has few files."""
    return prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")


def hot_cells(prints: DataFrame, bits: int) -> DataFrame:
    """Cells that may be too large for one task: at most 70 * 256, found in a 64th of the fingerprints.

    They only decide where comparisons run: every link between components is found by `_last_links` anyhow.
    """
    some = prints.select("fp").where(F.pmod(F.xxhash64("fp"), F.lit(SHARES)) == 0)
    least = max(32, some.count() // 256)
    return staged(in_cells(some, bits).groupBy("cell").agg(F.count("*").alias("_n")).where(F.col("_n") > least).select("cell"), "hot-cells")


def _first_links(prints: DataFrame, bits: int) -> DataFrame:
    turned = F.expr("shiftleft(fp, cast(pmod(hash(cell), 64) as int)) | shiftrightunsigned(fp, cast(64 - pmod(hash(cell), 64) as int))")
    hot = F.broadcast(hot_cells(prints, bits).select(F.col("cell").alias("_hot")))
    share = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("fp"), F.lit(SHARES))).otherwise(0)
    members = in_cells(dealt(prints.select("fp")), bits).join(hot, F.col("cell") == F.col("_hot"), "left").withColumns({"_o": turned, "share": share})

    def neighbours(rows: DataFrame, *group: str) -> DataFrame:
        order = W.partitionBy(*group).orderBy("_o")
        seen = rows.withColumns({"first": F.first("fp").over(order), "before": F.lag("fp").over(order)}).where("before IS NOT NULL")
        close = [F.when(near(F.col("fp"), F.col(other), bits), F.col(other)) for other in ("first", "before")]
        links = seen.select("fp", F.array_compact(F.array(*close)).alias("others")).where(F.size("others") > 0)
        return links.select(F.col("fp").alias("a"), F.explode("others").alias("b"))

    leaders = members.where("_hot IS NOT NULL").groupBy("cell", "share").agg(F.min(F.struct("_o", "fp")).alias("m")).select("cell", "m.*")
    return neighbours(members, "cell", "share").union(neighbours(leaders, "cell")).distinct()


def _last_links(labelled: DataFrame, bits: int) -> DataFrame:
    """Links between components, from labelled (fp, component).

    Cells with two components or more are found by aggregates with partial sums, so that a cell's size is no matter; only
    members of such cells become rows.
    """
    members = in_cells(dealt(labelled), bits)
    mixed = staged(members.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("cell"), "mixed-cells")
    few = mixed.count() <= BROADCAST_ROWS  # else both sides are shuffled by cell
    rows = staged(members.join(F.broadcast(mixed) if few else mixed, "cell", "left_semi").select("cell", "fp", "component"), "cells")
    sizes = rows.groupBy("cell", "component").agg(F.count("*").alias("n"))
    major = staged(sizes.groupBy("cell").agg(F.max(F.struct("n", "component")).alias("m")).select("cell", F.col("m.component").alias("major")), "cells")
    a = rows.join(major, "cell").where("component <> major").select("cell", F.col("fp").alias("a"), F.col("component").alias("ca"))
    b = rows.select("cell", F.col("fp").alias("b"), F.col("component").alias("cb"))
    pairs = staged(a, "cells").join(b, "cell").where((F.col("ca") != F.col("cb")) & near(F.col("a"), F.col("b"), bits))
    return pairs.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()


def link(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp, component) of distinct fingerprints (fp): the components of all pairs at `bits` or fewer differing bits (0 to 7)."""
    first = components(_first_links(prints, bits))
    labelled = staged(prints.select("fp").join(first, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("component")), "labels")
    last = components(_last_links(labelled, bits)).select(F.col("node").alias("component"), F.col("component").alias("final"))
    return salted(labelled, last, "component", F.col("fp"), "left").select("fp", F.coalesce("final", "component").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """One row a document: id_col, fingerprint (16 hex digits), component_id (the smallest id that links reach, its own included).

    Null and empty texts have fingerprint zero and are linked like any other. Texts are read whole; shingles of a very long
    one are hashed in parts, with 64 counters as the only state. Equal fingerprints are compared once, however many
    documents have them. Ids are integers; null ones are passed over in component_id, which is null where a component
    has no other. Repeated rows stay. An empty table gives no rows. Other columns of docs are not read.
    """
    prints = staged(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    joined = labelled(prints, named(prints, lambda distinct: link(distinct, bits)))
    return joined.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def named(prints: DataFrame, linking: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(fp, n, component, component_id) of the fingerprints of rows (id, fp, ...), linked as (fp, component); n: their rows."""
    distinct = staged(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    labels = staged(distinct.join(linking(distinct), "fp"), "named-fingerprints")
    least = labels.groupBy("component").agg(F.min("least").alias("component_id"))
    return staged(salted(labels.select("fp", "n", "component"), least, "component", F.col("fp")), "components")


def labelled(rows: DataFrame, components_of: DataFrame) -> DataFrame:
    """rows (fp, ...) with component and component_id. Fingerprints of many rows, HOT of them at most, go to all executors."""
    total = components_of.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    labels, is_hot = components_of.select("fp", "component", "component_id"), F.col("n") > max(64, total // HOT)
    hot = F.broadcast(components_of.where(is_hot).select(*labels.columns))
    return rows.join(hot, "fp").unionByName(rows.join(F.broadcast(components_of.where(is_hot).select("fp")), "fp", "left_anti").join(labels, "fp"))
