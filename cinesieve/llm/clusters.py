"""Centroid clustering by delta Lloyd rounds over integer vectors.

Vectors are written once, in buckets of their row number; so is each round's assignment (row, cluster, distance), so that a
round joins the two without a shuffle. A round sends the centroids to the tasks, k x dimensions integers. A vector whose
owner has not moved is compared with the moved centroids alone, as it lay farther from all others before; only vectors whose
owner moved are compared with every centroid. The sums of the clusters are kept: a round adds up what the vectors that
changed clusters take from one and give to another, as signed integers, a row a batch of a task. When no centroid moves, all
later rounds would change nothing and are left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinesieve.llm.shared import col, staged
from cinesieve.sources.storage import forget, scratch

#: Components of a vector, what a component is multiplied by, and the seed of the first centroids' choice.
DIMENSIONS, SCALE, SEED = 64, 1024, 3
#: Components of this size and more after scaling are left out with their vectors, as squared distances have to fit a long.
LARGEST = 1 << 27
#: Up to this size all products and their sums are whole numbers that doubles hold exactly.
_EXACT = 1 << 22
BUCKET_MB = 32
STATE = "row long, cluster int, distance long, transfer array<long>"
_ARROW = pa.schema([("row", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("transfer", pa.list_(pa.int64()))])


def vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """id and v (array<int>) of the vectors with exactly `dimensions` components, none null, not finite or too large."""
    v = F.transform(col(vector_col), lambda x: x.cast("double") * scale)
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    kept = table.select(col(id_col).alias("id"), v.alias("v")).where((F.size("v") == dimensions) & F.coalesce(whole, F.lit(False)))
    return kept.select("id", F.transform("v", lambda x: F.floor(x).cast("int")).alias("v"))


def _bucketed(df: DataFrame, label: str, buckets: int) -> tuple[DataFrame, str]:
    """df written in buckets of row, and where; the catalog forgets the name at once, as the plan knows the files."""
    spark, path, name = df.sparkSession, scratch(df.sparkSession, label), f"{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "row").option("path", path).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table, path


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of n vectors to m centroids, exact."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) < _EXACT:
        a, b = v.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    a, b = v.astype(np.int64), c.astype(np.int64)
    return np.stack([((a - x) ** 2).sum(axis=1) for x in b], axis=1)


def reassigned(v: np.ndarray, cluster: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New clusters and distances; ties go to the smaller number. A cluster of -1 counts as one that moved."""
    cluster, distance, numbers = cluster.copy(), distance.copy(), np.flatnonzero(moved)
    whole = (cluster < 0) | moved[cluster]
    rest = np.flatnonzero(~whole)
    if len(rest) and len(numbers):
        d = distances(v[rest], centroids[numbers])
        nearest, least = numbers[d.argmin(axis=1)], d.min(axis=1)
        better = (least < distance[rest]) | ((least == distance[rest]) & (nearest < cluster[rest]))
        cluster[rest[better]], distance[rest[better]] = nearest[better], least[better]
    if whole.any():
        d = distances(v[whole], centroids)
        cluster[whole], distance[whole] = d.argmin(axis=1), d.min(axis=1)
    return cluster, distance


def transferred(v: np.ndarray, old: np.ndarray, new: np.ndarray, k: int) -> np.ndarray:
    """k x (dimensions + 1): what the sums and, in the last column, the counts of the clusters gain."""
    out, gone = np.zeros((k, v.shape[1] + 1), np.int64), np.flatnonzero(old != new)
    v, old, new = v[gone].astype(np.int64), old[gone], new[gone]
    for c in range(k):
        to, off = new == c, old == c
        out[c, :-1], out[c, -1] = v[to].sum(axis=0) - v[off].sum(axis=0), to.sum() - off.sum()
    return out


def _round(centroids: np.ndarray, moved: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, values, cluster, distance = batch.columns
            v, old = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, centroids.shape[1]), cluster.to_numpy(zero_copy_only=False)
            new, now = reassigned(v, old, distance.to_numpy(zero_copy_only=False), centroids, moved)
            gains = transferred(v, old, new, len(centroids)).ravel()
            transfers = pa.array([gains if gains.any() else None, *[None] * (len(v) - 1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([row, pa.array(new, pa.int32()), pa.array(now, pa.int64()), transfers], schema=_ARROW)

    return run


def _first(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the least SHA-256 of `seed:id`, in that order; of equal ids the vectors decide, and no id comes last."""
    drawn = rows.select("v", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("draw"))
    return np.array([r.v for r in drawn.orderBy(F.col("draw").asc_nulls_last(), "v").limit(k).collect()], np.int64)


def _gained(state: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of a round's transfers: k x (dimensions + 1) numbers, whatever the vectors."""
    one = state.where("transfer IS NOT NULL").select(F.posexplode("transfer").alias("at", "gain")).groupBy("at").agg(F.sum("gain").alias("gain"))
    out = np.zeros(shape[0] * shape[1], np.int64)
    for r in one.collect():
        out[r["at"]] = r.gain
    return out.reshape(shape)


def cluster(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256; a row for each vector that is kept.

    A centroid is the floor of its vectors' mean, component by component; one without vectors stays where it is. Vectors that
    are null, of another length, or have a component that is null, not finite or of over LARGEST / SCALE, are left out. Rows
    count each for itself: repeated rows, rows of one id and rows without an id stay, and can be several first centroids.
    Fewer vectors than k give as many centroids; none give no rows. Other columns are not read.
    """
    spark = table.sparkSession
    # written once before they are dealt: row numbers that are grouped by must not change when a task is run again
    numbered = staged(vectors(table, id_col, vector_col, dimensions).withColumn("row", F.monotonically_increasing_id()), "vectors")
    buckets = max(spark.sparkContext.defaultParallelism, numbered.count() * dimensions * 4 // (BUCKET_MB << 20))
    rows, _ = _bucketed(numbered.repartition(buckets, "row"), "vector_buckets", buckets)
    centroids = _first(numbered, k, seed)
    if not len(centroids):
        centroids = np.zeros((0, dimensions), np.int64)
    totals, moved, state, earlier = np.zeros((len(centroids), dimensions + 1), np.int64), np.ones(len(centroids), bool), None, None
    for number in range(rounds + 1):
        if state is None:
            known = rows.select("row", "v", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        else:
            known = rows.select("row", "v").join(state.select("row", "cluster", "distance").hint("shuffle_hash"), "row")
        state, path = _bucketed(known.mapInArrow(_round(centroids, moved), STATE), "assignments", buckets)
        if earlier:
            forget(spark, earlier)
        earlier = path
        if number == rounds or not len(centroids):
            break
        totals += _gained(state, totals.shape)
        held = totals[:, -1] > 0
        means = centroids.copy()
        means[held] = totals[held, :-1] // totals[held, -1:]
        moved, centroids = (means != centroids).any(axis=1), means
        if not moved.any():
            break
    inertia = {r.cluster: r.inertia for r in state.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    known = [(i, inertia.get(i, 0), sum(inertia.values()), sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(centroids)]
    about = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    found = rows.select("row", F.col("id").alias(id_col)).join(state.select("row", "cluster", "distance").hint("shuffle_hash"), "row")
    return found.join(F.broadcast(about), "cluster").select(col(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
