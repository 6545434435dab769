"""What the training-data operators share: staging in the cluster's folder, names, joins of hot keys, word rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinesieve.functions.columns import let
from cinesieve.sources.storage import released, scratch

#: The white space that separates words (space and 0x09-0x0D).
SPACES = "\t\n\x0b\f\r "
SALTS = 16

__all__ = ["SALTS", "SPACES", "col", "let", "new_names", "partitions", "released", "salted", "staged", "words"]


def staged(df: DataFrame, label: str, codec: str = "zstd", partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    This cuts the lineage, survives lost executors and makes a result that is used twice be computed once.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    writer = df.write.option("compression", codec)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def col(name: str) -> Column:
    """A column by its name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def new_names(df: DataFrame, *labels: str) -> list[str]:
    """Column names that df can't have."""
    tail = uuid.uuid4().hex
    assert not any(c.lower().endswith(tail) for c in df.columns)
    return [f"{label}_{tail}" for label in labels]


def salted(rows: DataFrame, values: DataFrame, key: str, by: Column, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """rows joined to values, which has one row a key; a hot key's rows are dealt over `salts` tasks by the hash of `by`.

    values is repeated for each salt. Repeated rows compress so well that Spark would take their broadcast for small: the
    hint keeps them out of one. `key` is not null.
    """
    (salt,) = new_names(rows, "salt")
    each = values.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).hint("merge")
    return rows.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(salts))).join(each, [key, salt], how).drop(salt)


def partitions(df: DataFrame) -> int:
    """How many partitions a shuffle of df's whole rows takes: as many as its scan has, and the session's number at least."""
    return max(df.rdd.getNumPartitions(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def words(text: Column) -> Column:
    """The maximal runs of characters other than SPACES; no words for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)), " ", -1), "")
