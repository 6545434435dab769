"""Where intermediate tables go: the folder that the session names for checkpoints, which driver and executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Where a local session without spark.checkpoint.dir puts its tables.
LOCAL = "file:///tmp/checkpoints"
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A local folder is set only where the session names none and runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        root = LOCAL
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a table that scratch named, and nothing outside the shared folder."""
    if not path.startswith(f"{shared_dir(spark)}/"):
        raise ValueError(f"{path} is not a scratch table")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def released(spark: SparkSession, keep: int = 0) -> Iterator[None]:
    """Deletes the scratch tables that were named inside the block when it ends, but for the last `keep` of them.

    For callers that have written or read all that they need of these tables by then.
    """
    mark = len(_MADE)
    yield
    done = _MADE[mark : len(_MADE) - keep]
    del _MADE[mark : len(_MADE) - keep]
    for path in done:
        forget(spark, path)
