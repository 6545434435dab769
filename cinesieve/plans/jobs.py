"""Runs as rows: what is running, what ended how, in files beside the outputs that any session can read.

<folder>/_jobs/<id>.json is written when a run starts, at each of its steps, and when it is done or has failed. The rows stand
for a job's state and its log; `recent` is the list of the last ones. The oldest runs beyond KEPT go when a new one starts,
with their events (plans.progress), which say what happens between steps.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinesieve.plans.progress import EventLog, Watch
from cinesieve.sinks.files import remove, write_text

SCHEMA = "job_id string, source string, status string, started double, at double, step string, error string, log array<struct<at:double,line:string>>"
KEPT = 20


class Job:
    """A context: running inside it, done after it, error where an exception leaves it."""

    def __init__(self, spark: SparkSession, folder: str, source: str):
        self.spark, self.folder = spark, folder
        self.row = {"job_id": uuid.uuid4().hex[:8], "source": source, "status": "running", "started": time.time(), "at": None, "step": None, "error": None, "log": []}
        self.path = f"{folder.rstrip('/')}/_jobs/{self.row['job_id']}.json"

    def _write(self) -> None:
        self.row["at"] = time.time()
        write_text(self.spark, self.path, json.dumps(self.row) + "\n")

    def step(self, name: str) -> None:
        self.events.add("step", name)
        self.row |= {"step": name}
        self.row["log"].append({"at": time.time(), "line": name})
        self._write()

    def __enter__(self) -> Job:
        self._write()
        evict(self.spark, self.folder)
        self.events = EventLog(self.spark, self.folder, self.row["job_id"])
        self.watch = Watch(self.events)
        self.watch.__enter__()
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.row |= {"status": "done" if kind is None else "error", "error": None if kind is None else f"{kind.__name__}: {error}"[:1000]}
        self.watch.__exit__(kind, error, trace)
        self.events.add("end", self.row["status"])
        self._write()


def evict(spark: SparkSession, folder: str, n: int = KEPT) -> None:
    """Deletes all but the last n runs by their start, running ones too."""
    for r in jobs(spark, folder).orderBy(F.desc("started"), "job_id").offset(n).select("job_id").collect():
        for path in (f"{folder.rstrip('/')}/_jobs/{r.job_id}.json", f"{folder.rstrip('/')}/_jobs/{r.job_id}"):
            remove(spark, path)


def jobs(spark: SparkSession, folder: str) -> DataFrame:
    """All runs that wrote to a folder; no rows where there was none."""
    try:
        return spark.read.schema(SCHEMA).json(f"{folder.rstrip('/')}/_jobs/*.json")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], SCHEMA)


def recent(spark: SparkSession, folder: str, n: int = KEPT) -> DataFrame:
    """The last n runs by their start, the latest first, running ones too."""
    return jobs(spark, folder).orderBy(F.desc("started"), "job_id").limit(n)


def log(spark: SparkSession, folder: str, job_id: str) -> DataFrame:
    """A run's lines (at, line) in their order; none for an unknown run."""
    return jobs(spark, folder).where(F.col("job_id") == job_id).select(F.explode("log").alias("l")).select("l.*").orderBy("at")
