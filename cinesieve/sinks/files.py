"""Manifests of output files, and files written or copied in the tasks.

Tasks reach local (shared) folders and the stores that pyarrow opens. Files of a job are written into a folder of parts
under the output first, and moved to their places once all are there: a job that fails, and a task that is tried again,
leave no file behind, parts included.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinesieve.functions.columns import fixed, suffix
from cinesieve.sources.storage import released, scratch

STATUS = "path string, part string, bytes long, error string"
_ARROW = pa.schema([("path", pa.string()), ("part", pa.string()), ("bytes", pa.int64()), ("error", pa.string())])
#: Folders of parts, so that none of them holds more entries than a store takes; made before the tasks, which make none.
FOLDERS, CHUNK = 64, 1 << 20


def opened(path: str):
    """The file system of a path, and the path there."""
    from pyarrow import fs

    scheme, _, rest = path.partition(":") if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else ("file", "", path)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/") if rest.startswith("/") else rest
    authority = rest.removeprefix("//").partition("/")[0]
    return fs.FileSystem.from_uri(f"{scheme}://{authority}/")[0], rest.removeprefix("//") if scheme != "hdfs" else rest.removeprefix("//")[len(authority) :]


def _put(path: str, chunks: Iterator[bytes]) -> int:
    """Writes a file into a folder that is there; its bytes."""
    fs, place = opened(path)
    size = 0
    with fs.open_output_stream(place) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    return size


def _move(part: str, path: str) -> None:
    """A part to its place. A task that is tried again finds some parts moved already."""
    from pyarrow import fs as stores

    (fs, source), (_, place) = opened(part), opened(path)
    if fs.get_file_info(source).type == stores.FileType.NotFound and fs.get_file_info(place).type == stores.FileType.File:
        return
    fs.create_dir(place.rsplit("/", 1)[0], recursive=True)
    fs.move(source, place)


def read_bytes(path: str) -> bytes:
    fs, place = opened(path)
    with fs.open_input_stream(place) as file:
        return file.read()


def chunks_of(*paths: str) -> Iterator[bytes]:
    """The bytes of files one after another, CHUNK at a time."""
    for path in paths:
        fs, place = opened(path)
        with fs.open_input_stream(place) as file:
            while chunk := file.read(CHUNK):
                yield chunk


def _each(work: Callable[[dict], tuple[str | None, int]]):
    """A status row for each row: the part and the bytes that the work returns, or its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    part, size = work(row)
                    out.append({"path": row["path"], "part": part, "bytes": size, "error": None})
                except Exception as error:  # noqa: BLE001  one file's error is its row's
                    out.append({"path": row["path"], "part": None, "bytes": None, "error": f"{type(error).__name__}: {error}"[:500]})
            yield pa.RecordBatch.from_pylist(out, _ARROW)

    return run


def _done(status: DataFrame, large: int | None = None) -> tuple[int, list[str]]:
    """How many files, and notes on some of those of `large` bytes and more; any error is raised."""
    n, failed, error = status.agg(F.count_if(F.col("error").isNull()), F.count("error"), F.min("error")).first()
    if failed:
        raise OSError(f"{failed} files could not be written; one of them: {error}")
    found = status.where(F.col("bytes") >= large).orderBy("path").select("path", "bytes").limit(100).collect() if large else []
    return n, [f"{x.path} has {x.bytes >> 20} MB" for x in found]


def commit(rows: DataFrame, content: Callable[[dict], Iterator[bytes]], folder: str, large: int | None = None) -> tuple[int, list[str]]:
    """Writes a file for each row (path, ...) under folder: all of them, or none where one can't be written.

    Tasks write parts into a folder of their own under `folder`, and the table of statuses, which Spark commits, names one part
    a row, whatever was tried meanwhile. Then tasks move these to their places, in place of what was there, and the folder
    of parts goes. A failure during the moves leaves whole files alone, some of them new. No rows write nothing. A count,
    the first error and a few notes reach the driver.
    """
    spark, parts = rows.sparkSession, f"{folder.rstrip('/')}/_parts-{uuid.uuid4().hex}"

    def written(row: dict) -> tuple[str, int]:
        name = uuid.uuid4()
        part = f"{parts}/{name.int % FOLDERS}/{name.hex}"
        return part, _put(part, content(row))

    for i in range(FOLDERS):
        make_folder(spark, f"{parts}/{i}")
    try:
        with released(spark):
            at = scratch(spark, "parts")
            rows.mapInArrow(_each(written), STATUS).write.parquet(at)
            status = spark.read.parquet(at)
            result = _done(status, large)
            _done(status.select("path", "part").mapInArrow(_each(lambda row: (None, _move(row["part"], row["path"]))), STATUS))
            return result
    finally:
        remove(spark, parts)


def write(rows: DataFrame, folder: str) -> int:
    """Writes rows (path, text), a file each."""
    return commit(rows.select("path", "text"), lambda row: iter([row["text"].encode("utf-8")]), folder)[0]


def copy(manifest: DataFrame, folder: str) -> int:
    """Copies a manifest's files (src, dest)."""
    return commit(manifest.select("src", F.col("dest").alias("path")), lambda row: chunks_of(row["src"]), folder)[0]


def concatenate(spark: SparkSession, lines: DataFrame, path: str) -> str:
    """Ordered rows (value), a line each, as one file: tasks write their ranges of it, and one streams these together."""
    folder = path.rsplit("/", 1)[0]
    with released(spark):
        at = scratch(spark, "lines")
        lines.write.text(at)
        ranges = sorted(place for name, place, _ in entries(spark, at) if name.startswith("part-"))
        commit(spark.createDataFrame([(path, ranges)], "path string, ranges array<string>"), lambda row: chunks_of(*row["ranges"]), folder)
    return path


def _cleared(row: dict) -> tuple[None, int]:
    from pyarrow import fs as stores

    fs, place = opened(row["path"])
    if fs.get_file_info(place).type == stores.FileType.Directory:
        fs.delete_dir(place)
    return None, 0


def clear(folders: DataFrame) -> int:
    """Deletes folders (path) of an earlier run."""
    return _done(folders.select("path").mapInArrow(_each(_cleared), STATUS))[0]


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def entries(spark: SparkSession, path: str) -> list[tuple[str, str, bool]]:
    """(name, path, is a folder) of what lies directly in a folder, by name; of a file: itself."""
    p, fs = _hadoop(spark, path)
    found = [(s.getPath().getName(), s.getPath().toString(), s.isDirectory()) for s in fs.listStatus(p)]
    return sorted(found)


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that a run has made."""
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """One small file at any path that Spark can write, in place of what was there."""
    p, fs = _hadoop(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    return path


def make_folder(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.mkdirs(p)


def move_text(spark: SparkSession, path: str, text: str) -> None:
    """write_text for readers that look meanwhile: the file appears whole, under a name that was free."""
    folder, name = path.rsplit("/", 1)
    part = write_text(spark, f"{folder}/.{name}.part", text)
    p, fs = _hadoop(spark, path)
    if not fs.rename(_hadoop(spark, part)[0], p):
        raise OSError(f"{path} is there already")


def unique_manifest(curated: DataFrame, folder: str) -> DataFrame:
    """Where the unique frames go: src, dest (<folder>/<video>/unique_frames/unique_0000.ext), numbered from 0 in their order."""
    name = F.concat(F.format_string("unique_%04d", F.col("unique_no")), suffix(F.col("file")))
    return curated.where("disposition = 'unique'").select("video", F.col("origin").alias("src"), F.concat_ws("/", F.lit(folder.rstrip("/")), "video", F.lit("unique_frames"), name).alias("dest"))


def top_manifest(curated: DataFrame, folder: str, n: int) -> DataFrame:
    """Where the n best frames of each video go: <folder>/<video>/top_frames/top_001_score0.00.ext."""
    name = F.concat(F.format_string("top_%03d_score", F.col("rank")), fixed(F.col("scores.total"), 2), suffix(F.col("file")))
    rows = curated.where((F.col("disposition") == "unique") & (F.col("rank") <= n))
    return rows.select("video", F.col("origin").alias("src"), F.concat_ws("/", F.lit(folder.rstrip("/")), "video", F.lit("top_frames"), name).alias("dest"))
