"""Videos as frames, for clusters whose workers have ffmpeg and ffprobe.

    video.register(spark)
    spark.read.format("video_frames").option("path", "/videos/a.mp4").option("rangeSeconds", 600).load().where("t_us < 60000000")

A file is one partition, or with `rangeSeconds` one for each range of about that length, cut at key frames, so that a range is
decoded without what lies before it. Conditions on path, video and t_us reach the reader: other videos are not opened and
other ranges not decoded. Frames come as raw pixels through a pipe, or where `size` is given as small ones, which is what a
timeline for scenes needs. `extract` writes frames as images, a video a task, at a rate or at the times that
operators.sampling has chosen. Where ffmpeg is missing, frames that were extracted before are read with
sources.frames.read_frames.
"""

from __future__ import annotations

import itertools
import json
import math
import shutil
import subprocess
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from cinesieve.config import Extraction
from cinesieve.functions import images
from cinesieve.operators import detector, sampling
from cinesieve.sources.frames import local_path

SCHEMA = "video string, path string, frame_order long, t_us long, height int, width int, nChannels int, data binary, lead boolean, error string"
EXTRACTED = "video string, path string, frames long, error string"
#: Timelines for scenes are read at this size, in ranges of about so many seconds.
SMALL, RANGE_SECONDS = "32x18", 600


def video_of(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def _has_tools() -> bool:
    return bool(shutil.which("ffmpeg") and shutil.which("ffprobe"))


def _needs_tools() -> None:
    if not _has_tools():
        raise RuntimeError("ffmpeg and ffprobe are not on this worker: read extracted frames instead (sources.frames.read_frames)")


def local(path: str) -> str:
    """A path that ffmpeg opens: in a folder that all workers share."""
    if ":" in path.split("/")[0] and not path.startswith("file:"):
        raise ValueError(f"{path}: videos are read from and frames extracted to folders that workers mount")
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def _probe(path: str) -> tuple[int, int, float]:
    found = subprocess.run(["ffprobe", "-v", "error", "-select_streams", "v:0", "-show_entries", "stream=width,height,r_frame_rate", "-of", "json", path], capture_output=True, check=False)
    streams = json.loads(found.stdout or b"{}").get("streams") or []
    if found.returncode or not streams:
        raise RuntimeError(f"ffprobe could not read {path}")
    return streams[0]["width"], streams[0]["height"], float(Fraction(streams[0].get("r_frame_rate", "25/1")))


def _key_frames(path: str, rate: float) -> list[int]:
    """Numbers of the frames that can be decoded on their own, rising."""
    found = subprocess.run(["ffprobe", "-v", "error", "-select_streams", "v:0", "-skip_frame", "nokey", "-show_entries", "frame=pts_time", "-of", "json", path], capture_output=True, check=False)
    times = [f.get("pts_time") for f in json.loads(found.stdout or b"{}").get("frames") or []]
    return sorted({round(float(t) * rate) for t in times if t not in (None, "N/A")})


def _chosen(number: int, fps: float, rate: float) -> bool:
    """Whether a frame is the first of its period."""
    return not fps or number == 0 or math.floor(number * fps / rate) > math.floor((number - 1) * fps / rate)


@dataclass
class Range(InputPartition):
    """Frames of a video from number `first` on, to `last`, which isn't among them."""

    path: str
    first: int = 0
    last: int | None = None


class VideoFrames(DataSource):
    """Options: path (one video) or paths (a JSON list), fps (the first frame of each period; absent or 0: every frame), size
    (WxH), rangeSeconds (absent or 0: a video is one partition), lead ("true": each range also gives the frame before it, with
    lead set), errors ("row": a row with an error for a video that can't be read, instead of a failed job)."""

    @classmethod
    def name(cls) -> str:
        return "video_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.fps = json.loads(options["paths"]) if "paths" in options else [options["path"]], float(options.get("fps", 0))
        self.size, self.as_rows, self.lead = options.get("size"), options.get("errors") == "row", options.get("lead") == "true"
        self.seconds, self.least, self.most = float(options.get("rangeSeconds", 0)), 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        """Leaves out videos and ranges that no condition lets through; Spark still checks the rows."""
        names = {"path": lambda p: p, "video": video_of}
        for f in filters:
            match f:
                case EqualTo((("path" | "video") as column,), value):
                    self.paths = [p for p in self.paths if names[column](p) == value]
                case In((("path" | "video") as column,), values):
                    self.paths = [p for p in self.paths if names[column](p) in values]
                case GreaterThan(("t_us",), value) | GreaterThanOrEqual(("t_us",), value):
                    self.least = max(self.least, value)
                case LessThan(("t_us",), value) | LessThanOrEqual(("t_us",), value):
                    self.most = value if self.most is None else min(self.most, value)
                case EqualTo(("t_us",), value):
                    self.least, self.most = max(self.least, value), value if self.most is None else min(self.most, value)
            yield f

    def partitions(self) -> list[Range]:
        with ThreadPoolExecutor(16) as several:
            return [r for own in several.map(self._ranges, self.paths) for r in own]

    def _ranges(self, path: str) -> list[Range]:
        """Cuts at the first key frame after every so many seconds; one range for a video that can't be read, whose task says so."""
        whole = [Range(path)]
        if not self.seconds or not _has_tools():
            return whole
        try:
            rate = _probe(local(path))[2]
            cuts = [0]
            for number in _key_frames(local(path), rate):
                if number - cuts[-1] >= self.seconds * rate:
                    cuts.append(number)
        except (RuntimeError, ValueError):
            return whole
        of_video = [Range(path, a, b) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]
        wanted = [r for r in of_video if (self.most is None or round(r.first * 1e6 / rate) <= self.most) and (r.last is None or round(r.last * 1e6 / rate) > self.least)]
        return wanted

    def read(self, partition: Range) -> Iterator[tuple]:
        if not isinstance(partition, Range):  # where no video is left Spark still asks once
            return
        try:
            _needs_tools()
            yield from self._frames(partition)
        except RuntimeError as error:
            if not self.as_rows:
                raise
            yield video_of(partition.path), partition.path, None, None, None, None, None, None, None, str(error)

    def _frames(self, part: Range) -> Iterator[tuple]:
        file = local(part.path)
        width, height, rate = _probe(file)
        first, last = max(part.first, math.floor(self.least * rate / 1e6)), part.last
        if self.most is not None:
            last = min(x for x in (last, math.floor(self.most * rate / 1e6) + 2) if x is not None)
        if last is not None and last <= first:
            return
        first, lead = first - (self.lead and first > 0), self.lead and first > 0
        filters = [f"select='eq(n+{first},0)+gt(floor((n+{first})*{self.fps}/{rate}),floor((n+{first}-1)*{self.fps}/{rate}))'"] if self.fps else []
        if self.size:
            width, height = map(int, self.size.split("x"))
            filters.append(f"scale={width}:{height}")
        # half a frame less than the range, so that rounding can't let the next frame in
        cut = [*(["-ss", f"{first / rate:.6f}"] if first else []), *(["-t", f"{(last - first - 0.5) / rate:.6f}"] if last is not None else [])]
        command = ["ffmpeg", "-v", "error", *cut, "-i", file, *(["-vf", ",".join(filters)] if filters else []), "-fps_mode", "passthrough", "-f", "rawvideo", "-pix_fmt", "bgr24", "-"]
        numbers, size, video = (n for n in itertools.count(first) if _chosen(n, self.fps, rate)), width * height * 3, video_of(part.path)
        with subprocess.Popen(command, stdout=subprocess.PIPE) as run:
            try:
                while len(data := run.stdout.read(size)) == size:
                    n = next(numbers)
                    yield video, part.path, n + 1, round(n * 1e6 / rate), height, width, 3, data, lead and n == first, None
                done = True
            except GeneratorExit:  # a limit was reached
                run.kill()
                raise
        if done and run.returncode:
            raise RuntimeError(f"ffmpeg could not read {part.path}")


def register(spark: SparkSession) -> None:
    """Makes the source known, and lets conditions reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VideoFrames)


TIMELINE = "key string, t long, order long, value double, change double"
_TIMELINE = pa.schema([("key", pa.string()), ("t", pa.int64()), ("order", pa.int64()), ("value", pa.float64()), ("change", pa.float64())])


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frames in their order, range by range: each one's mean brightness, and how much its channels differ from the frame before."""
    path, before, number = None, None, None
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            bgr = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3)
            channels = images.hsv(bgr).astype(np.int64)
            follows = path == r["path"] and number == r["frame_order"] - 1
            change = float(np.abs(channels - before).mean(axis=(0, 1)).sum()) if follows else 0.0
            path, before, number = r["path"], channels, r["frame_order"]
            if not r["lead"]:
                out.append({"key": path, "t": r["t_us"], "order": number, "value": float(bgr.mean()), "change": change})
        yield pa.RecordBatch.from_pylist(out, _TIMELINE)


def timeline(spark: SparkSession, paths: list[str], range_seconds: float = RANGE_SECONDS) -> DataFrame:
    """key (the path), t, order, value (mean brightness), change (of hue, saturation and brightness to the frame before, added up)
    of small frames: what sampling and the detector take. Ranges of a video are read by several tasks; unreadable videos have no rows."""
    register(spark)
    frames = spark.read.format("video_frames").option("paths", json.dumps(paths)).option("size", SMALL).option("lead", "true").option("rangeSeconds", range_seconds).option("errors", "row").load()
    return frames.where("error IS NULL").select("path", "t_us", "frame_order", "height", "width", "data", "lead").mapInArrow(_changes, TIMELINE)


def extract(spark: SparkSession, videos: DataFrame, raw: str, settings: Extraction) -> DataFrame:
    """Writes frames of videos (video, path) as <raw>/<video>/frame_00001.jpg; one row a video: video, path, frames, error.

    Mode "scene" takes the frame in the middle of each scene, or one a second where there are no cuts; every other mode
    takes `fps` frames a second, and so does a video without a timeline. A video that can't be read is a row with an error
    and fails no other.
    """
    folder, fps, quality = local(raw), 1.0 if settings.mode == "scene" else settings.fps, settings.jpeg_quality
    if settings.mode == "scene":
        paths = [r.path for r in videos.select("path").toLocalIterator()]
        chosen = sampling.sample(timeline(spark, paths), "scene", threshold=settings.scene_threshold, find=detector.cuts)
        times = chosen.groupBy(F.col("key").alias("path")).agg(F.array_sort(F.collect_list("t")).alias("times"))
        videos = videos.join(times, "path", "left")
    else:
        videos = videos.withColumn("times", F.lit(None).cast("array<long>"))

    def one(video: str, path: str, times) -> int:
        from pathlib import Path

        _needs_tools()
        file, out = local(path), Path(folder, video)
        _probe(file)
        out.mkdir(parents=True, exist_ok=True)
        start = ["ffmpeg", "-v", "error", "-y"]
        if times is None:
            numbered = str(out).replace("%", "%%") + "/frame_%05d.jpg"
            runs = [[*start, "-i", file, "-vf", f"fps={fps}", "-q:v", str(quality), numbered]]
        else:
            runs = [[*start, "-ss", f"{t / 1e6:.6f}", "-i", file, "-frames:v", "1", "-update", "1", "-q:v", str(quality), str(out / f"frame_{i:05d}.jpg")] for i, t in enumerate(times)]
        failed = [r for r in runs if subprocess.run(r, capture_output=True, check=False).returncode]
        if failed and len(failed) == len(runs):
            raise RuntimeError(f"ffmpeg could not read {path}")
        return sum(1 for _ in out.glob("frame_*.jpg"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for video, path, times in zip(batch["video"], batch["path"], batch["times"], strict=True):
                try:
                    row = (video, path, one(video, path, times), None)
                except Exception as error:  # noqa: BLE001  one video's error is its row's
                    row = (video, path, 0, str(error)[:500])
                yield pd.DataFrame([row], columns=["video", "path", "frames", "error"])

    n = max(1, videos.count())
    return videos.select("video", local_path(F.col("path")).alias("path"), "times").repartition(n, "path").mapInPandas(run, EXTRACTED)
