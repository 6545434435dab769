"""Frames as images, and listings of videos and outputs. Paths may be in any store that Spark reads."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinesieve.functions.columns import basename, suffix
from cinesieve.sinks.files import entries

#: Endings of video files.
VIDEO_ENDINGS = (".mp4", ".mov", ".avi", ".mkv", ".webm", ".m4v")
IMAGE_ENDINGS = (".jpg", ".jpeg", ".png")


def local_path(path: Column) -> Column:
    """file:///x and file:/x alike."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def decoded(uri: Column) -> Column:
    """A path from a percent-encoded one."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def _listing(spark: SparkSession, path: str) -> DataFrame:
    """Paths and sizes, none for a pattern without matches; the contents are not read, as no one asks for that column."""
    try:
        found = spark.read.format("binaryFile").load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], "path string, length long")
    return found.select(local_path(F.col("path")).alias("path"), "length")


def is_video(name: str) -> bool:
    return name.rfind(".") > 0 and name[name.rfind(".") :].lower() in VIDEO_ENDINGS


def video_keys(names: list[str]) -> list[str]:
    """What each video file of a folder is called in outputs: its stem, or its whole name where another file has that stem."""
    stems = [name.rsplit(".", 1)[0] for name in names]
    n, taken = Counter(stems), set(names)
    return [name if n[own] > 1 or own in taken else own for name, own in zip(names, stems, strict=True)]


def videos(spark: SparkSession, path: str) -> DataFrame:
    """Video files directly in a folder, or the file itself: index (from 1, by name), video (see video_keys), video_name, path."""
    own = [(name, at) for name, at, is_folder in entries(spark, path) if not is_folder and is_video(name)]
    rows = [(i, key, name, at) for i, (key, (name, at)) in enumerate(zip(video_keys([name for name, _ in own]), own, strict=True), 1)]
    return spark.createDataFrame(rows, "index int, video string, video_name string, path string")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Images under <path>/<video>/: video, frame_order, file, origin, image. Unreadable ones stay, with a height of -1.

    The order is the number in the file's name, so that it holds beyond five digits; files without one come by name after.
    """
    images = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path)
    origin = local_path(decoded(F.col("image.origin")))
    number = F.regexp_extract(basename(origin), r"(\d+)\.[^.]*$", 1)
    order = F.when(number != "", number.cast("long")).otherwise(F.lit((1 << 62)))
    return images.select(F.element_at(F.split(origin, "/"), -2).alias("video"), order.alias("frame_order"), basename(origin).alias("file"), origin.alias("origin"), "image")


def read_images(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The images of these paths and no others: origin, image. Names are taken as they are, whatever characters they have."""
    images = spark.read.format("image").option("dropInvalid", False).load([re.sub(r"([\\\[\]{}*?^,])", r"\\\1", p) for p in paths])
    return images.select(local_path(decoded(F.col("image.origin"))).alias("origin"), "image")


def no_frames(spark: SparkSession) -> DataFrame:
    """read_frames of nothing."""
    image = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    return spark.createDataFrame([], f"video string, frame_order long, file string, origin string, image {image}")


def outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Image files in <folder>/<video>/unique_frames/: video, file, path, kind (0 for jpg, 1 for png)."""
    files = _listing(spark, f"{folder.rstrip('/')}/*/unique_frames/*")
    end = F.lower(suffix(F.col("path")))
    kind = F.when(end == ".png", 1).otherwise(0)
    return files.where(end.isin(".jpg", ".png")).select(F.element_at(F.split("path", "/"), -3).alias("video"), basename(F.col("path")).alias("file"), "path", kind.alias("kind"))


def folders_without_frames(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates for cleaning, listed and never deleted: folders (video) that no file belongs to."""
    return folders.join(files.select("video"), "video", "left_anti")
