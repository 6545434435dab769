"""Makes the package importable in Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's files, once, unless workers find it on PYTHONPATH or in the working folder.

    On a cluster whose workers have neither, spark-submit --py-files does the same.
    """
    found = [Path(p).resolve() for p in [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]]
    context = spark.sparkContext
    if ROOT.parent in found or getattr(context, "cinesieve_shipped", False):
        return
    path = f"{tempfile.mkdtemp()}/{ROOT.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(ROOT.rglob("*.py")):
            out.write(file, file.relative_to(ROOT.parent))
    context.addPyFile(path)
    context.cinesieve_shipped = True
