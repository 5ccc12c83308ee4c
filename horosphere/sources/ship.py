"""The package itself, for Python workers that would not find it."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per application, unless their search path has it already."""
    home = Path(__file__).resolve().parents[2]
    known = {Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p}
    sc = spark.sparkContext
    if home in known or sc.applicationId in _sent:
        return
    _sent.add(sc.applicationId)
    folder = tempfile.mkdtemp(prefix="horosphere-")
    shutil.copytree(home / "horosphere", f"{folder}/own/horosphere", ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{folder}/horosphere", "zip", f"{folder}/own"))
