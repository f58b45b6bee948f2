"""Makes this package importable in Python workers that were not started beside it."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers once per application, unless PYTHONPATH already leads them to it."""
    context = spark.sparkContext
    if context.applicationId in _sent or ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = os.path.join(tempfile.mkdtemp(), "augurline.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(os.path.join(ROOT, "augurline")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, ROOT))
    context.addPyFile(archive)
    _sent.add(context.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return call
