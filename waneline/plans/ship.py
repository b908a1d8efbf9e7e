"""Makes the package importable in Python workers that do not share the driver's path."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parents[1]
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, unless PYTHONPATH already leads to it."""
    app = spark.sparkContext.applicationId
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if app in _sent or str(_ROOT.parent) in on_path:
        return
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), f"{_ROOT.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(_ROOT.rglob("*.py")):
            z.write(f, f.relative_to(_ROOT.parent))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The same query, with the package sent ahead of it."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
