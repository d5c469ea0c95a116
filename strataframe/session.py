"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(app: str = "strataframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC times and Arrow transfer; settings given win, and so does a running session."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return builder.config(map={**base, **conf}).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once an application, so that Python workers there can import it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="strataframe-ship-")
        staged = Path(folder, "src", root.name)
        shutil.copytree(root, staged, ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/{root.name}", "zip", staged.parent))
        shutil.rmtree(staged.parent)
        _shipped.add(app)
    return spark
