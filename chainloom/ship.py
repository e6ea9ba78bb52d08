"""Make this package importable in Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Send the package with Spark's own file server, unless workers find it on PYTHONPATH anyway."""
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(spark.sparkContext, "_chainloom_sent", False):
        return
    base = Path(tempfile.mkdtemp(prefix="spark-")) / "chainloom"
    spark.sparkContext.addPyFile(shutil.make_archive(str(base), "zip", ROOT, "chainloom"))
    spark.sparkContext._chainloom_sent = True
