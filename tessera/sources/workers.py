"""Python workers of the session find this library where the driver found it."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def share_path(spark: SparkSession) -> None:
    """Add the library's folder to the Python path of workers. On a cluster whose nodes lack that folder, ship the package
    (--py-files) instead; the extra entry does no harm then."""
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *known])
