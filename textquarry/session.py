"""Where Python workers find this package when it was not shipped with the job."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def visible(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """f with the package's folder on the workers' path; on machines without that folder nothing changes."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        environment = spark.sparkContext.environment
        paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
        if ROOT not in paths:
            environment["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
        return f(spark, sf_dir)

    return run
