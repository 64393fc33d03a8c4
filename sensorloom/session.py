"""Session defaults for local runs; a cluster brings its own session."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, shuffle_partitions: int = 8, app: str = "sensorloom") -> SparkSession:
    """A local session in UTC with adaptive execution on."""
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join([root, os.environ.get("PYTHONPATH", "")]).rstrip(os.pathsep)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
