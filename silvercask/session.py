"""Session factory and the settings every job of this package expects."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "silvercask", cpus: int | None = None, shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster job passes its own session instead."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
