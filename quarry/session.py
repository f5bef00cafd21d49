"""A local session with the settings that tests and the benchmark use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "12g") -> SparkSession:
    """``local[cores]`` with adaptive execution, Arrow and UTC; broadcasts stay at the size-checked default."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quarry")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
