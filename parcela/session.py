"""Session builder with the settings the plans of this package assume."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(cores: int | str = "*", app: str = "parcela", **extra: str) -> SparkSession:
    """A local session; on a cluster the caller's own session is used instead.

    Small split and shuffle sizes suit local data; AQE coalesces what is too small and
    splits what is skewed, so the same plans run unchanged on large inputs.
    """
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.files.maxPartitionBytes": "4m",
        "spark.sql.files.openCostInBytes": "256k",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("PARCELA_DRIVER_MEMORY", "8g"),
    } | extra
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
