"""A session with the settings that queries rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: int | None = None, memory: str = "8g") -> SparkSession:
    n = cores or os.cpu_count() or 4
    spark = (
        SparkSession.builder.master(f"local[{n}]").appName("packgraph").config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n)).config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
