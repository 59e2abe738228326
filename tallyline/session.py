"""Session settings that every query of this library relies on."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def spark_session(app: str = "tallyline", cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with UTC time zone and adaptive execution; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TALLYLINE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder (any file system Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
