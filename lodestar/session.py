"""Sessions: settings that a job on any cluster wants, and a small local session for tests and the benchmark."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Safe on one machine and on a thousand: nothing here depends on the size of the data.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, memory: str = "6g", warehouse: str | None = None, checkpoints: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lodestar").config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", str(cores))
    for k, v in {**SETTINGS, **more}.items():
        builder = builder.config(k, v)
    if warehouse:
        builder = builder.config("spark.sql.warehouse.dir", warehouse)
    if checkpoints:
        builder = builder.config("spark.checkpoint.dir", checkpoints)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
