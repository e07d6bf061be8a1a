"""Session builder used by tests and the benchmark; on a cluster spark-submit's settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "glyphmill", cores: int | str = "*", **extra: str) -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | extra
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
