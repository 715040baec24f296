"""The Spark session of scripts and tests; on a cluster the caller brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cpus: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("lodestone")
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions or cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
