"""Structured Streaming: windowed counts with a watermark, and keep-latest merges by batch."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder


def event_stream(spark: SparkSession, folder: str, glob: str = "events.parquet") -> DataFrame:
    """The event files of a folder as a stream; event times are in UTC."""
    schema = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).parquet(folder).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", True).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and totals of each kind by window; rows later than the watermark are left out of closed windows."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("started"), "event_type", "n", F.round("total", 4).alias("total"))


def drain(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """All that is available, written batch by batch in the shared folder: the rows of the last batch (complete) or of all."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/s-{uuid.uuid4().hex}"

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def keep_latest(stream: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, merged into a table by batch: each batch writes a new version, so a failed one leaves the old."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/s-{uuid.uuid4().hex}"
    versions: list[str] = []

    def merge(batch: DataFrame, n: int) -> None:
        rows = batch if not versions else spark.read.parquet(versions[-1]).unionByName(batch)
        last = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("place = 1").drop("place")
        last.write.mode("overwrite").parquet(f"{base}/v{n}")
        versions.append(f"{base}/v{n}")

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(versions[-1]) if versions else spark.createDataFrame([], stream.schema)
