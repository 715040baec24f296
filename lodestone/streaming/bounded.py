"""Streams whose state and rewrites stay bounded: windows that the watermark closes, and merges that rewrite only the buckets a batch touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def closed_windows(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and totals of each kind by window, each once: when the watermark (the latest event time less late) has passed its end. Then its state
    goes. Rows that come after their window has closed are left out."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("started"), "event_type", "n", F.round("total", 4).alias("total"))


def append_to(stream: DataFrame, base: str) -> StreamingQuery:
    """Appends what is available to the table at base, and returns the query when it is done. A run that begins again goes on where the last one ended."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class LatestTable:
    """The last row of each key, in buckets by the key's hash. Each commit is a small table of the version of every bucket; a batch writes new versions
    of the buckets it touches, then the commit, so a batch that dies leaves the table as it was, and one that comes again does nothing."""

    def __init__(self, spark: SparkSession, base: str, key: str, order: str, buckets: int = 64):
        self.spark, self.base, self.key, self.order, self.buckets = spark, base.rstrip("/"), key, order, buckets

    def _names(self, folder: str) -> list[int]:
        """The numbers of whole tables in a folder."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{folder}")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        make = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return sorted(int(s.getPath().getName()) for s in files.listStatus(path) if files.exists(make(f"{s.getPath()}/_SUCCESS")))

    def versions(self) -> dict[int, int]:
        """The batch that wrote each bucket last, as the last commit has it: found in the folder, so also after a restart."""
        commits = self._names("commits")
        return {r["bucket"]: r["version"] for r in self.spark.read.schema("bucket int, version long").parquet(f"{self.base}/commits/{commits[-1]}").collect()} if commits else {}

    def _paths(self, versions: dict[int, int]) -> list[str]:
        return [f"{self.base}/rows/{v}/bucket={b}" for b, v in sorted(versions.items())]

    def merge(self, batch: DataFrame, number: int) -> list[int]:
        """Merges a batch and returns the buckets it touched."""
        if number in self._names("commits"):
            return []
        before = self.versions()
        batch = batch.where(F.col(self.key).isNotNull()).withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")).persist()
        touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]  # no more than buckets
        there = {b: v for b, v in before.items() if b in touched}
        rows = batch
        if there:
            old = self.spark.read.schema(batch.drop("bucket").schema).parquet(*self._paths(there))
            rows = batch.unionByName(old.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")))
        # The last row as a maximum: keys with many rows are added up before they are dealt out.
        others = [c for c in batch.columns if c not in (self.key, "bucket")]
        last = rows.groupBy("bucket", self.key).agg(F.max_by(F.struct(*others), self.order).alias("r")).select("bucket", self.key, "r.*")
        last.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.base}/rows/{number}")
        now = before | dict.fromkeys(touched, number)
        self.spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.base}/commits/{number}")
        batch.unpersist()
        return sorted(touched)

    def follow(self, stream: DataFrame) -> StreamingQuery:
        """Merges what is available of a stream, batch by batch."""
        writer = stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", f"{self.base}/state")
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
        return query

    def read(self, schema) -> DataFrame:
        versions = self.versions()
        return self.spark.read.schema(schema).parquet(*self._paths(versions)) if versions else self.spark.createDataFrame([], schema)

    def vacuum(self) -> int:
        """Deletes buckets that no commit but older ones than the last lists; the number of those."""
        versions, gone = self.versions(), 0
        make = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for v in self._names("rows"):
            folder = make(f"{self.base}/rows/{v}")
            files = folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for s in files.listStatus(folder):
                name = s.getPath().getName()
                if name.startswith("bucket=") and versions.get(int(name[7:])) != v:
                    gone += bool(files.delete(s.getPath(), True))
        return gone
