"""Incremental state: change sets, plans, dedup, upserts, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path and status of each file of either snapshot(path, hash): new, deleted, modified or unchanged."""
    o, n = old.select("path", F.col("hash").alias("old_hash")), new.select("path", F.col("hash").alias("new_hash"))
    status = F.when(F.col("old_hash").isNull(), "new").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified").otherwise("unchanged")
    return o.join(n, "path", "full_outer").withColumn("status", status)


def plan(changed: DataFrame, units: DataFrame) -> DataFrame:
    """What becomes of each unit(path, unit_id) of the old index, and of each new path."""
    action = F.when(F.col("status") == "new", "add").when(F.col("status") == "modified", "update").when(F.col("status") == "deleted", "delete").otherwise("keep")
    return changed.withColumn("action", action).join(units, "path", "left").groupBy("path", "action").agg(F.count("unit_id").alias("units"))


def content_key(code: str) -> Column:
    return F.substring(F.sha2(F.regexp_replace(F.btrim(F.col(code), F.lit(" \t\n\r")), "[ \t\n\r\f\x0b]+", " ").cast("binary"), 256), 1, 16)


def dedup_content(units: DataFrame) -> DataFrame:
    """One row for each content: the first unit as canonical, the number of units and of files."""
    return units.withColumn("key", content_key("code")).groupBy("key").agg(F.min("unit_id").alias("canonical"), F.count(F.lit(1)).alias("n_units"), F.count_distinct("file_path").alias("n_files"))


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key in the given order: an upsert's result."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("place = 1").drop("place")


def upsert(table: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    return table.join(batch, key, "left_anti").unionByName(batch)


def cache_lookup(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """texts(id, text) with hit: whether the cache(content_hash) has the text."""
    hashed = texts.withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256))
    known = cache.select("content_hash").distinct().withColumn("known", F.lit(True))
    return hashed.join(known, "content_hash", "left").withColumn("hit", F.coalesce("known", F.lit(False))).drop("known")


def evict(entries: DataFrame, capacity: int, n: int) -> DataFrame:
    """Beyond capacity, without the least recently used: the excess, or a tenth of the capacity if that is more. n: the number of entries."""
    drop = max(n - capacity, capacity // 10) if n > capacity else 0
    gone = entries.orderBy("accessed_at", "id").limit(drop).select("id")
    return entries.join(gone, "id", "left_anti")


def shard(language: str, path: str) -> tuple[Column, Column]:
    top = F.when(F.contains(path, F.lit("/")), F.substring_index(F.col(path), "/", 1))
    return F.concat(F.lit("lang_"), F.coalesce(F.col(language), F.lit("unknown"))), F.coalesce(F.concat(F.lit("dir_"), top), F.lit("dir_root"))


def unit_hash(path: str) -> Column:
    return C.short_id(path)
