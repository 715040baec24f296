"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the ASCII blanks; bytes.split() splits on exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """A column name for each of names that clashes with none of df's."""
    have = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in have:
            n = f"_{n}"
        have.add(n.lower())
        out.append(n)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as spark.checkpoint.dir names it; a temporary one where it is unset on one machine (tests). On a cluster it must be set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestone-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame, partition_by: Iterable[str] = ()) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: its lineage ends there, and lost executors lose nothing.

    The table lives in the application's own checkpoint folder and goes when that is cleaned.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/t-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Deletes the tables of stored() that df reads, once nothing needs them."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def text_slices(texts, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """start, end of runs of an Arrow array of texts that hold no more than so many bytes together, or one text."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(ends):
        before = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield a, b
        a = b


def give_back() -> None:
    """Returns what a Python worker has freed to the machine. Workers live on between tasks, and what they hold lessens what others have."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to do
        pass


def joined_by_key(rows: DataFrame, per_key: DataFrame, *on: str, share: int = 1000) -> DataFrame:
    """rows joined with per_key(on, n, ...), which has one row for each key and its number n of rows; n goes.

    Keys that hold more than the share-th part of the rows are share at most, so they are broadcast; their rows aren't dealt out
    by key and never meet in a task. The others join by shuffle. rows are read twice: they should be stored."""
    per_key = stored(per_key)
    total = per_key.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(per_key.where(F.col("n") > total // share).drop("n"))
    rest = rows.join(hot.select(*on), list(on), "left_anti").join(per_key.where(F.col("n") <= total // share).drop("n"), list(on))
    return rows.join(hot, list(on)).unionByName(rest)


def unit_hash(*cols: Column | str, seed: int = 0) -> Column:
    """A uniform double in (0, 1) from the values of cols: 52 bits of an MD5, the same in any SQL engine."""
    text = F.concat_ws(":", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("null")) for c in [*(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols), F.lit(str(seed))]])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
