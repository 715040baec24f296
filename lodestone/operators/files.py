"""Operators on files: which to take, and which part to read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def ignore_cascade(files: DataFrame, gates: Sequence[tuple[str, Column]], max_kb: float, suffixes: Sequence[str]) -> DataFrame:
    """files with accepted and reason: the first gate that turns a file away, then its size, then its suffix."""
    suffix_ok = F.lit(False)
    for s in suffixes:
        suffix_ok = suffix_ok | F.endswith("path", F.lit(s))
    reason = F.when(gates[0][1], gates[0][0]) if gates else F.when(F.lit(False), "")
    for name, gate in gates[1:]:
        reason = reason.when(gate, name)
    reason = reason.when(F.col("size") / 1024 > max_kb, "size").when(~suffix_ok, "extension").otherwise("")
    return files.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "")


def filter_stats(filtered: DataFrame, gates: Sequence[str]) -> DataFrame:
    return filtered.agg(F.count(F.lit(1)).alias("total"), F.count_if("accepted").alias("accepted"), *(F.count_if(F.col("reason") == g).alias(f"by_{g}") for g in gates))


def gitignored(path: str, patterns: Sequence[str]) -> Column:
    """Folder patterns (with a slash at the end), whole-path patterns (with **), and patterns of any one segment."""
    found = F.lit(False)
    for p in patterns:
        if p.endswith("/"):
            found = found | F.contains(F.concat(F.lit("/"), path, F.lit("/")), F.lit(f"/{p}"))
        elif "**" in p:
            found = found | C.matches_glob(path, p)
        else:
            found = found | _any_segment(path, p) | C.matches_glob(path, p)
    return found


def _any_segment(path: str, pattern: str) -> Column:
    return F.exists(F.split(path, "/"), lambda s: s.rlike(C.glob_regex(pattern)))


def skip_generated(files: DataFrame, max_chars: int = 1 << 20, markers: Sequence[str] = ("generated",), head: int = 10) -> DataFrame:
    top = F.lower(F.array_join(F.slice(C.lines("content"), 1, head), "\n"))
    marked = F.lit(False)
    for m in markers:
        marked = marked | F.contains(top, F.lit(m))
    rows = files.withColumn("too_long", F.char_length("content") > max_chars).withColumn("marked", marked)
    return rows.withColumn("skipped", F.col("too_long") | F.col("marked"))


def read_slice(files: DataFrame, start: int, end: int, context: int = 0) -> DataFrame:
    """Lines start to end, from 1, both included, with context lines around."""
    first, last = max(1, start - context), end + context
    lines = C.lines("content")
    return files.withColumn("slice", F.array_join(F.slice(lines, first, last - first + 1), "\n")).withColumn("end_line", F.least(F.size(lines), F.lit(last)).cast("long")).drop("content")


def list_files(files: DataFrame, pattern: str, most: int = 50) -> DataFrame:
    return files.where(C.matches_glob("path", pattern)).orderBy("path", "file_id").limit(most)
