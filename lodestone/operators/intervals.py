"""Line ranges of files: runs that overlap, and the merge of search results that depends on their order.

Ranges are dealt by file and stretch of lines, never by file alone. What a stretch needs of those before it (how far they reach, where the
last run began) is one row for each stretch, so a file of any number of ranges is worked on in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a stretch.
STRETCH = 1000


def overlap_runs(ranges: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """ranges(file_path, start_line, end_line, ...) with run: the line at which a run of ranges that overlap, directly or by way of others, begins.
    Ranges that share a line overlap. Ranges without a file or a line aren't in a run (null)."""
    given = F.col("file_path").isNotNull() & F.col("start_line").isNotNull() & F.col("end_line").isNotNull()
    rows = ranges.withColumn("_at", F.floor(F.col("start_line") / F.lit(stretch)))
    by = Window.partitionBy("file_path").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    far = rows.where(given).groupBy("file_path", "_at").agg(F.max("end_line").alias("_far")).withColumn("_before", F.max("_far").over(by)).drop("_far")
    # Ranges of equal lines begin or go on together, so the windows are over distinct ranges.
    distinct = rows.where(given).groupBy("file_path", "_at", "start_line").agg(F.max("end_line").alias("_end")).join(far, ["file_path", "_at"])
    within = Window.partitionBy("file_path", "_at").orderBy("start_line")
    reached = F.greatest("_before", F.max("_end").over(within.rowsBetween(Window.unboundedPreceding, -1)))
    begun = distinct.withColumn("_begins", F.when(reached.isNull() | (F.col("start_line") > reached), F.col("start_line")))
    begun = begun.withColumn("_run", F.last("_begins", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    last = begun.groupBy("file_path", "_at").agg(F.max("_begins").alias("_last")).withColumn("_earlier", F.last("_last", ignorenulls=True).over(by)).drop("_last")
    run = begun.join(last, ["file_path", "_at"]).select("file_path", "start_line", F.coalesce("_run", "_earlier").alias("run"))
    return rows.drop("_at").join(run, ["file_path", "start_line"], "left").select(*ranges.columns, "run")


def overlapping_pairs(ranges: DataFrame, key: str, stretch: int = STRETCH) -> DataFrame:
    """a, b: keys (a < b) of ranges of one file that share a line. A range stands in each stretch that it touches, and a pair meets in the
    first stretch that both touch, so once."""
    rows = ranges.select("file_path", "start_line", "end_line", F.col(key).alias("k")).where("start_line <= end_line")
    at = lambda c: F.floor(F.col(c) / F.lit(stretch))
    dealt = rows.withColumn("at", F.explode(F.sequence(at("start_line"), at("end_line"))))
    a, b = (dealt.select("file_path", "at", *(F.col(c).alias(f"{s}_{c}") for c in ("start_line", "end_line", "k"))) for s in "ab")
    meet = (F.col("a_k") < F.col("b_k")) & (F.col("a_start_line") <= F.col("b_end_line")) & (F.col("b_start_line") <= F.col("a_end_line"))
    first = F.col("at") == F.floor(F.greatest("a_start_line", "b_start_line") / F.lit(stretch))
    return a.join(b, ["file_path", "at"]).where(meet & first).select(F.col("a_k").alias("a"), F.col("b_k").alias("b"))


RESULT = "file_path string, start_line int, end_line int, score double, source string"


def merged_results(rows: list[tuple]) -> list[tuple]:
    """Results (start, end, score, source) of a run in order, merged: one with lines that are there adds half of its score, a fifth more in all if
    its sources are others; one that overlaps takes the place of the first that it overlaps if it scores higher, else goes; others stay."""
    kept: dict[tuple[int, int], tuple] = {}  # under the lines of the first that stood there
    for start, end, score, source in rows:
        if (start, end) in kept:
            s, e, old, sources = kept[start, end]
            total = (old + score * 0.5) * (1.2 if source != sources else 1.0)
            kept[start, end] = (s, e, total, sources if source in sources else f"{sources}+{source}")
            continue
        place = next((k for k, (s, e, _, _) in kept.items() if s <= end and start <= e), None)
        if place is None:
            kept[start, end] = (start, end, score, source)
        elif score > kept[place][2]:
            kept[place] = (start, end, score, source)
    return list(kept.values())


def hybrid_merge(results: DataFrame, seq: str = "seq", stretch: int = STRETCH) -> DataFrame:
    """file_path, start_line, end_line, score, source of results(file_path, start_line, end_line, score, source, seq), merged in the order of seq. Only
    results of one run of overlapping ranges bear on one another, so a run is what a task needs at once: as many results as overlap."""
    rows = overlap_runs(results, stretch).where("run is not null")
    result = F.struct(F.col(seq).alias("seq"), F.col("start_line").cast("int").alias("start_line"), F.col("end_line").cast("int").alias("end_line"), F.col("score").cast("double").alias("score"), "source")
    runs = rows.groupBy("file_path", "run").agg(F.array_sort(F.collect_list(result)).alias("run_results"))
    alone = runs.where(F.size("run_results") == 1).select("file_path", F.col("run_results")[0].alias("r")).select("file_path", "r.start_line", "r.end_line", "r.score", "r.source")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RESULT.split(", ")]
        for rows in batches:
            out = [(path, *r) for path, of in zip(rows["file_path"], rows["run_results"], strict=True) for r in merged_results([(x["start_line"], x["end_line"], x["score"], x["source"]) for x in of])]
            yield pd.DataFrame(out, columns=columns)

    return alone.unionByName(runs.where(F.size("run_results") > 1).select("file_path", "run_results").mapInPandas(merge, RESULT))
