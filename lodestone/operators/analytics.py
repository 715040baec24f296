"""Findings, messages and logs: rollups, budgets, rates, validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def validate(findings: DataFrame, files: DataFrame) -> DataFrame:
    """findings(id, file_path, line_start, line_end, sink_ok, chain_ok, evidence, confidence) against files(file_path, n_lines):
    confidence less .3 for a missing file, .2 for a bad range, .25 for a missing sink, .15 for a broken chain, .1 for each missing
    piece of evidence; and a status."""
    rows = findings.join(files, "file_path", "left")
    no_file = F.col("n_lines").isNull()
    bad_range = ~no_file & ((F.col("line_start") < 1) | (F.col("line_end") < F.col("line_start")) | (F.col("line_end") > F.col("n_lines")))
    one = lambda c: c.cast("int")
    score = F.round(F.greatest(F.lit(0.0), F.col("confidence") - 0.3 * one(no_file) - 0.2 * one(bad_range) - 0.25 * one(~F.col("sink_ok")) - 0.15 * one(~F.col("chain_ok")) - 0.1 * F.col("missing_evidence")), 6)
    errors = one(no_file) + one(bad_range)
    warnings = one(~F.col("sink_ok")) + one(~F.col("chain_ok")) + F.col("missing_evidence")
    status = F.when(errors > 0, "INVALID").when(warnings >= 2, "NEEDS_REVIEW").when(score < 0.5, "UNCERTAIN").when(score < 0.7, "NEEDS_REVIEW").otherwise("VALID")
    return rows.select("id", score.alias("score"), errors.alias("errors"), warnings.alias("warnings"), status.alias("status"))


def deterministic_findings(sites: DataFrame, chains: DataFrame, scan: str) -> DataFrame:
    """A finding for each site, HIGH for the categories that run or read what they are given, with its number of chains."""
    high = ("purchase", "error")
    counted = chains.groupBy("file_path", "line_start", "symbol").agg(F.count(F.lit(1)).alias("chain_count"))
    rows = sites.join(counted, ["file_path", "line_start", "symbol"], "left")
    finding_id = F.concat(F.lit("f-"), C.short_id(F.lit(scan), "file_path", "line_start", "symbol", digits=12))
    return rows.select(finding_id.alias("id"), "seq", F.when(F.col("category").isin(*high), "HIGH").otherwise("MEDIUM").alias("severity"), F.lit(0.5).alias("confidence"), F.coalesce("chain_count", F.lit(0)).alias("chain_count"))


def last_n(rows: DataFrame, session: str, order: str, n: int) -> DataFrame:
    """The last n rows of each session."""
    return rows.withColumn("from_end", F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))).where(F.col("from_end") <= n).drop("from_end")


def fifo_trim(rows: DataFrame, session: str, order: str, least: int) -> DataFrame:
    """Of each session the last max(least, half)."""
    w = Window.partitionBy(session)
    counted = rows.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("from_end", F.row_number().over(w.orderBy(F.desc(order))))
    return counted.where(F.col("from_end") <= F.greatest(F.lit(least), F.floor(F.col("n") / 2))).drop("n", "from_end")


def budget_cut(blocks: DataFrame, limits: dict[str, float], total: int, least: int = 10) -> DataFrame:
    """blocks(id, priority, tokens) with the tokens they keep: over the total, each priority may be cut to its share of itself."""
    share = F.lit(1.0)
    for priority, x in limits.items():
        share = F.when(F.col("priority") == priority, F.lit(x)).otherwise(share)
    sums = blocks.groupBy("session").agg(F.sum("tokens").alias("all_tokens"))
    rows = blocks.join(sums, "session")
    return rows.withColumn("kept", F.when(F.col("all_tokens") <= total, F.col("tokens")).otherwise(F.greatest(F.least(F.col("tokens"), F.lit(least)), F.floor(F.col("tokens") * share))).cast("long")).drop("all_tokens")


def pack_by_priority(items: DataFrame, session: str, budget: int) -> DataFrame:
    """Greedy packing in order of priority, a fold over the session's own items: an item that doesn't fit is skipped."""
    ordered = items.groupBy(session).agg(F.array_sort(F.collect_list(F.struct("priority", "id", "tokens"))).alias("items"))
    fold = F.aggregate(
        "items",
        F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("kept")),
        lambda acc, x: F.when(acc["used"] + x["tokens"] <= budget, F.struct((acc["used"] + x["tokens"]).alias("used"), F.concat(acc["kept"], F.array(x["id"].cast("long"))).alias("kept"))).otherwise(acc),
    )
    return ordered.select(session, fold.alias("p")).select(session, F.col("p.used").alias("used"), F.explode("p.kept").alias("id"))


def sliding_counts(rows: DataFrame, key: str, seconds: int, amount: str) -> DataFrame:
    """rows with the number and the amount of those of the same key in the seconds before, themselves included."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return rows.withColumn("n_recent", F.count(F.lit(1)).over(w)).withColumn("amount_recent", F.round(F.sum(amount).over(w), 4))


def sessions(rows: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """Sessions of each key: a gap of more than gap_seconds begins a new one."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    new = rows.withColumn("starts", F.when(F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w) <= gap_seconds * 1_000_000, 0).otherwise(1))
    numbered = new.withColumn("session", F.sum("starts").over(w))
    return numbered.groupBy(key, "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


def severity_rollup(rows: DataFrame, scan: str, levels: Sequence[str], level: str) -> DataFrame:
    return rows.groupBy(scan).agg(*(F.count_if(F.col(level) == x).alias(f"n_{x}") for x in levels), F.count(F.lit(1)).alias("total"))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))
