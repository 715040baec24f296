"""A context for each query: its hits, and units that they call, none twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def context_pack(hits: DataFrame, units: DataFrame, calls: DataFrame, max_callees: int = 5, per_name: int = 2, chars: int = 500, code_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """query_id, part ("primary" or "related"), place, unit_id, relation, code. hits(query_id, unit_id, rank); units(unit_id, language, symbol, code);
    calls(unit_id, callee, place): names that a unit calls, in order; those of units that are no hit may be left out. Each hit brings the first
    max_callees names, each name the first per_name units of its language. A unit that was there before, as an earlier hit or a callee, isn't related
    again; a hit stays a hit. Related code is cut to chars characters. code_of makes (unit_id, code) of the units(unit_id) that the contexts hold,
    where units has no code. Hits are read several times: they should be a table."""
    u = units.select("unit_id", "language", "symbol")
    asked_units = hits.select("unit_id").distinct()
    primary = hits.join(u.join(asked_units, "unit_id", "left_semi"), "unit_id")
    first = calls.join(asked_units, "unit_id", "left_semi").groupBy("unit_id", "callee").agg(F.min("place").alias("place"))
    first = first.withColumn("nth", F.row_number().over(Window.partitionBy("unit_id").orderBy("place", "callee"))).where(F.col("nth") <= max_callees)
    asked = stored(primary.select("query_id", "rank", "unit_id", "language", F.col("symbol").alias("caller")).join(first, "unit_id").select("query_id", "rank", "caller", "nth", "language", "callee"))
    # Of each name that a hit calls the first units, before it meets the hits: a frequent name brings per_name rows.
    called = u.join(asked.select("language", F.col("callee").alias("symbol")).distinct(), ["language", "symbol"], "left_semi")
    named = called.withColumn("k", F.row_number().over(Window.partitionBy("language", "symbol").orderBy("unit_id"))).where(F.col("k") <= per_name)
    met = asked.join(named.select("language", F.col("symbol").alias("callee"), F.col("unit_id").alias("related_id"), "k"), ["language", "callee"])
    at = F.struct("rank", "nth", "k", "caller")
    once = met.groupBy("query_id", "related_id").agg(F.min(at).alias("at"))
    earlier = hits.select("query_id", F.col("unit_id").alias("related_id"), F.col("rank").alias("hit_rank"))
    new = once.join(earlier, ["query_id", "related_id"], "left").where(F.col("hit_rank").isNull() | (F.col("hit_rank") > F.col("at.rank")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("at"))
    related = new.select("query_id", F.lit("related").alias("part"), place.alias("place"), F.col("related_id").alias("unit_id"), F.concat(F.lit("called by "), "at.caller").alias("relation"))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    packed = stored(primary.select("query_id", F.lit("primary").alias("part"), order.alias("place"), "unit_id", F.lit(None).cast("string").alias("relation")).unionByName(related))
    # Code comes last, for what is in a context alone.
    held = packed.select("unit_id").distinct()
    code = code_of(held) if code_of else units.select("unit_id", "code").join(held, "unit_id", "left_semi")
    shown = F.when(F.col("part") == "related", F.expr(f"left(code, {chars})")).otherwise(F.col("code"))
    return packed.join(code, "unit_id").select("query_id", "part", "place", "unit_id", "relation", shown.alias("code"))
