"""Taint across functions: arguments flow to the parameters at their places.

Units are functions: unit_id, language, symbol, signature, code. Calls and signatures are read by patterns, and everything that relates units is
an equality join: a call's name with a unit's symbol, an argument's place with a parameter's, a tainted name with the names within a sink's
parentheses. Taint spreads over (unit, name) keys, semi-naively.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.scratch import stored
from .graph import propagate

#: A unit and a name in it as one key.
_BETWEEN = "\x1f"


def key(unit: str | Column, name: str | Column) -> Column:
    return F.concat_ws(_BETWEEN, F.col(unit).cast("string") if isinstance(unit, str) else unit, name)


def parameters(units: DataFrame) -> DataFrame:
    """unit_id, place (from 0), name: what the first parentheses of a signature list, without annotations, defaults and stars; self and cls are
    no parameters."""
    inner = F.regexp_extract("signature", r"\(([^)]*)\)", 1)
    names = F.transform(F.split(inner, ","), lambda p: F.ltrim(F.regexp_extract(F.trim(p), r"^([^:\s=]*)", 1), F.lit("*")))
    names = F.filter(names, lambda n: (n != "") & ~n.isin("self", "cls"))
    return units.select("unit_id", F.posexplode(names).alias("place", "name"))


def call_arguments(units: DataFrame) -> DataFrame:
    """unit_id, language, callee, call, place, name: for each call of a unit's code (call: its number), the identifier that each argument begins with.
    Each call counts from 0 on its own. Parentheses within parentheses aren't looked into, and heads of functions are no calls."""
    calls = F.regexp_extract_all("code", F.lit(r"(?<!\bdef )(?<!\w)(\w+)\s*\(([^()]*)\)"), F.lit(0))
    found = units.select("unit_id", "language", F.posexplode(calls).alias("call", "text"))
    parts = found.select("unit_id", "language", "call", F.regexp_extract("text", r"^(\w+)", 1).alias("callee"), F.posexplode(F.split(F.regexp_extract("text", r"\(([^()]*)\)", 1), ",")).alias("place", "argument"))
    return parts.withColumn("name", F.regexp_extract("argument", r"^\s*(\w+)", 1)).where("name <> ''").drop("argument")


def argument_flows(units: DataFrame) -> DataFrame:
    """src, dst: keys of a name in a caller and of the parameter of a callee that it is passed on to. Units of one language and name are all called."""
    named = units.select(F.col("unit_id").alias("to"), "language", F.col("symbol").alias("callee")).join(parameters(units).withColumnsRenamed({"unit_id": "to", "name": "parameter"}), "to")
    passed = call_arguments(units).join(named, ["language", "callee", "place"])
    return passed.select(key("unit_id", "name").alias("src"), key("to", "parameter").alias("dst")).distinct()


def request_parameters(units: DataFrame, names: Sequence[str] = ("request", "req")) -> DataFrame:
    """param: the keys of parameters that a framework fills, by their names."""
    return parameters(units).where(F.lower("name").isin(*names)).select(key("unit_id", "name").alias("param"))


def spread(units: DataFrame, seeds: DataFrame, max_depth: int = 10) -> DataFrame:
    """unit_id, name, origin (a seed's key), depth: tainted names. seeds(param): keys. The first taint of a parameter stays."""
    known = propagate(stored(argument_flows(units)), seeds, max_depth)  # each step reads the flows
    id_type = units.schema["unit_id"].dataType
    return known.select(F.substring_index("param", _BETWEEN, 1).cast(id_type).alias("unit_id"), F.substring_index("param", _BETWEEN, -1).alias("name"), "origin", "depth")


def sink_names(units: DataFrame, sinks: Sequence[tuple[str, str, str]]) -> DataFrame:
    """unit_id, sink, category, risk_level, name: each name within the parentheses of a call of a sink (name, category, risk)."""
    pattern = "|".join(s for s, _, _ in sinks)
    calls = F.regexp_extract_all("code", F.lit(rf"\b(?:{pattern})\s*\([^()]*\)"), F.lit(0))
    found = units.select("unit_id", F.explode(calls).alias("text"))
    what = F.create_map(*[x for s, c, r in sinks for x in (F.lit(s), F.struct(F.lit(c).alias("category"), F.lit(r).alias("risk_level")))])
    sink = F.regexp_extract("text", r"^(\w+)", 1)
    rows = found.select("unit_id", sink.alias("sink"), F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_extract("text", r"\(([^()]*)\)", 1), F.lit(r"\w+"), F.lit(0)))).alias("name"))
    return rows.select("unit_id", "sink", what[F.col("sink")]["category"].alias("category"), what[F.col("sink")]["risk_level"].alias("risk_level"), "name").distinct()


def sanitized_names(units: DataFrame, tainted: DataFrame, pattern: str) -> DataFrame:
    """unit_id, name of tainted names that a line with a sanitizer, or one next to it, holds."""
    lines = C.lines("code")
    window = F.filter(
        F.transform(lines, lambda x, i: F.when(x.rlike(pattern), F.array_join(F.slice(F.col("ls"), F.greatest(i, F.lit(1)), F.when(i > 0, 3).otherwise(2)), "\n"))),
        lambda w: w.isNotNull(),
    )
    around = units.withColumn("ls", lines).select("unit_id", window.alias("w")).where(F.size("w") > 0)
    return tainted.select("unit_id", "name").distinct().join(around, "unit_id").where(F.exists("w", lambda w: F.contains(w, F.col("name")))).select("unit_id", "name")


def cross_function_sinks(units: DataFrame, seeds: DataFrame, sinks: Sequence[tuple[str, str, str]], sanitizer: str, max_depth: int = 10, high_risk: bool = True) -> DataFrame:
    """unit_id, name, origin, depth, sink, category, risk_level, sanitized, confidence: tainted names within the parentheses of a sink of the same
    unit. Confidence: .6, more for sources of high risk, for dangerous sinks and for parameters, less for chains of over three functions, a
    third where sanitized; sanitized flows have low risk."""
    tainted = spread(units, seeds, max_depth)
    hits = tainted.join(sink_names(units, sinks), ["unit_id", "name"])
    clean = sanitized_names(units, hits, sanitizer).withColumn("sanitized", F.lit(True))
    rows = hits.join(clean, ["unit_id", "name"], "left").withColumn("sanitized", F.coalesce("sanitized", F.lit(False)))
    # The weights of the score.
    base = F.lit(0.6 + 0.2 * high_risk) + F.when(F.col("risk_level") == "critical", 0.15).when(F.col("risk_level") == "high", 0.1).otherwise(0.0)
    functions = F.col("depth") + 1
    score = base * F.when(functions > 3, F.pow(F.lit(0.9), functions - 3)).otherwise(1.0) + F.when(F.col("depth") > 0, 0.05).otherwise(0.0)
    score = score * F.when(F.col("sanitized"), 0.3).otherwise(1.0)
    risk = F.when(F.col("sanitized"), "low").otherwise(F.col("risk_level"))
    return rows.select("unit_id", "name", "origin", "depth", "sink", "category", risk.alias("risk_level"), "sanitized", F.round(F.least(F.greatest(score, F.lit(0.1)), F.lit(0.95)), 6).alias("confidence"))
