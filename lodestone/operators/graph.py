"""Graphs as nodes(id, ...) and edges(src, dst): paths, reachability, order, taint. Each step is a join whose result is
written, so plans stay short and a lost executor loses one step at most."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def simple_paths(edges: DataFrame, starts: DataFrame, targets: DataFrame, max_nodes: int) -> DataFrame:
    """path: every simple path of at most max_nodes nodes from a start(id) to its first target(id). A start that is a target isn't extended."""
    edges = edges.select("src", "dst").distinct()
    goals = targets.select(F.col("id").alias("last")).distinct().withColumn("goal", F.lit(True))
    open_ = starts.select(F.array("id").alias("path"), F.col("id").alias("last"))
    found = None
    for n in range(2, max_nodes + 1):
        longer = open_.join(edges, F.col("last") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        longer = longer.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("last")).join(goals, "last", "left")
        step = stored(longer)
        hits = step.where("goal").select("path")
        found = hits if found is None else found.unionByName(hits)
        open_ = step.where("goal is null").drop("goal")
        if n < max_nodes and open_.isEmpty():
            break
    return found


def reach(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """id, depth: every node within max_depth edges of a start, by its least depth."""
    edges = edges.select("src", "dst").distinct()
    seen = front = stored(starts.select("id", F.lit(0).alias("depth")).distinct())
    for d in range(1, max_depth + 1):
        new = front.join(edges.hint("merge"), F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen.select("id").hint("merge"), "id", "left_anti")
        front = stored(new.withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def traces(edges: DataFrame, ends: DataFrame, entries: DataFrame, max_nodes: int) -> DataFrame:
    """path: simple paths backward from each end(id) until an entry(id) or a node without callers, written entry first."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    roots = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    stops = entries.select("id").unionByName(roots).distinct()
    return simple_paths(back, ends, stops, max_nodes).select(F.reverse("path").alias("path"))


def levels(edges: DataFrame, nodes: DataFrame, most: int = 100) -> DataFrame:
    """id, level: the longest way from a node without predecessors, by peeling; nodes on or behind cycles have none."""
    left = stored(edges.select("src", "dst").distinct())
    rest = stored(nodes.select("id").distinct())
    done = None
    for level in range(most):
        free = stored(rest.join(left.select(F.col("dst").alias("id")).distinct(), "id", "left_anti").withColumn("level", F.lit(level)))
        if free.isEmpty():
            break
        done = free if done is None else done.unionByName(free)
        rest = stored(rest.join(free.select("id"), "id", "left_anti"))
        left = stored(left.join(free.select(F.col("id").alias("src")), "src", "left_anti"))
    return done.unionByName(rest.withColumn("level", F.lit(None).cast("int"))) if done is not None else rest.withColumn("level", F.lit(None).cast("int"))


def resolve_calls(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """calls(caller, file_path, language, name) with target: a node(id, name, file_path, language) of that name and language, of the same
    file before others, then by id. A name that no node has is external; one of other languages only gives no edge. Nodes are reduced to the
    least of each name and place before they meet the calls, so a frequent name brings one row to each."""
    asked = calls.select("caller", "file_path", "language", "name").distinct()
    near = nodes.groupBy("name", "language", "file_path").agg(F.min("id").alias("near"))
    far = nodes.groupBy("name", "language").agg(F.min("id").alias("far"))
    known = nodes.where("name is not null").select("name", F.lit(True).alias("known")).distinct()
    found = asked.join(near, ["name", "language", "file_path"], "left").join(far, ["name", "language"], "left").join(known, "name", "left")
    found = found.withColumn("target", F.coalesce("near", "far")).where(F.col("target").isNotNull() | F.col("known").isNull())
    # One target for a caller and name, whatever files and languages it is listed under.
    best = F.struct(F.col("target").isNull().alias("none"), F.col("near").isNull().alias("elsewhere"), "target")
    first = found.groupBy("caller", "name").agg(F.min(best).alias("best"))
    return first.select("caller", "name", F.coalesce("best.target", F.concat(F.lit("external:"), "name")).alias("target"))


def _kept(calls: DataFrame, stop: Sequence[str]) -> DataFrame:
    return calls.where(~F.col("name").isin(*stop) & (F.char_length("name") > 1) & (F.col("name") != F.col("caller")))


def callers_of(calls: DataFrame, stop: Sequence[str] = ()) -> DataFrame:
    """The inverted index of calls(caller, file_path, name): distinct callers of each name, without stop words and calls of oneself."""
    return _kept(calls, stop).groupBy("name").agg(F.count_distinct("caller", "file_path").alias("callers"), F.count_distinct("file_path").alias("files"))


#: Nodes of a file that go along with each of its units; names that are broadcast at most.
FEW, NAMES = 50, 200_000


def resolve_units(units: DataFrame, nodes: DataFrame, few: int = FEW, names: int = NAMES) -> DataFrame:
    """resolve_calls of units(caller, file_path, language, names), each name once in a unit. A unit takes its file's nodes along as a map, and a name
    meets one row with its nodes by language, so no call is grouped, and calls are shuffled once at most: only if nodes have over names names. Callers
    listed more than once, or of a file with over few nodes, go by resolve_calls."""
    nodes = stored(nodes.where("name is not null").select("id", "name", "file_path", "language"))
    in_file = nodes.groupBy("file_path", "language", "name").agg(F.min("id").alias("near"))
    crowded = stored(in_file.groupBy("file_path", "language").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > few).drop("n"))
    again = units.groupBy("caller").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or caller is null").select("caller")
    apart = stored(again.unionByName(units.join(crowded, ["file_path", "language"], "left_semi").select("caller")).distinct().withColumnRenamed("caller", "other"))
    rest, same = None, F.col("caller").eqNullSafe(F.col("other"))
    if not apart.isEmpty():
        rest = resolve_calls(units.join(apart, same, "left_semi").select("caller", "file_path", "language", F.explode("names").alias("name")), nodes)
        units = units.join(apart, same, "left_anti")
        in_file = in_file.join(crowded, ["file_path", "language"], "left_anti")
    own = in_file.where("near is not null").groupBy("file_path", "language").agg(F.map_from_entries(F.collect_list(F.struct("name", "near"))).alias("own"))
    far = nodes.groupBy("name", "language").agg(F.min("id").alias("far"))
    entry = F.when(F.col("language").isNotNull() & F.col("far").isNotNull(), F.struct("language", "far"))
    known = stored(far.groupBy("name").agg(F.map_from_entries(F.collect_list(entry)).alias("far")))
    known = F.broadcast(known) if known.count() <= names else known.hint("shuffle_hash")
    asked = units.join(own, ["file_path", "language"], "left").select("caller", "language", "own", F.explode("names").alias("name"))
    asked = asked.select("caller", "language", "name", F.try_element_at("own", F.col("name")).alias("near"))
    found = asked.join(known, "name", "left").withColumn("target", F.coalesce("near", F.try_element_at("far", F.col("language"))))
    found = found.where(F.col("target").isNotNull() | F.col("far").isNull()).select("caller", "name", F.coalesce("target", F.concat(F.lit("external:"), "name")).alias("target"))
    return found if rest is None else found.unionByName(rest)


def callers_of_units(units: DataFrame, stop: Sequence[str] = ()) -> DataFrame:
    """callers_of for units(caller, file_path, names), each name once in a unit. A file with one unit has one caller of a name, so its calls are counted
    where they are; those of files with more units go by callers_of."""
    calls = lambda of: of.select("caller", "file_path", F.explode("names").alias("name"))
    shared = stored(units.where("file_path is not null").groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    none = shared.isEmpty()
    alone = _kept(calls(units if none else units.join(shared, "file_path", "left_anti")), stop).groupBy("name").agg(F.count("file_path").alias("callers"))
    alone = alone.withColumn("files", F.col("callers"))
    if none:
        return alone
    both = alone.unionByName(callers_of(calls(units.join(shared, "file_path", "left_semi")), stop))
    return both.groupBy("name").agg(F.sum("callers").alias("callers"), F.sum("files").alias("files"))


def taint_paths(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """path with its interior sanitizers, the sink's risk (one level lower if there are any) and a confidence."""
    ends = nodes.select(F.col("id").alias("end"), "risk_rank")
    numbered = paths.withColumn("path_id", F.md5(F.array_join("path", ">").cast("binary"))).withColumn("end", F.element_at("path", -1))
    inner = numbered.select("path_id", F.explode(F.expr("slice(path, 2, greatest(size(path) - 2, 0))")).alias("id"))
    cleaned = inner.join(nodes.where("node_type = 'sanitizer'").select("id"), "id").groupBy("path_id").agg(F.count(F.lit(1)).alias("sanitizers"))
    rows = numbered.join(ends, "end").join(cleaned, "path_id", "left").withColumn("sanitizers", F.coalesce("sanitizers", F.lit(0)))
    risk = F.when(F.col("sanitizers") > 0, F.greatest(F.col("risk_rank") - 1, F.lit(1))).otherwise(F.col("risk_rank"))
    confidence = F.when(F.col("sanitizers") > 0, 0.4).otherwise(0.8) * F.when(F.size("path") > 5, 0.8).otherwise(1.0)
    return rows.select("path_id", "path", "sanitizers", risk.alias("risk_rank"), F.round(confidence, 6).alias("confidence"))


def chain_risk(length: Column) -> Column:
    return F.when(length <= 2, 0.9).when(length <= 4, 0.7).when(length >= 8, 0.3).otherwise(0.5)


def propagate(flows: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """Semi-naive fixpoint of taint: param, origin, depth. seeds(param); flows(src, dst) say which parameter a tainted one passes on to.
    The first taint of a parameter stays: least depth, then the smallest origin."""
    known = front = stored(seeds.select("param", F.col("param").alias("origin"), F.lit(0).alias("depth")).distinct())
    for d in range(1, max_depth + 1):
        new = front.join(flows, F.col("param") == F.col("src")).groupBy(F.col("dst").alias("param")).agg(F.min("origin").alias("origin"))
        front = stored(new.join(known.select("param"), "param", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        known = known.unionByName(front)
    return known
