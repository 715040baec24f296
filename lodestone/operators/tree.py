"""Trees as nodes(tree_id, node_id, parent_id, ...): labels of intervals, with which subtrees and ancestors are range joins at any depth.

A tree of TREE nodes at most is walked in one task, so its nodes are shuffled once and no way is. In larger ones ways to the root are doubled at each
step, so depth d takes log2(d) joins. Ordered by these ways, a subtree is an interval: a node's number and the number of the last below it.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import stored


#: Nodes of a tree that one task walks; as one chain their ways have twelve million steps.
TREE = 5_000
#: Rows of a task that walks trees.
TASK_ROWS = 200_000


def _by_size(rows: DataFrame, size: Column, most: int) -> tuple[DataFrame, DataFrame | None, int]:
    """rows of trees of size most at most, those of larger ones, if there are any, and in how many parts to walk. size is an aggregate of a tree's rows."""
    sizes = stored(rows.groupBy("tree_id").agg(size.alias("size")))
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-(sizes.agg(F.sum("size")).first()[0] or 0) // TASK_ROWS))
    large = stored(sizes.where(F.col("size") > most).select("tree_id"))
    if large.isEmpty():
        return rows, None, parts
    return rows.join(large, "tree_id", "left_anti"), rows.join(large, "tree_id", "left_semi"), parts


def _given(nodes: DataFrame) -> DataFrame:
    return nodes.select("tree_id", "node_id", "parent_id").where("tree_id is not null and node_id is not null")


def _walk(tree: pa.Table) -> pa.Table:
    """The labels of a tree, from its root down. What no root leads to is left out."""
    parents: dict = {}
    for node, parent in zip(tree["node_id"].to_pylist(), tree["parent_id"].to_pylist(), strict=True):
        parents.setdefault(node, parent)
    below = defaultdict(list)
    for node, parent in parents.items():
        below[parent if parent in parents else None].append(node)
    open_ = [(node, []) for node in sorted(below[None], reverse=True)]
    ids, found, last = [], [], []
    while open_:
        node, above = open_.pop()
        ids.append(node)
        found.append([*above, node])
        open_ += [(child, found[-1]) for child in sorted(below.get(node, ()), reverse=True)]
    # The nodes below one follow it, and their ways are longer.
    last, line = [0] * len(ids), []
    for at, way in enumerate([*found, []]):
        while line and len(found[line[-1]]) >= len(way):
            last[line.pop()] = at
        line.append(at)
    kind, whole = tree.schema.field("node_id").type, pa.int32()
    columns = {
        "tree_id": pa.array([tree["tree_id"][0].as_py()] * len(ids), tree.schema.field("tree_id").type), "node_id": pa.array(ids, kind), "first": pa.array(range(1, len(ids) + 1), whole), "last": pa.array(last, whole),
        "depth": pa.array([len(way) - 1 for way in found], whole), "way": pa.array(found, pa.list_(kind)),
    }
    return pa.table(columns)


def _walked(small: DataFrame, parts: int) -> DataFrame:
    """tree_id, node_id, first, last, depth, way of trees that a task holds."""
    tree, node = (T.StructField(c, small.schema[c].dataType) for c in ("tree_id", "node_id"))
    numbers = [T.StructField(c, T.IntegerType()) for c in ("first", "last", "depth")]
    return small.repartition(parts, "tree_id").groupBy("tree_id").applyInArrow(_walk, T.StructType([tree, node, *numbers, T.StructField("way", T.ArrayType(node.dataType))]))


def ways(nodes: DataFrame, most: int = TREE) -> DataFrame:
    """tree_id, node_id, way: the node ids from the root to each node. Nodes without a parent, or whose parent isn't there, are roots; nodes on or
    below a cycle have no way and are left out."""
    small, large, parts = _by_size(_given(nodes), F.count(F.lit(1)), most)
    found = _walked(small, parts).select("tree_id", "node_id", "way")
    return found if large is None else found.unionByName(_doubled(large))


def _doubled(nodes: DataFrame) -> DataFrame:
    """ways of trees of any size."""
    given = nodes.dropDuplicates(["tree_id", "node_id"])
    up = given.select("tree_id", F.col("node_id").alias("parent_id"), F.lit(True).alias("known"))
    rows = given.join(up.hint("merge"), ["tree_id", "parent_id"], "left").select("tree_id", "node_id", F.when(F.col("known"), F.col("parent_id")).alias("next"), F.array("node_id").alias("way"))
    done, open_ = None, stored(rows)
    while True:
        ended = open_.where("next is null").select("tree_id", "node_id", "way")
        done = stored(ended if done is None else done.unionByName(ended))
        # A node's way goes on with the way of the node that it leads to: a whole one if that has ended, else as far as that has come.
        left = open_.where("next is not null")
        whole = done.select("tree_id", F.col("node_id").alias("next"), F.col("way").alias("above"), F.lit(None).cast(nodes.schema["node_id"].dataType).alias("further"))
        part = left.select("tree_id", F.col("node_id").alias("next"), F.col("way").alias("above"), F.col("next").alias("further"))
        step = left.join(whole.unionByName(part).hint("merge"), ["tree_id", "next"]).select("tree_id", "node_id", F.col("further").alias("next"), F.concat("above", "way").alias("way"))
        open_ = stored(step.where(~F.exists(F.slice("way", 1, F.size("way") - 1), lambda x: x == F.col("node_id"))))  # a way that meets its node again is a cycle
        if open_.isEmpty():
            return done


def interval_labels(nodes: DataFrame, most: int = TREE) -> DataFrame:
    """tree_id, node_id, first, last, depth, way: first is the node's number in depth-first order (children by id), last that of the last below it."""
    small, large, parts = _by_size(_given(nodes), F.count(F.lit(1)), most)
    return _walked(small, parts) if large is None else _walked(small, parts).unionByName(_labels(_doubled(large)))


def _labels(found: DataFrame) -> DataFrame:
    sizes = found.select("tree_id", F.explode("way").alias("node_id")).groupBy("tree_id", "node_id").agg(F.count(F.lit(1)).alias("size"))
    numbered = found.withColumn("first", F.row_number().over(Window.partitionBy("tree_id").orderBy("way")))
    return numbered.join(sizes, ["tree_id", "node_id"]).select("tree_id", "node_id", "first", (F.col("first") + F.col("size") - 1).cast("int").alias("last"), (F.size("way") - 1).alias("depth"), "way")


def breadth_first(labels: DataFrame) -> DataFrame:
    """labels with place: the node's number level by level, as its tree is gone through."""
    return labels.withColumn("place", F.row_number().over(Window.partitionBy("tree_id").orderBy("depth", "first")))


def below(labels: DataFrame, tops: DataFrame) -> DataFrame:
    """tree_id, top, node_id: all nodes below tops(tree_id, node_id), themselves included."""
    t = labels.join(tops.select("tree_id", "node_id"), ["tree_id", "node_id"]).select("tree_id", F.col("node_id").alias("top"), F.col("first").alias("f"), F.col("last").alias("l"))
    return labels.join(t, "tree_id").where(F.col("first").between(F.col("f"), F.col("l"))).select("tree_id", "top", "node_id")


def nearest_above(labels: DataFrame, typed: DataFrame, node_type: str) -> DataFrame:
    """tree_id, node_id, ancestor: the nearest node of a type above each node, null where there is none. typed(tree_id, node_id, node_type). Of the
    intervals that hold a node, the nearest begins last."""
    of = labels.join(typed.where(F.col("node_type") == node_type).select("tree_id", "node_id"), ["tree_id", "node_id"]).select("tree_id", F.col("node_id").alias("a"), F.col("first").alias("f"), F.col("last").alias("l"))
    holds = (F.col("first") > F.col("f")) & (F.col("first") <= F.col("l"))
    best = labels.join(of, "tree_id").where(holds).groupBy("tree_id", "node_id").agg(F.max_by("a", "f").alias("ancestor"))
    return labels.select("tree_id", "node_id").join(best, ["tree_id", "node_id"], "left")


def _types(tree: pa.Table) -> pa.Table:
    """The types above each node of a tree, from its intervals."""
    rows = sorted(zip(*(tree[c].to_pylist() for c in ("first", "last", "node_id", "node_type")), strict=True), key=lambda r: (r[0], r[3] is not None, r[3] if r[3] is not None else 0))
    ids, paths, line = [], [], []
    for first, last, node, kind in rows:
        if line and line[-1][0] == first:  # another type of the same node
            paths[-1].append(kind)
            continue
        while line and line[-1][1] < first:
            line.pop()
        ids.append(node)
        paths.append([*(line[-1][2] if line else ()), kind])
        line.append((first, last, paths[-1]))
    field = tree.schema.field
    return pa.table({"tree_id": pa.array([tree["tree_id"][0].as_py()] * len(ids), field("tree_id").type), "node_id": pa.array(ids, field("node_id").type), "path": pa.array(paths, pa.list_(field("node_type").type))})


def type_paths(labels: DataFrame, typed: DataFrame, most: int = TREE) -> DataFrame:
    """tree_id, node_id, path: the types from the root to each node. Labels are read more than once: they should be a table."""
    small, large, parts = _by_size(labels, F.max("last").cast("long"), most)
    types = typed.select("tree_id", "node_id", "node_type")
    held = small.select("tree_id", "node_id", "first", "last").join(types.hint("merge"), ["tree_id", "node_id"], "left")
    s = T.StructType([*(T.StructField(c, labels.schema[c].dataType) for c in ("tree_id", "node_id")), T.StructField("path", T.ArrayType(typed.schema["node_type"].dataType))])
    found = held.repartition(parts, "tree_id").groupBy("tree_id").applyInArrow(_types, s)
    return found if large is None else found.unionByName(_exploded_types(large, types))


def _exploded_types(labels: DataFrame, typed: DataFrame) -> DataFrame:
    steps = labels.select("tree_id", F.col("node_id").alias("of"), F.posexplode("way").alias("at", "node_id"))
    named = steps.join(typed, ["tree_id", "node_id"], "left")
    return named.groupBy("tree_id", F.col("of").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "node_type"))), lambda s: s["node_type"]).alias("path"))
