"""Journaled batches that survive a writer's death, interval labels of deep trees, and context packs."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import context_pack, tree
from lodestone.sources.journal import Journal


@pytest.fixture
def journal(spark, tmp_path):
    now = [1000.0]
    j = Journal(spark, f"file://{tmp_path}/j", spark.createDataFrame([], "k long, text string").schema, clock=lambda: now[0])
    j.now = now
    return j


def some(spark, *keys):
    return spark.createDataFrame([(k, f"t{k}") for k in keys], "k long, text string")


def keys(journal):
    return sorted(r["k"] for r in journal.read().collect())


def test_a_batch_appears_when_committed(spark, journal):
    assert keys(journal) == [] and journal.pending() == [] and journal.purge() == 0
    journal.begin("a", some(spark, 1, 2), ["f1"])
    assert keys(journal) == [] and journal.pending() == ["a"]
    journal.commit("a")
    assert keys(journal) == [1, 2] and journal.pending() == []
    with pytest.raises(ValueError):
        journal.commit("a")
    with pytest.raises(ValueError):
        journal.begin("a", some(spark, 3))
    with pytest.raises(ValueError):
        journal.rollback("none")


def test_death_between_write_and_commit(spark, journal):
    """Another process finds a clean table, takes back what was left, and the batch can be written again."""
    journal.begin("a", some(spark, 1))
    journal.commit("a")
    journal.begin("b", some(spark, 2), ["f2", "f3"])
    later = Journal(spark, journal.base, journal.schema)
    assert keys(later) == [1] and later.recover() == ["b"] and keys(later) == [1]
    later.begin("b2", some(spark, 2))
    later.commit("b2")
    assert keys(journal) == [1, 2]


def test_death_while_writing(spark, journal):
    bad = some(spark, 7).withColumn("text", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        journal.begin("a", bad)
    assert keys(journal) == [] and journal.pending() == ["a"]
    with pytest.raises(ValueError, match="whole"):
        journal.commit("a")
    assert journal.recover() == ["a"] and keys(journal) == []


def test_two_writers_of_one_manifest(spark, journal):
    journal.begin("a", some(spark, 1))
    at, entries = journal.version(), journal.entries()
    journal.commit("a")
    with pytest.raises(Exception, match="(?i)exist"):
        journal._write(at, entries)
    assert keys(journal) == [1]


def test_rollback_and_purge(spark, journal):
    for k in "abcd":
        journal.begin(k, some(spark, ord(k)), [f"{k}.py"])
    journal.commit("a")
    journal.commit("b")
    journal.fail("c", "disk")
    assert journal.rollback("b") == ["b.py"] and keys(journal) == [97]
    journal.now[0] += 100
    assert journal.purge(200) == 0 and journal.purge(50) == 3
    assert keys(journal) == [97] and journal.pending() == ["d"] and len(journal.entries()) == 2
    assert [e["files"] for e in journal.entries() if e["state"] == "committed"] == [["a.py"]]


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [("deep", k, k - 1 if k else None, "def" if k % 10 == 3 else "x") for k in range(51)] + [("deep", 100 + k, k, "leaf") for k in range(0, 51, 5)]
    rows += [("wide", 1, None, "x"), ("wide", 2, 1, "def"), ("wide", 3, 1, "x"), ("wide", 4, 2, "def"), ("wide", 5, 4, "x"), ("wide", 9, 77, "x")]
    rows += [("ring", 1, 3, "x"), ("ring", 2, 1, "x"), ("ring", 3, 2, "x"), ("ring", 4, 3, "x"), ("ring", 5, None, "x"), (None, 1, None, "x")]
    return spark.createDataFrame(rows, "tree_id string, node_id long, parent_id long, node_type string")


@pytest.fixture(scope="module")
def labels(nodes):
    return tree.interval_labels(nodes).cache()


def test_labels(labels):
    got = {(r["tree_id"], r["node_id"]): (r["first"], r["last"], r["depth"]) for r in labels.collect()}
    assert got["deep", 0] == (1, 62, 0) and got["deep", 50][2] == 50 and got["deep", 150] == (*[got["deep", 50][0] + 1] * 2, 51)
    assert {k[1]: v for k, v in got.items() if k[0] == "wide"} == {1: (1, 5, 0), 2: (2, 4, 1), 4: (3, 4, 2), 5: (4, 4, 3), 3: (5, 5, 1), 9: (6, 6, 0)}
    assert [k for k in got if k[0] == "ring"] == [("ring", 5)]  # a cycle and what hangs on it have no root


def test_ancestors_and_subtrees(labels, nodes):
    above = {(r["tree_id"], r["node_id"]): r["ancestor"] for r in tree.nearest_above(labels, nodes, "def").collect()}
    assert above["deep", 50] == 43 and above["deep", 43] == 33 and above["deep", 3] is None and above["deep", 105] == 3
    assert above["wide", 5] == 4 and above["wide", 4] == 2 and above["wide", 3] is None
    got = {r["node_id"] for r in tree.below(labels, nodes.where("tree_id = 'deep' and node_id = 40")).collect()}
    assert got == {*range(40, 51), 140, 145, 150}
    order = [r["node_id"] for r in tree.breadth_first(labels).where("tree_id = 'wide'").orderBy("place").collect()]
    assert order == [1, 9, 2, 3, 4, 5]
    path = {r["node_id"]: r["path"] for r in tree.type_paths(labels, nodes).where("tree_id = 'wide'").collect()}
    assert path[5] == ["x", "def", "def", "x"]


def test_pack_repeats_nothing(spark):
    units = spark.createDataFrame([(i, "py", s, s * 300) for i, s in enumerate(["a", "b", "c", "d", "d", "d", "e", "f", "g", "h"])], "unit_id long, language string, symbol string, code string")
    calls = [(0, n, k) for k, n in enumerate(["b", "d", "b", "e", "zz", "f", "g", "h"])] + [(1, "a", 0), (1, "c", 1), (1, "d", 2)]
    hits = spark.createDataFrame([(7, 0, 1), (7, 1, 2), (8, 1, 1), (9, 99, 1)], "query_id long, unit_id long, rank int")
    rows = context_pack.context_pack(hits, units, spark.createDataFrame(calls, "unit_id long, callee string, place int")).collect()
    got = sorted((r["query_id"], r["part"], r["place"], r["unit_id"], r["relation"], len(r["code"])) for r in rows)
    assert got == [
        (7, "primary", 1, 0, None, 300), (7, "primary", 2, 1, None, 300),
        # b is related before it is a hit; d has two units of three; zz is no unit; g and h come after five names; a was a hit.
        (7, "related", 1, 1, "called by a", 300), (7, "related", 2, 3, "called by a", 300), (7, "related", 3, 4, "called by a", 300), (7, "related", 4, 6, "called by a", 300), (7, "related", 5, 7, "called by a", 300), (7, "related", 6, 2, "called by b", 300),
        (8, "primary", 1, 1, None, 300), (8, "related", 1, 0, "called by b", 300), (8, "related", 2, 2, "called by b", 300), (8, "related", 3, 3, "called by b", 300), (8, "related", 4, 4, "called by b", 300),
    ]


def test_only_what_a_context_holds_is_made(spark, sf_dir):
    """Of the functions only those that are hit are parsed, and code is made for what the contexts hold."""
    from lodestone.plans import programs

    units = spark.createDataFrame([(i, "py", s) for i, s in enumerate(["a", "b", "c", "b", "d"])], "unit_id long, language string, symbol string")
    calls = spark.createDataFrame([(0, "b", 0), (2, "d", 0)], "unit_id long, callee string, place int")
    asked = []

    def code_of(ids):
        asked.extend(sorted(r["unit_id"] for r in ids.collect()))
        return ids.withColumn("code", F.repeat(F.lit("x"), F.lit(600)))

    rows = context_pack.context_pack(spark.createDataFrame([(7, 0, 1), (7, 99, 2)], "query_id long, unit_id long, rank int"), units, calls, code_of=code_of).collect()
    assert asked == [0, 1, 3]
    assert sorted((r["part"], r["unit_id"], len(r["code"])) for r in rows) == [("primary", 0, 600), ("related", 1, 500), ("related", 3, 500)]
    whole = programs.calling_units(spark, sf_dir).where("unit_id in (3, 8)").collect()
    few = programs.calling_units(spark, sf_dir, spark.createDataFrame([(3,), (8,)], "unit_id long")).collect()
    assert sorted(whole) == sorted(few) and few


def test_large_trees_as_small_ones(labels, nodes):
    """Trees walked in a task and trees whose ways are doubled have the same labels and types; walked ones shuffle no ways."""
    rows = labels.collect()
    want = {repr(tuple(r)) for r in rows}
    for most in (1, 5, 20):
        assert {repr(tuple(r)) for r in tree.interval_labels(nodes, most).select(labels.columns).collect()} == want
        assert {repr(tuple(r)) for r in tree.ways(nodes, most).collect()} == {repr((r["tree_id"], r["node_id"], r["way"])) for r in rows}
    types = [{(r["tree_id"], r["node_id"], tuple(r["path"])) for r in tree.type_paths(labels, nodes, most).collect()} for most in (1, 5, tree.TREE)]
    assert types[0] == types[1] == types[2] and len(types[0]) == len(want)
    assert "Generate" not in tree.type_paths(labels, nodes)._jdf.queryExecution().toString()
