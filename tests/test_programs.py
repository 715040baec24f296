"""Property graphs, typed paths, and taint from arguments to parameters, on small programs."""

import random
import pytest
from pyspark.sql import functions as F

from lodestone.operators import property_graph as P
from lodestone.operators import taint
from lodestone.plans import programs

CODE = """
import os

def serve(request, path=None):
    name = request.args
    if name:
        full = path + name
        log(full)
    else:
        full = name
    for part in full.split(sep):
        os.remove(part)
    name += full
    return name

async def other(name):
    while name:
        name = f(name)
"""


@pytest.fixture(scope="module")
def graph(spark):
    files = spark.createDataFrame([(1, CODE), (2, "def broken(:"), (3, None), (4, ""), (5, "x = 1\ny = x\n")], "file_id long, content string")
    return P.graph_nodes(files).cache()


def test_nodes(graph):
    got = {(r["file_id"], r["node_id"]): (r["parent_id"], r["branch"], r["node_type"], r["name"], r["defines"], r["uses"]) for r in graph.collect()}
    assert {i for i, _ in got} == {1, 5}
    assert [got[1, k] for k in range(1, 9)] == [
        (None, "body", "function", "serve", [], []),
        (1, None, "parameter", "request", ["request"], []),
        (1, None, "parameter", "path", ["path"], []),
        (1, "body", "assignment", "name", ["name"], ["request"]),
        (1, "body", "if", "if", [], ["name"]),
        (5, "body", "assignment", "full", ["full"], ["path", "name"]),
        (5, "body", "call", "log", [], ["full"]),
        (5, "else", "assignment", "full", ["full"], ["name"]),
    ]
    assert got[1, 9][2:5] == ("loop", "for", ["part"]) and set(got[1, 9][5]) == {"full", "sep"} and got[1, 10][3] == "os.remove" and set(got[1, 11][5]) == {"full", "name"}


def edges(graph, kind, file_id=1, **more):
    return {(r["src"], r["dst"]) for r in P.graph_edges(graph, **more).where((F.col("file_id") == file_id) & (F.col("kind") == kind)).collect()}


def test_control_edges(graph):
    assert edges(graph, "control_true") == {(5, 6), (9, 10), (15, 16)} and edges(graph, "control_false") == {(5, 8)}
    assert edges(graph, "control_flow") == {(0, 1), (1, 13), (1, 4), (4, 5), (5, 9), (9, 11), (11, 12), (6, 7), (13, 15)}


def test_data_edges_by_place(graph):
    """A use has the last definition before it, of its own function; what a statement defines comes after what it uses."""
    assert edges(graph, "data_flow") == {(2, 4), (4, 5), (3, 6), (4, 6), (6, 7), (4, 8), (8, 9), (9, 10), (8, 11), (4, 11), (11, 12), (14, 15), (14, 16)}
    assert edges(graph, "data_flow", 5) == {(0, 1)}


def test_one_definition_for_each_variable(graph):
    assert (11, 4) not in edges(graph, "data_flow", reaching=False) and {(11, 5), (8, 7), (16, 15)} <= edges(graph, "data_flow", reaching=False)


@pytest.fixture(scope="module")
def web(spark):
    return spark.createDataFrame([(1, 2, "a"), (2, 3, "a"), (3, 1, "a"), (2, 4, "b"), (3, 4, "a"), (1, 4, "c"), (4, 5, "a"), (3, 9, "a")], "src long, dst long, kind string")


def paths(web, start, end, **more):
    spark = web.sparkSession
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    return sorted(r["path"] for r in P.typed_paths(web, ids(*start), ids(*end), **more).collect())


def test_paths_follow_kinds(web):
    assert paths(web, [1], [4], kinds=("a",), with_end=True) == [[1, 2, 3, 4]]
    assert paths(web, [1], [4], kinds=("a", "b"), with_end=True) == [[1, 2, 3, 4], [1, 2, 4]]
    assert paths(web, [1], [4, 5], with_end=True) == [[1, 2, 3, 4], [1, 2, 3, 4, 5], [1, 2, 4], [1, 2, 4, 5], [1, 4], [1, 4, 5]]


def test_paths_are_bounded(web):
    assert paths(web, [1], [4], max_nodes=2) == [[1], [1, 2]] and paths(web, [1], [4], most=1) == [[1]]
    assert paths(web, [1], [7]) == [] and paths(web, [1], [1]) == []


def test_first_paths_of_many(spark):
    layers = [(i * 10 + a, (i + 1) * 10 + b, "x") for i in range(1, 4) for a in range(3) for b in range(3)]
    web = spark.createDataFrame([(0, 10 + a, "x") for a in range(3)] + layers + [(40 + a, 99, "x") for a in range(3)], "src long, dst long, kind string")
    got = paths(web, [0], [99])
    assert len(got) == 10 and got == sorted([0, a, b, c, d] for a in (10, 11, 12) for b in (20, 21, 22) for c in (30, 31, 32) for d in (40, 41, 42))[:10]


UNITS = [
    (1, "python", "view", "def view(request, n=3)", "def view(request, n=3):\n    x = n\n    load(request, n)\n    load(n, request)"),
    (2, "python", "load", "def load(self, key: str, *rest)", "def load(self, key: str, *rest):\n    store(key, 'k', rest)\n    system('ls', rest)"),
    (3, "python", "store", "def store(a, b, c)", "def store(a, b, c):\n    view(a)\n    c = quote(c)\n    y = 1\n    execute('x', a)\n    execute(c, b)"),
    (4, "php", "load", "function load($key)", "execute(key)"),
    (5, "python", "idle", "def idle()", "def idle():\n    pass"),
    (6, "python", "gone", None, None),
]


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(UNITS, "unit_id long, language string, symbol string, signature string, code string")


def test_parameters(units):
    assert sorted(tuple(r) for r in taint.parameters(units).where("unit_id <> 4").collect()) == [(1, 0, "request"), (1, 1, "n"), (2, 0, "key"), (2, 1, "rest"), (3, 0, "a"), (3, 1, "b"), (3, 2, "c")]


def test_arguments_flow_by_their_place(units):
    pairs = {tuple(x.replace("\x1f", ".") for x in r) for r in taint.argument_flows(units).collect()}
    # Each call counts its own places; a literal takes its place; units of other languages aren't called.
    assert pairs == {("1.request", "2.key"), ("1.n", "2.rest"), ("1.n", "2.key"), ("1.request", "2.rest"), ("2.key", "3.a"), ("2.rest", "3.c"), ("3.a", "1.request")}


def test_taint_spreads_and_ends(units):
    got = {(r["unit_id"], r["name"]): r["depth"] for r in taint.spread(units, taint.request_parameters(units)).collect()}
    assert got == {(1, "request"): 0, (2, "key"): 1, (2, "rest"): 1, (3, "a"): 2, (3, "c"): 2}
    assert len(taint.spread(units, taint.request_parameters(units), max_depth=1).collect()) == 3


def test_cross_function_sinks(units):
    rows = taint.cross_function_sinks(units, taint.request_parameters(units), (("execute", "sql", "high"), ("system", "command", "critical")), "quote").collect()
    got = {(r["unit_id"], r["name"], r["sink"]): (r["sanitized"], r["risk_level"], r["confidence"]) for r in rows}
    assert got == {(3, "a", "execute"): (True, "low", 0.285), (3, "c", "execute"): (True, "low", 0.285), (2, "rest", "system"): (False, "critical", 0.95)}


def test_paths_within_parts_as_by_joins(spark):
    rng = random.Random(2)
    edges = [(p, p * 100 + rng.randrange(9), p * 100 + rng.randrange(9), rng.choice("abc")) for p in range(4) for _ in range(24)]
    g = spark.createDataFrame(edges, "part long, src long, dst long, kind string")
    ids = lambda ks: spark.createDataFrame([(p, p * 100 + k) for p in range(4) for k in ks], "part long, id long")
    for kinds, nodes, most in ((("a", "b"), 4, 10), (None, 3, 2), (("c",), 10, 10)):
        by = {w: sorted(map(tuple, P.typed_paths(g, ids((0, 1, 5)), ids((1, 7)), kinds, nodes, most, with_end=True, within=w).collect())) for w in (None, "part")}
        assert by["part"] == by[None] and by[None]


def test_nodes_are_not_broadcast(spark):
    nodes = P.graph_nodes(spark.createDataFrame([(1, "def f(a):\n    return a\n")], "file_id long, content string"))
    assert "BroadcastExchange" not in P.control_edges(nodes)._jdf.queryExecution().executedPlan().toString()


ODD = ["", "\n \n", "x = 1\n  y = x\n", "if x:\n", "if x:\n    y = x\n\nelse:\n  z = y\n", "else:\n    x = y\n", "for a in x:\n    y = a\nelse:\n    z = y\n", "x = (a,\nb)\n", "x = 'a:'\n", "def f(a):\n    def g(b):\n        return a\n    return b\nf(g)\n", "if a:\n    b = a\nelif b:\n    c = b\nelse:\n    d = c\n", "def if(a):\n    return a\n", "if x: y = x\nz = y\n", "class A:\n    x = y\n", "def f():\n    x = a\n    if x:\n        f(x)\n        else:\n            y = x\n", "from __future__ import barry_as_FLUFL\nx != y\n"]


def test_lines_tell_what_the_tree_tells():
    r = random.Random(5)
    lines = ["x = y + z", "a.b(x)", "if x > y:", "else:", "for i, j in f(x):", "while x:", "return x", "x += y", "def g(a, b=c, *d, e=1):", "def f():", "elif x:", "pass", "x = (1,", "2)", "x: int = y", "try:", "x = 'y'", "match x:", "@f", "import os", ""]
    texts = list(ODD)
    for _ in range(3_000):
        level, text = 0, []
        for _ in range(r.randint(1, 8)):
            text.append("  " * level + (line := r.choice(lines[:10] if r.random() < 0.8 else lines)))
            level = level + 1 if line.endswith(":") else max(0, level - r.choice([0, 0, 1, 2]))
        texts.append("\n".join([*text, "  " * level + "pass"]))
    told = [(t, P._by_lines(3, t)) for t in texts]
    assert [t for t, nodes in told if nodes is not None and nodes != P._by_tree(3, t)] == []
    assert sum(bool(nodes) for _, nodes in told) > 300


def test_data_edges_of_a_file_in_its_row(spark, graph, sf_dir):
    files = spark.createDataFrame([(1, CODE), (2, "def broken(:"), (3, None), *((i, t) for i, t in enumerate(ODD, 5))], "file_id long, content string")
    nodes = P.graph_nodes(files)
    for reaching in (True, False):
        got, want = (sorted(map(tuple, df.collect())) for df in (P.file_data_edges(files, reaching), P.data_edges(nodes, reaching)))
        assert got == want and len(got) > 10
    plan = programs.l16_table(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapIn") == 1  # each program is made and parsed once


def test_paths_of_a_file_in_its_row(spark, sf_dir):
    files = spark.createDataFrame([(1, CODE), (2, "def broken(:"), (3, None), *((i, t) for i, t in enumerate(ODD, 5))], "file_id long, content string")
    nodes = P.graph_nodes(files).cache()
    ids = nodes.withColumn("id", F.col("file_id") * 1000 + F.col("node_id"))
    over_all = P.graph_edges(nodes).select("file_id", *((F.col("file_id") * 1000 + F.col(c)).alias(c) for c in ("src", "dst")), "kind")
    for kinds, most, with_end in ((None, 10, True), (P.DATA, 10, False), (P.CONTROL, 2, True), (None, 1, False), (None, 40, True)):
        want = P.typed_paths(over_all, ids.where("node_type in ('function', 'parameter')"), ids.where("node_type in ('return', 'assignment')"), kinds, 8, most, with_end, within="file_id")
        got = P.file_paths(files, lambda kind, name: kind in ("function", "parameter"), lambda kind, name: kind in ("return", "assignment"), kinds, 8, most, with_end)
        plain = sorted((r["file_id"] * 1000 + r["start"], r["file_id"] * 1000 + r["end"], [r["file_id"] * 1000 + n for n in r["path"]]) for r in got.collect())
        assert plain == sorted((r["start"], r["end"], r["path"]) for r in want.collect()) and len(plain) > 5
    plan = programs.l17_all(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    after = plan[: plan.index("MapIn")]
    assert "Exchange" not in after and "Scan parquet" not in after  # no edge is shuffled, no node written
