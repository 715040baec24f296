"""Checklists, verification in stages, checks of answers, tainted parameters, fallback of parsers and similar structures on fixtures."""

import math
import random

from lodestone.operators import parsing, property_graph, review
from lodestone.plans.sources_and_parsers import similar_units
from pyspark.sql import functions as F


def test_checklist_escalates(spark):
    items = [review.CheckItem("c", "critical", ("safe", "sure", "calm")), review.CheckItem("h1", "high", (), ("evil",)), review.CheckItem("h2", "high", ("ok",)), review.CheckItem("m", "medium", ("fine",))]
    code = {1: "SAFE sure ok fine", 2: "safe ok fine", 3: "safe calm ok evil fine", 4: "safe sure evil", 5: "safe sure ok", 6: None, 7: ""}
    got = {r["unit_id"]: r for r in review.checklist(spark.createDataFrame(list(code.items()), "unit_id long, code string"), items, "info").collect()}
    assert {i: r["risk_level"] for i, r in got.items()} == {1: "low", 2: "critical", 3: "high", 4: "critical", 5: "medium", 6: "critical", 7: "critical"}
    assert [(c["found"], c["missing"], c["anti"], c["passed"]) for c in got[3]["checks"]] == [(2, 1, 0, True), (0, 0, 1, False), (1, 0, 0, True), (1, 0, 0, True)]
    strict = review.checklist(spark.createDataFrame([(5, "safe sure ok")], "unit_id long, code string"), items, "critical")
    assert strict.first()["risk_level"] == "critical"


def test_stages_and_counters(spark):
    rows = [
        (1, "xss", "low", "drop", "vulnerable"), (2, "xss", "HIGH", "drop", "vulnerable"), (3, "RCE", "low", "drop", "false_positive"),
        (4, "xss", None, "need_more_context", "uncertain"), (5, None, "low", None, None), (6, "xss", "low", "keep", "vulnerable"),
    ]
    findings = spark.createDataFrame(rows, "id long, category string, risk_level string, triage string, deep string")
    contexts = spark.createDataFrame([(4, "four"), (6, "six")], "id long, context string")
    out = review.verify_stages(findings, contexts)
    got = {r["id"]: (r["stages"], r["context"]) for r in out.collect()}
    t, d, p = "triage", "deep_verify", "patch_suggest"
    assert got == {1: ([t], None), 2: ([d, p], None), 3: ([d], None), 4: ([t, d], "four"), 5: ([t, d], None), 6: ([t, d, p], None)}
    assert tuple(review.stage_counters(out).first()) == (4, 1, 1, 2, 5, 2, 1, 2)
    assert review.stage_counters(out.where("false")).first()["triage_total"] == 0


def test_json_is_salvaged_in_order(spark):
    texts = ['{"a": 1}', 'x ```json\n{"a": 2}\n``` {"a": 9}', 'x ```\n{bad}\n``` ```\n{"a": 3}\n```', 'so {"a": {"b": 4}} it is', "{", "[1]", "no", None, ""]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i long, c string").orderBy("i").select(review.salvaged_json("c")).collect()]
    assert got == ['{"a": 1}', '{"a": 2}', '{"a": 3}', '{"a": {"b": 4}}', None, None, None, None, None]


def test_answers_are_checked(spark):
    rows = ['{"file": "a\\\\b.py", "severity": "low", "line": 3, "confidence": 0.9}', '{"file": "gone.py", "severity": "low"}', '{"file": "a/b.py", "severity": "huge"}', '{"file": "a/b.py"}', '{"file": "a/b.py", "severity": "low", "line": 99, "confidence": 0.1}', "nothing", None]
    files = spark.createDataFrame([("a/b.py", 10)], "path string, n_lines long")
    out = review.check_answers(spark.createDataFrame(list(enumerate(rows)), "i long, content string"), files, ("severity",), {"severity": ("low",)})
    got = {r["i"]: (r["result"], r["warnings"]) for r in out.collect()}
    assert got == {0: ("valid", []), 1: ("hallucination", []), 2: ("schema_error", []), 3: ("schema_error", []), 4: ("valid", ["low_confidence", "invalid_line"]), 5: ("invalid_json", []), 6: ("invalid_json", [])}


def test_parameters_of_frameworks(spark):
    rows = [
        (1, ["app.route('/u/<name>')"], "def f(name, other):"), (2, [], "def f(item: str = Query(None, alias='x'), size: int = Size(3), user_item=1):"),
        (3, None, "def f(self, Request, *rest, **more) -> dict[str, int]:"), (4, ["use(Form)"], "async def f(a: dict[str, int] = {}, b=max(1, (2))):"), (5, [], "def f():"), (6, [], None), (7, [], ""),
    ]
    out = review.tainted_parameters(spark.createDataFrame(rows, "i long, decorators array<string>, signature string"))
    got = {(r["i"], r["parameter"]): r["tainted"] for r in out.collect()}
    assert got == {
        (1, "name"): True, (1, "other"): False, (2, "item"): True, (2, "size"): False, (2, "user_item"): False, (3, "self"): False, (3, "Request"): True,
        (3, "rest"): False, (3, "more"): False, (4, "a"): True, (4, "b"): True,
    }


def test_the_best_parser_of_a_file(spark):
    whole = "def a():\n    return 1\n\ndef b():\n    return 2\n"
    texts = {1: whole, 2: "def a(:\n    x\ndef b():\n    y\n", 3: "class A:\n    def m(self):\n        return 1\n", 4: "x = 1\n" * 8 + "def a():\n    return 1\n", 5: "", 6: None}
    got = {r["file_id"]: (r["source"], r["n_units"], r["errors"]) for r in review.best_results(review.parse_results(spark.createDataFrame(list(texts.items()), "file_id long, content string"))).collect()}
    assert got == {1: ("regex", 2, 0), 2: ("regex", 2, 0), 3: ("regex", 2, 0), 4: ("tree", 1, 0), 5: ("tree", 0, 0), 6: ("tree", 0, 0)}


def test_similar_structures_against_all_pairs(spark):
    random.seed(3)
    rows = [(i, [float(random.choice((0, 0, 1, 2))), float(random.randrange(2)), 1.0]) for i in range(120)] + [(i, [2.0, 4.0, 2.0]) for i in range(200, 260)]
    got = review.similar_structures(spark.createDataFrame(rows, "file_id long, features array<double>"), F.col("file_id") % 20 == 0, 7).collect()
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    want = set()
    for q, v in rows:
        if q % 20 == 0:
            near = sorted((-round(sum(a * b for a, b in zip(v, w, strict=True)) / (norm(v) * norm(w) + 1e-10), 6), i) for i, w in rows if i != q)
            want |= {(q, i, -s, r) for r, (s, i) in enumerate(near[:7], 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_features_know_depth_and_branches(spark):
    nodes = spark.createDataFrame([(1, 0, None, "function"), (1, 1, 0, "if"), (1, 2, 1, "loop"), (1, 3, 2, "call"), (2, 0, None, "function")], "file_id long, node_id int, parent_id int, node_type string")
    got = {r["file_id"]: r["features"] for r in review.structure_features(nodes, ("function", "call")).collect()}
    assert got == {1: [1.0, 1.0, 3.0, 3.0], 2: [1.0, 0.0, 1.0, 0.0]}


def test_flows_of_one_program(spark):
    code = "def f(request):\n    v1 = request.args\n    v2 = v1 + limit\n    log(v2)\n    eval(v2)\n    v0 = escape(v2)\n    os.system(v0)\n"
    got = [tuple(r) for r in parsing.taint_units(spark.createDataFrame([(1, code)], "file_id long, content string")).collect()]
    assert got == [(1, 2, 5, "v2", "eval", True, 0.4), (1, 2, 7, "v0", "system", True, 0.4)]


def test_flows_over_many_lines(spark):
    code = "v1 = request.args\n" + "log(1)\n" * 14 + "eval(v1)\n"
    got = [tuple(r) for r in parsing.taint_units(spark.createDataFrame([(1, code)], "file_id long, content string")).collect()]
    assert got == [(1, 1, 16, "v1", "eval", False, 0.8)]


def test_oversized_files_are_cut_without_loss(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content"))
    texts = {r["file_id"]: r["content"] or "" for r in docs.collect()}
    parts = {}
    for r in parsing.split_oversized(docs, 300).orderBy("file_id", "part").collect():
        parts.setdefault(r["file_id"], []).append(r)
    assert set(parts) == set(texts)
    for i, of in parts.items():
        lines = texts[i].split("\n")
        assert [p["part"] for p in of] == list(range(len(of)))
        assert [p["start_line"] for p in of] == [1] + [p["end_line"] + 1 for p in of[:-1]] and of[-1]["end_line"] == len(lines)
        for p in of:
            own = lines[p["start_line"] - 1 : p["end_line"]]
            assert p["chunk"] == ("# Context: context\n" if p["part"] else "") + "\n".join(own)
            assert len(own) == 1 or len("\n".join(own)) + 1 <= 1000


def test_units_by_their_categories(spark):
    rng = random.Random(6)
    kinds = ["a", "b", "c", None]
    found = [(u, rng.choice(kinds)) for u in range(60) for _ in range(rng.randint(1, 9))] + [(100, None), (120, None), (None, "a")]
    counts = {}
    for u, c in found:
        if u is not None:
            counts.setdefault(u, {}).setdefault(c, 0)
            counts[u][c] += 1
    norm = {u: math.sqrt(sum(n * n for n in c.values())) for u, c in counts.items()}
    want = []
    for q in (u for u in counts if u % 20 == 0):
        dots = {u: sum(n * counts[q].get(c, 0) for c, n in counts[u].items() if c is not None) for u in counts if u != q}
        best = sorted((-round(d / (norm[u] * norm[q]), 6), u) for u, d in dots.items() if d)[:4]
        want += [(q, u, -s, i + 1) for i, (s, u) in enumerate(best)]
    got = similar_units(spark.createDataFrame(found, "unit_id long, category string"), F.col("unit_id") % 20 == 0, 4)
    assert sorted(map(tuple, got.select("query_id", "unit_id", "score", "rank").collect())) == sorted(want)
    # Pairs were once made by a join on the category, one row for each pair of units and category.
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_depths_are_not_broadcast(spark):
    nodes = spark.createDataFrame([(1, 0, None, "function"), (1, 1, 0, "if")], "file_id long, node_id int, parent_id int, node_type string")
    assert "BroadcastExchange" not in review.structure_features(nodes, ("function",))._jdf.queryExecution().executedPlan().toString()


def test_structures_of_files_are_counted_where_they_are_parsed(spark):
    texts = ["def f(a):\n    if a:\n        for x in a:\n            f(x)\n    return a\n", "x = 1\n", "", None, "def f(:", "while x:\n    y = 'a'\n"]
    files = spark.createDataFrame(list(enumerate(texts)), "file_id long, content string")
    kinds = ("function", "assignment", "call", "loop")
    got = {r["file_id"]: r["features"] for r in review.file_structures(files, kinds).collect()}
    assert got == {r["file_id"]: r["features"] for r in review.structure_features(property_graph.graph_nodes(files), kinds).collect()}
    assert got == {0: [1, 0, 1, 1, 3, 3], 1: [0, 1, 0, 0, 1, 0], 5: [0, 1, 0, 1, 2, 1]}
