"""Steps over made programs: parts by number of rows, parsers' rows some at a time, no join or step that gathers or repeats more than it needs."""

import pandas as pd

from lodestone.operators import parsing, review, taint
from lodestone.plans import programs
from lodestone.plans.query import dealt


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts_follow_the_number_of_rows(spark, sf_dir):
    assert dealt(spark.range(1000), "id", 10).rdd.getNumPartitions() == 100
    for made in (programs.programs, programs.calling_units, programs.route_files):
        text = plan(made(spark, sf_dir))
        assert text.count("Exchange") == 1 and "REPARTITION_BY_NUM" in text


def test_rows_of_a_batch_come_some_at_a_time():
    batch = pd.DataFrame({"file_id": range(50), "content": ["f(g(1))\n" * 20] * 50})
    found = list(parsing.frames(iter([batch]), parsing.syntax_nodes, parsing.GRAPH_NODE, most=100))
    assert max(map(len, found)) == 100 and sum(map(len, found)) == 50 * len(list(parsing.syntax_nodes(1, "f(g(1))\n" * 20)))
    every, calls = (list(parsing.syntax_nodes(1, "a.b(c)\nd()\n", t)) for t in (None, ("Call",)))
    assert calls == [r for r in every if r[3] == "Call"] and len(calls) == 2


def test_what_does_not_ask_is_not_joined(spark):
    rows = [(i, "x", "low", "need_more_context" if i % 100 == 0 else None, "other") for i in range(1000)] + [(None, "x", "low", "need_more_context", None)]
    findings = spark.createDataFrame(rows, "id long, category string, risk_level string, triage string, deep string")
    contexts = spark.range(0, 500).selectExpr("id", "concat('c', id) as context")
    found = review.verify_stages(findings, contexts)
    assert "Union" in plan(found)
    got = {r["id"]: r["context"] for r in found.collect()}
    assert found.count() == 1001 and got == {i: f"c{i}" if i is not None and i % 100 == 0 and i < 500 else None for i in [*range(1000), None]}


def test_parsers_results_are_made_in_a_files_row(spark):
    files = spark.createDataFrame([(1, "x = 1\ndef f():\n  pass\n\nclass A:\n  def g(self):\n    pass\n\n\n"), (2, "def broken(:\n  x\n"), (3, None), (4, "")], "file_id long, content string")
    found = review.parse_results(files)
    assert "Exchange" not in plan(found) and "Join" not in plan(found)
    got = {(r["file_id"], r["source"]): (r["n_units"], round(r["coverage"], 4), r["errors"]) for r in found.collect()}
    assert got[1, "tree"] == (2, round(5 / 7, 4), 0) and got[1, "regex"] == (3, round(6 / 7, 4), 0)
    assert got[2, "tree"] == (0, 0.0, 1) and got[2, "regex"] == (1, 1.0, 0) and got[3, "tree"] == got[3, "regex"] == got[4, "tree"] == (0, 0.0, 0)


def test_flows_are_made_once(spark, monkeypatch):
    seen, real = [], taint.stored
    monkeypatch.setattr(taint, "stored", lambda df: seen.append(df.columns) or real(df))
    units = spark.createDataFrame([(1, "python", "a", "def a(request)", "b(request)"), (2, "python", "b", "def b(x)", "c(x)"), (3, "python", "c", "def c(y)", "")], "unit_id long, language string, symbol string, signature string, code string")
    got = {(r["unit_id"], r["name"], r["depth"]) for r in taint.spread(units, taint.request_parameters(units)).collect()}
    assert got == {(1, "request", 0), (2, "x", 1), (3, "y", 2)} and seen == [["src", "dst"]]
