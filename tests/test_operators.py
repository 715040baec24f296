"""Small fixtures for the operators' edges."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import columns as C
from lodestone.functions.embeddings import md5_embedding
from lodestone.operators import analytics, files, graph, incremental, rules, search, text


@pytest.mark.parametrize(
    "path, pattern, expected",
    [("lib/tide.go", "*.go", True), ("lib\\moon\\tide.go", "*.go", True), ("lib/moon/phase.rs", "lib/*", True), ("docs/Harbour/map.txt", "harbour", True), ("lib/tide.go", "harbour", False), ("D:\\ship\\log.txt", "log.???", True)],
)
def test_path_filter(spark, path, pattern, expected):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(C.path_filter("p", pattern)).first()[0] is expected


def test_rank_fusion_marks_both(spark):
    vector = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "k string, rank int")
    keyword = spark.createDataFrame([("b", 0), ("d", 1)], "k string, rank int")
    found = {r["k"]: r for r in search.rrf(vector, keyword, "k").collect()}
    assert len(found) == 4 and found["b"]["source"] == "both" and found["b"]["rank"] == 0
    assert found["b"]["score"] == pytest.approx(1 / 61 + 0.8 / 60)


@pytest.mark.parametrize("scores, kept", [([0.8, 0.62, 0.57, 0.58, 0.52], 4), ([0.27, 0.26, 0.1], 1), ([0.6, 0.55, 0.2], 2), ([], 0)])
def test_smart_cutoff(spark, scores, kept):
    df = spark.createDataFrame(list(enumerate(scores)), "k int, score double")
    assert search.smart_cutoff(df, "k").count() == kept


def test_chunks_reassemble(spark):
    long = "\n".join(f"wave {i} of " + "sea " * (i % 7) for i in range(310))
    units = spark.createDataFrame([(1, long), (2, "ebb\nflow"), (3, "")], "unit_id long, code string")
    chunks = text.unit_chunks(units, max_tokens=500)
    counts = {r["unit_id"]: r["total_chunks"] for r in chunks.collect()}
    assert counts[1] > 1 and counts[2] == 1 and counts[3] == 1
    back = {r["unit_id"]: r for r in text.reassemble(chunks, "unit_id").collect()}
    assert back[1]["content"] == long and back[1]["start_line"] == 1 and back[1]["end_line"] == 310


def test_line_windows_skip_blank(spark):
    df = spark.createDataFrame([(1, "\n".join(["x"] * 60)), (2, "\n\n  ")], "i int, content string")
    got = [(r["i"], r["start_line"], r["end_line"]) for r in text.line_windows(df, 50, 5).orderBy("i", "start_line").collect()]
    assert got == [(1, 1, 50), (1, 46, 60)]


def test_merge_keeps_highest_risk_even_info(spark):
    rows = [(0, 1, 5, "r1", "info", 0.5, "c", "f", "s"), (1, 1, 5, "r2", "critical", 0.4, "d", "f", "s"), (2, 2, 5, "r1", "info", 0.1, "c", "f", "s")]
    sites = spark.createDataFrame(rows, "seq int, unit_id int, line_start int, rule_id string, risk_level string, confidence double, category string, file_path string, symbol string")
    got = {r["unit_id"]: r for r in rules.merge_sites(sites).collect()}
    assert got[1]["risk_level"] == "critical" and got[1]["rule_ids"] == ["r1", "r2"] and got[1]["category"] == "c" and got[1]["confidence"] == 0.5
    assert got[2]["risk_level"] == "info"


def test_prescan_takes_the_first_fifty(spark):
    sites = spark.range(51).select(F.col("id").alias("seq"), F.lit("high").alias("risk_level"), F.lit(0.9).alias("confidence"), F.lit("x").alias("category"))
    assert rules.prescan(sites).count() == 50


@pytest.mark.parametrize("old, new, expected", [([("a", "1"), ("b", "1"), ("c", "1")], [("a", "1"), ("b", "2"), ("d", "1")], {"a": "unchanged", "b": "modified", "c": "deleted", "d": "new"}), ([], [("a", "1")], {"a": "new"}), ([("a", "1")], [], {"a": "deleted"})])
def test_changes(spark, old, new, expected):
    schema = "path string, hash string"
    got = incremental.changes(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema))
    assert {r["path"]: r["status"] for r in got.collect()} == expected


def test_dedup_collapses_white_space(spark):
    units = spark.createDataFrame([(1, "f1", "a  b\n"), (2, "f2", " a b"), (3, "f1", "c")], "unit_id int, file_path string, code string")
    got = sorted((r["canonical"], r["n_units"], r["n_files"]) for r in incremental.dedup_content(units).collect())
    assert got == [(1, 2, 2), (3, 1, 1)]


def test_eviction_over_capacity(spark):
    entries = spark.createDataFrame([(i, i // 2) for i in range(30)], "id int, accessed_at int")
    assert sorted(r["id"] for r in incremental.evict(entries, 20, 30).collect()) == list(range(10, 30))
    assert incremental.evict(entries, 40, 30).count() == 30
    assert incremental.evict(entries, 29, 30).count() == 28  # a tenth of the capacity


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "t"), ("c", "t"), ("a", "t")], "src string, dst string")


def test_simple_paths(spark, edges):
    starts, targets = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("t",)], "id string")
    got = sorted("".join(r["path"]) for r in graph.simple_paths(edges, starts, targets, 4).collect())
    assert got == ["abct", "abt", "at"]
    assert sorted("".join(r["path"]) for r in graph.simple_paths(edges, starts, targets, 2).collect()) == ["at"]


def test_reach_and_levels(spark, edges):
    got = {r["id"]: r["depth"] for r in graph.reach(edges, spark.createDataFrame([("a",)], "id string"), 5).collect()}
    assert got == {"a": 0, "b": 1, "t": 1, "c": 2}
    nodes = spark.createDataFrame([(x,) for x in "abct"], "id string")
    assert {r["id"]: r["level"] for r in graph.levels(edges, nodes).collect()} == dict.fromkeys("abct")
    dag = edges.where("src != 'c' or dst != 'a'")
    assert {r["id"]: r["level"] for r in graph.levels(dag, nodes).collect()} == {"a": 0, "b": 1, "c": 2, "t": 3}


def test_call_resolution(spark):
    nodes = spark.createDataFrame([("n1", "run", "a.py", "py"), ("n2", "run", "b.py", "py"), ("n3", "go", "c.go", "go")], "id string, name string, file_path string, language string")
    calls = spark.createDataFrame([("x", "b.py", "py", "run"), ("x", "b.py", "py", "go"), ("x", "b.py", "py", "nowhere")], "caller string, file_path string, language string, name string")
    got = {r["name"]: r["target"] for r in graph.resolve_calls(calls, nodes).collect()}
    assert got == {"run": "n2", "nowhere": "external:nowhere"}


def test_units_resolve_as_their_calls(spark):
    """Units that list their names give what their calls give, whether files or callers are shared or not, and shuffle no calls."""
    rng = random.Random(3)
    pick = lambda: rng.choice(["a.py", "b.py", "c.py", "d.go", None])
    nodes = spark.createDataFrame([(f"n{i}", rng.choice(["run", "go", "stop", "", None]), pick(), rng.choice(["py", "go", None])) for i in range(14)], "id string, name string, file_path string, language string")
    rows = [(rng.choice([None, "x", "y"]) if i % 4 == 0 else f"u{i}", pick() if i % 2 else f"f{i}", rng.choice(["py", "go", None]), rng.sample(["run", "go", "stop", "none", "u3", "x"], 3)) for i in range(60)]
    units = spark.createDataFrame(rows, "caller string, file_path string, language string, names array<string>")
    calls = units.select("caller", "file_path", "language", F.explode("names").alias("name"))
    same = lambda a, b: sorted(map(repr, a.collect())) == sorted(map(repr, b.select(a.columns).collect()))
    want = graph.resolve_calls(calls, nodes)
    assert all(same(graph.resolve_units(units, nodes, few, names), want) for few, names in ((50, 100), (1, 100), (50, 0)))
    assert same(graph.callers_of_units(units, ("stop",)), graph.callers_of(calls, ("stop",)))
    alone = units.where("caller like 'u%'").withColumn("file_path", F.col("caller"))
    assert same(graph.callers_of_units(alone), graph.callers_of(alone.withColumn("name", F.explode("names"))))
    assert "Expand" not in graph.callers_of_units(alone)._jdf.queryExecution().toString()


def test_validation_status(spark):
    rows = [(1, "a", 1, 2, True, True, 0, 0.9), (2, "gone", 1, 2, True, True, 0, 0.9), (3, "a", 5, 2, True, True, 0, 0.9), (4, "a", 1, 2, False, False, 0, 0.9), (5, "a", 1, 2, False, True, 0, 0.7), (6, "a", 1, 2, True, True, 0, 0.6)]
    findings = spark.createDataFrame(rows, "id int, file_path string, line_start int, line_end int, sink_ok boolean, chain_ok boolean, missing_evidence int, confidence double")
    got = {r["id"]: r["status"] for r in analytics.validate(findings, spark.createDataFrame([("a", 10)], "file_path string, n_lines int")).collect()}
    assert got == {1: "VALID", 2: "INVALID", 3: "INVALID", 4: "NEEDS_REVIEW", 5: "UNCERTAIN", 6: "NEEDS_REVIEW"}


def test_packing_skips_what_does_not_fit(spark):
    items = spark.createDataFrame([("s", 0, 1, 5), ("s", 1, 2, 50), ("s", 2, 3, 4)], "session string, priority int, id int, tokens int")
    assert sorted(r["id"] for r in analytics.pack_by_priority(items, "session", 10).collect()) == [1, 3]


def test_redaction(spark):
    df = spark.createDataFrame([("mail a.b@c.org, card 4111-1111-1111-1111, api_key = abcdefgh12",)], "t string")
    assert df.select(text.redact("t")).first()[0] == "mail [REDACTED:EMAIL], card [REDACTED:CARD], api_key = [REDACTED:KEY]"


def test_read_slice_within_bounds(spark):
    df = spark.createDataFrame([("1\n2\n3\n4",)], "content string")
    assert files.read_slice(df, 1, 2, context=1).first()["slice"] == "1\n2\n3"
    assert files.read_slice(df, 4, 9).first()["slice"] == "4"


def test_overlapping_chunks(spark):
    rng = random.Random(5)
    for _ in range(200):
        counts = [rng.choice((0, 1, 3, 9, 40)) for _ in range(rng.randint(1, 40))]
        spans = text.packed_spans(counts, 30, 8)
        assert spans[0][0] == 0 and spans[-1][1] == len(counts) and all(a < b for a, b in spans)
        for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
            # No gap; what is repeated fits the overlap, one line more doesn't; the next line didn't fit the chunk.
            assert a <= c <= b < d and sum(counts[c:b]) <= 8 and (c == a or sum(counts[c - 1 : b]) > 8)
            assert sum(counts[a : b + 1]) > 30
    content = "\n".join("x" * 40 for _ in range(9))
    df = spark.createDataFrame([(1, content), (2, ""), (3, None)], "i long, content string")
    found = [(r["i"], r["start_line"], r["end_line"], r["chunk"]) for r in text.overlapping_chunks(df, 40, 10).orderBy("i", "chunk_index").collect()]
    expected = [(1, a, b, "\n".join(["x" * 40] * (b - a + 1))) for a, b in ((1, 4), (4, 7), (7, 9))]
    assert found == [*expected, (2, 1, 1, "")]


def test_md5_embedding_of_two_words(spark):
    place = lambda w: int(hashlib.md5(w.encode()).hexdigest(), 16)
    expected = [0.0] * 10
    for w, weight in (("red", 1), ("fox", 1), ("red fox", 0.5)):
        expected[place(w) % 10] += weight * (1 - 2 * (place(w) // 10 % 2))
    norm = math.sqrt(sum(x * x for x in expected))
    df = spark.createDataFrame([("Red\tFOX",), ("",), (None,)], "t string").select(md5_embedding(10)("t").alias("e"))
    got = [r["e"] for r in df.collect()]
    assert got[0] == pytest.approx([x / norm for x in expected]) and got[1] == got[2] == [0.0] * 10


def test_blended_rerank_keeps_local_scores_of_rows_without_others(spark):
    df = spark.createDataFrame([("a", 0.9, 0.1), ("b", 0.8, None), ("c", 0.7, 1.0), ("d", 0.6, 1.0), ("e", 0.5, 1.0)], "k string, score double, other double")
    found = search.blended_rerank(df, F.col("other"), "k", 2, (0.5, 0.5)).collect()
    assert [(r["k"], r["score"], r["rank"]) for r in found] == [("c", 0.85, 1), ("b", 0.8, 2)]
    assert search.blended_rerank(df.limit(0), F.col("other"), "k", 2).count() == 0


def test_calls_match_patterns_by_name_or_last_part(spark):
    calls = spark.createDataFrame([(1, "os.system"), (2, "system"), (3, "systemd"), (4, None)], "i long, callee string")
    patterns = [("p", "shell", "high", ("python",), ("system",)), ("q", "shell", "low", (), ("system",)), ("r", "other", "high", (), ("os.system",))]
    found = lambda **k: sorted((r["i"], r["pattern_id"]) for r in rules.match_calls(calls, patterns, **k).collect())
    assert found() == [(1, "p"), (1, "q"), (1, "r"), (2, "p"), (2, "q")]
    assert found(language="php", categories=["shell"]) == [(1, "q"), (2, "q")] and found(min_severity="critical") == []


def test_cwe_ids_of_text_list_and_nothing(spark):
    df = spark.createDataFrame([('{"cwe": "CWE-79"}', ["CWE-9", "x"]), ('{"cwe": ["CWE-22", "CWE-79"]}', ["CWE-79"]), ("{bad", []), (None, ["CWE-1"])], "m string, t array<string>")
    assert [r[0] for r in df.select(C.cwe_ids("m", "t")).collect()] == [["CWE-79", "CWE-9"], ["CWE-22", "CWE-79"], [], ["CWE-1"]]


def test_predecessor_of_wide_rows_skips_none(spark):
    # Rows wide enough that adaptive execution merges ranges of keys and ranges of rows differently.
    df = spark.range(3000).select((F.col("id") * 3).alias("k"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 200).alias("wide"))
    found = text.predecessor(df, "k").join(df.select("k"), "k")
    assert found.count() == 2999 and found.select("k").distinct().count() == 2999
