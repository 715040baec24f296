"""The rule index against all rules on all names, and line ranges against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import intervals, rule_index

NAMES = ["os.system", "system", "exec", "pcntl_exec", "execute", "my_system_call", "é.query", "query", "Query", "", "a", "sys", None, "s*m", "u.GetUser"]
PATTERNS = ["system", "prefix:sys", "suffix:exec", "contains:sys", "regex:exec|eval", "regex:que?ry$", "regex:.*user", "regex:(bad", "regex:[Qq]uery", "regex:sys+tem", "prefix:é", "contains:s", "contains:system_c", "suffix:y", "exec", "regex:s\\*m", "prefix:a:b", "regex:", None, "query", "query"]


def matches(name, pattern):
    kind, _, text = pattern.partition(":") if re.match("(prefix|suffix|contains|regex):", pattern) else ("exact", "", pattern)
    try:
        return {"exact": lambda: name == text, "prefix": lambda: name.startswith(text), "suffix": lambda: name.endswith(text), "contains": lambda: text in name, "regex": lambda: bool(re.match(f"(?:{text})", name))}[kind]() and kind
    except re.error:
        return False


def test_index_finds_what_all_rules_find(spark):
    names = spark.createDataFrame([(i, n) for i, n in enumerate([*NAMES, "system"])], "i int, name string")
    rules = spark.createDataFrame([(f"r{k:02d}", p) for k, p in enumerate(PATTERNS)], "rule_id string, pattern string")
    got = {(r["i"], r["rule_id"], r["kind"]) for r in rule_index.lookup(names, "name", rule_index.rule_index(rules)).collect()}
    want = {(i, f"r{k:02d}", m) for i, n in enumerate([*NAMES, "system"]) for k, p in enumerate(PATTERNS) if n is not None and p is not None and (m := matches(n, p))}
    assert got == want


def test_exact_matches_come_first_and_languages_count(spark):
    names = spark.createDataFrame([("query", "php"), ("query", "go")], "name string, language string")
    rules = spark.createDataFrame([("a", "prefix:que", "php"), ("b", "query", "php"), ("b", "contains:u", "php"), ("c", "query", "go")], "rule_id string, pattern string, language string")
    rows = rule_index.lookup(names, "name", rule_index.rule_index(rules), by=("language",)).orderBy("language", "place").collect()
    assert [(r["language"], r["rule_id"], r["kind"], r["place"]) for r in rows] == [("go", "c", "exact", 1), ("php", "b", "exact", 1), ("php", "a", "prefix", 2)]


def test_a_hundred_thousand_rules(spark):
    k = F.col("id")
    rules = spark.range(100_000).select(F.concat(F.lit("r"), k).alias("rule_id"), F.concat(F.element_at(F.array(*map(F.lit, ("", "prefix:", "suffix:", "contains:", "regex:"))), (k % 5 + 1).cast("int")), F.lit("fn"), k).alias("pattern"))
    names = spark.range(300).select(F.concat(F.lit("fn"), k * 331).alias("name"))
    plan = rule_index.lookup(names, "name", rule_index.rule_index(rules))
    got = {(r["name"], r["rule_id"]) for r in plan.select("name", "rule_id").collect()}
    want = set()
    for n in (f"fn{i * 331}" for i in range(300)):
        digits = n[2:]
        for size in range(1, len(digits) + 1):  # names hold fn once, so all but a whole name or its beginning fails
            if digits[:size] == "0" and size > 1:
                break
            key = int(digits[:size])
            if key % 5 in (1, 3, 4) or size == len(digits):
                want.add((n, f"r{key}"))
    assert got == want


def ranges(spark, n, most, width, seed):
    r = random.Random(seed)
    rows = [(k, r.choice("ab"), (s := r.randint(0, most)), s + r.randint(0, width), round(r.random(), 3), r.choice(["x", "y", "z"])) for k in range(n)]
    return rows, spark.createDataFrame(rows, "seq int, file_path string, start_line int, end_line int, score double, source string")


@pytest.mark.parametrize("most, width, stretch", [(300, 5, 10), (300, 60, 7), (50, 3, 1000), (5000, 9, 100)])
def test_runs_and_pairs(spark, most, width, stretch):
    rows, df = ranges(spark, 250, most, width, most + stretch)
    over = lambda a, b: a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]
    assert {(r["a"], r["b"]) for r in intervals.overlapping_pairs(df, "seq", stretch).collect()} == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and over(a, b)}
    run = {}
    for f in "ab":
        far = begin = None
        for x in sorted((x for x in rows if x[1] == f), key=lambda x: x[2]):
            begin = x[2] if far is None or x[2] > far else begin
            far = x[3] if far is None else max(far, x[3])
            run[x[0]] = begin
    assert {r["seq"]: r["run"] for r in intervals.overlap_runs(df, stretch).collect()} == run


def test_merge_is_the_fold_of_the_whole_file(spark):
    rows, df = ranges(spark, 300, 150, 4, 9)
    want = sorted((f, *x) for f in "ab" for x in intervals.merged_results([r[2:] for r in rows if r[1] == f]))
    got = sorted(tuple(r) for r in intervals.hybrid_merge(df, stretch=20).collect())
    assert [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want] and [r[3] for r in got] == pytest.approx([r[3] for r in want])


def test_the_fold_by_hand():
    assert intervals.merged_results([(1, 9, 0.5, "v"), (1, 9, 0.4, "k"), (8, 20, 0.6, "v"), (30, 31, 0.1, "k"), (8, 20, 0.9, "k")]) == [(8, 20, 0.9, "k"), (30, 31, 0.1, "k")]


def test_empty_ranges(spark):
    none = spark.createDataFrame([], "seq int, file_path string, start_line int, end_line int, score double, source string")
    assert intervals.hybrid_merge(none).count() == 0 and intervals.overlapping_pairs(none, "seq").count() == 0
    odd = spark.createDataFrame([(1, None, 1, 2, 0.1, "x"), (2, "a", None, 3, 0.1, "x")], none.schema)
    assert [r["run"] for r in intervals.overlap_runs(odd).collect()] == [None, None] and intervals.hybrid_merge(odd).count() == 0


def test_expressions_are_found_by_their_rarest_part(spark):
    assert rule_index._runs("Customer#0+12[0-4]?34x*y+z{2}$") == ["Customer#0", "12", "34", "y"]
    assert rule_index._runs(r"a\d1") == rule_index._runs("a|b") == rule_index._runs("(ab)?c") == []
    names = spark.createDataFrame([(i, f"Name#{i:06d}") for i in range(300)], "i int, name string")
    rules = spark.createDataFrame([(f"R{k}", f"regex:Name#0+{k}[0-4]?$") for k in range(1, 300)], "rule_id string, pattern string")
    index = rule_index.rule_index(rules)
    got = {(r["i"], int(r["rule_id"][1:])) for r in rule_index.lookup(names, "name", index).collect()}
    assert got == {(i, k) for i in range(300) for k in range(1, 300) if i == k or (i // 10 == k and i % 10 < 5)}
    keys = rule_index._rarest(index.select("rule_id", "kind", "text", "key"), names.select(F.col("name").alias("_name")))
    assert keys.where("where = 'start'").count() == 0  # all names begin alike


def test_no_side_that_grows_is_broadcast(spark):
    names = spark.range(2_000).select("id", F.format_string("Name#%06d", "id").alias("name"))
    rules = spark.range(2_000).select(F.format_string("R%04d", "id").alias("rule_id"), F.concat(F.when(F.col("id") % 2 == 0, "contains:0").otherwise("regex:Name#0+"), F.col("id") % 10).alias("pattern"))
    found = rule_index.lookup(names, "name", rule_index.rule_index(rules))
    # Each of the ten patterns is that of 200 rules, more than travel in a row.
    want = {i: sum(200 for k in range(10) if (f"0{k}" in f"{i:06d}" if k % 2 == 0 else f"{i:06d}".lstrip("0").startswith(str(k)))) for i in range(2_000)}
    got = {r["id"]: (r["n"], r["most"], r["rules"]) for r in found.groupBy("id").agg(F.count("*").alias("n"), F.max("place").alias("most"), F.count_distinct("rule_id").alias("rules")).collect()}
    assert got == {i: (n, n, n) for i, n in want.items() if n}
    found.collect()
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
