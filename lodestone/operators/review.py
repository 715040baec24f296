"""Review of code and findings: checklists, verification in stages, checks of model answers, parameters that a framework taints, parsers that fall
back, similar structures.

Rules are literal expressions on a row, so checklists and checks of answers need no join with the rules; what relates rows is joins on equality.
"""

from __future__ import annotations

import ast
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from . import parsing, property_graph, search, tree


@dataclass(frozen=True)
class CheckItem:
    """patterns ought to stand in the code, anti_patterns not; case is ignored."""

    name: str
    severity: str
    patterns: tuple[str, ...] = ()
    anti_patterns: tuple[str, ...] = ()


def _hits(code: Column, patterns: Sequence[str]) -> Column:
    return sum((F.coalesce(code.rlike(f"(?i)(?:{p})"), F.lit(False)).cast("int") for p in patterns), F.lit(0))


def _passed(item: CheckItem, found: Column, bad: Column) -> Column:
    """No anti-pattern, and of the patterns, if any, one at least and half at least."""
    return (bad == 0) & ((found > 0) & (2 * found >= len(item.patterns)) if item.patterns else F.lit(True))


def checklist(units: DataFrame, items: Sequence[CheckItem], base_risk: str = "medium") -> DataFrame:
    """units with checks (name, severity, passed, found, missing, anti for each item) and risk_level: critical where a critical check or two high
    ones fail, high where one high does, the higher of base_risk and medium where another does, else low. Null code holds no pattern."""
    code, checks = F.col("code"), []
    for i in items:
        found, bad = _hits(code, i.patterns), _hits(code, i.anti_patterns)
        checks.append(F.struct(F.lit(i.name).alias("name"), F.lit(i.severity).alias("severity"), _passed(i, found, bad).alias("passed"), found.alias("found"), (len(i.patterns) - found).alias("missing"), bad.alias("anti")))
    failed = lambda s: F.size(F.filter("checks", lambda c: ~c["passed"] & (c["severity"] == s)))
    risk = F.when((failed("critical") > 0) | (failed("high") > 1), "critical").when(failed("high") > 0, "high")
    other = C.risk_name(F.greatest(C.risk_rank(F.lit(base_risk)), C.risk_rank(F.lit("medium"))))
    return units.withColumn("checks", F.array(*checks)).withColumn("risk_level", risk.when(F.exists("checks", lambda c: ~c["passed"]), other).otherwise("low"))


#: Categories that are verified in depth at once.
HIGH_RISK = ("command_injection", "code_injection", "sql_injection", "deserialization", "rce", "xxe", "ssrf")


def verify_stages(findings: DataFrame, contexts: DataFrame | None = None) -> DataFrame:
    """findings(id, category, risk_level, triage, deep, ...) with stages, the stages that each goes through.

    triage (keep, drop or need_more_context) and deep (vulnerable, false_positive or another) are what a judge says at that stage. Triage is left
    out for categories of HIGH_RISK and high risks; what it drops goes no further; a patch is asked for what is vulnerable. With contexts(id,
    context), one row for each id, those that need more context get theirs, the others null. A null verdict of triage keeps.
    """
    category, risk = F.lower(F.coalesce("category", F.lit(""))), F.lower(F.coalesce("risk_level", F.lit("")))
    skipped = category.isin(*HIGH_RISK) | risk.isin("critical", "high")
    dropped = ~skipped & F.coalesce(F.col("triage") == "drop", F.lit(False))
    patch = ~dropped & F.coalesce(F.col("deep") == "vulnerable", F.lit(False))
    stages = F.array_compact(F.array(F.when(~skipped, "triage"), F.when(~dropped, "deep_verify"), F.when(patch, "patch_suggest")))
    out = findings.withColumn("stages", stages)
    if contexts is None:
        return out
    asks = F.array_contains("stages", "triage") & F.coalesce(F.col("triage") == "need_more_context", F.lit(False))
    # What doesn't ask isn't joined: rows without a key would meet in one task.
    given = contexts.select(F.col("id").alias("asked"), "context")
    joined = out.where(asks).join(given, F.col("id") == F.col("asked"), "left").drop("asked")
    return joined.unionByName(out.where(~asks).withColumn("context", F.lit(None).cast(contexts.schema["context"].dataType)))


def stage_counters(verified: DataFrame) -> DataFrame:
    """One row of counts over verify_stages: triage's and the deep stage's, by what they said."""
    at = lambda s: F.array_contains("stages", s)
    said = lambda c, v: F.coalesce(F.col(c) == v, F.lit(False))
    count = lambda c, name: F.count_if(c).alias(name)
    other = ~said("triage", "drop") & ~said("triage", "need_more_context")
    return verified.agg(
        count(at("triage"), "triage_total"), count(at("triage") & said("triage", "drop"), "triage_drop"), count(at("triage") & said("triage", "need_more_context"), "triage_need_context"), count(at("triage") & other, "triage_keep"),
        count(at("deep_verify"), "deep_verify_total"), count(at("deep_verify") & said("deep", "vulnerable"), "deep_verify_confirmed"), count(at("deep_verify") & said("deep", "false_positive"), "deep_verify_false_positive"),
        count(at("patch_suggest"), "patch_total"),
    )


def salvaged_json(content: Column | str) -> Column:
    """The first of these that is a JSON object, as text: the whole, each fenced json block, each fenced block, the widest braces; else null."""
    c = F.col(content) if isinstance(content, str) else content
    every = lambda p: F.regexp_extract_all(c, F.lit(p), F.lit(1))
    tried = F.concat(F.array(c), every(r"(?s)```json\s*(.*?)\s*```"), every(r"(?s)```\s*(.*?)\s*```"), every(r"(?s)(\{.*\})"))
    fits = F.filter(tried, lambda x: x.rlike(r"^\s*\{") & F.try_parse_json(x).isNotNull())
    return F.when(c.isNotNull(), F.get(fits, F.lit(0)))


def check_answers(answers: DataFrame, files: DataFrame, required: Sequence[str], allowed: dict[str, Sequence[str]], least: float = 0.5) -> DataFrame:
    """answers(content, ...) with result, warnings and the fields file, line, message, confidence of the object in content.

    result: invalid_json without an object; hallucination where file isn't one of files(path, n_lines); schema_error where a field of required is
    absent or null, or one of allowed has another value; else valid. warnings: low_confidence below least, invalid_line outside of the file.
    Paths are compared with slashes for backslashes. files has one row for each path.
    """
    field = lambda name, kind: F.try_variant_get("answer", f"$.{name}", kind)
    read = answers.withColumn("json", salvaged_json("content")).withColumn("answer", F.try_parse_json("json"))
    lacks = [field(f, "string").isNull() for f in required]
    other = [F.coalesce(~field(f, "string").isin(*values), F.lit(False)) for f, values in allowed.items()]
    wrong = F.exists(F.array(*lacks, *other, F.lit(False)), lambda x: x)
    read = read.withColumn("schema_error", wrong)
    read = read.withColumns({"file": F.replace(field("file", "string"), F.lit("\\"), F.lit("/")), "line": field("line", "long"), "message": field("message", "string"), "confidence": field("confidence", "double")})
    known = files.select(F.col("path").alias("file"), F.col("n_lines").alias("file_lines"), F.lit(True).alias("known"))
    joined = read.join(known, "file", "left")
    missing = F.col("file").isNotNull() & F.col("known").isNull()
    result = F.when(F.col("json").isNull(), "invalid_json").when(missing, "hallucination").when(F.col("schema_error"), "schema_error").otherwise("valid")
    warnings = F.array_compact(F.array(F.when(F.col("confidence") < least, "low_confidence"), F.when(F.col("known") & ((F.col("line") < 1) | (F.col("line") > F.col("file_lines"))), "invalid_line")))
    return joined.select(*answers.columns, result.alias("result"), warnings.alias("warnings"), "file", "line", "message", "confidence")


#: What marks a parameter of a request.
SOURCES = ("Body", "Query", "Path", "Header", "Cookie", "Form")


def tainted_parameters(units: DataFrame) -> DataFrame:
    """Each parameter of units(decorators, signature, ...) with tainted: a decorator names one of SOURCES, or is a route with <parameter>; the
    parameter has a type and one of SOURCES as its default; it is request or req. Null decorators are none; a null signature gives no row."""
    inner = F.regexp_extract("signature", r"(?s)^[^(]*\((.*)\)[^()]*$", 1)
    flat = F.regexp_replace(F.regexp_replace(inner, r"\([^()]*\)", ""), r"[\[(][^\[\]()]*[\])]", "")
    names = F.filter(F.transform(F.split(flat, ","), lambda a: F.regexp_extract(a, r"^[\s*]*([A-Za-z_]\w*)", 1)), lambda a: a != "")
    typed = F.regexp_extract_all("signature", F.lit(rf"(\w+)\s*:\s*\w+\s*=\s*(?:{'|'.join(SOURCES)})\s*\("), F.lit(1))
    rows = units.withColumn("typed", typed).withColumn("parameter", F.explode(names))
    marks = F.exists(F.coalesce("decorators", F.array().cast("array<string>")), lambda d: d.rlike("|".join(SOURCES)) | (F.contains(F.lower(d), F.lit("route")) & F.contains(d, F.concat(F.lit("<"), "parameter", F.lit(">")))))
    return rows.withColumn("tainted", F.coalesce(marks, F.lit(False)) | F.array_contains("typed", F.col("parameter")) | F.lower("parameter").isin("request", "req")).drop("typed")


_HEAD = r"^\s*(?:async\s+def|def|class)\s+([A-Za-z_]\w*)"


def head_units(files: DataFrame) -> DataFrame:
    """file_id, symbol, start_line, end_line: functions and classes by their heads at any depth; each goes to the line before the next head."""
    rows = files.select("file_id", F.size(C.lines(F.rtrim("content", F.lit(" \t\r\n")))).alias("all"), F.posexplode(C.lines("content")).alias("i", "line")).where(F.col("line").rlike(_HEAD))
    after = F.lead("i").over(Window.partitionBy("file_id").orderBy("i"))
    return rows.select("file_id", F.regexp_extract("line", _HEAD, 1).alias("symbol"), (F.col("i") + 1).alias("start_line"), F.coalesce(after, "all").alias("end_line"))


def _tree_result(file_id: int, content: str | None) -> list[tuple]:
    """file_id, n_units, covered, errors of a file's top-level units, parsed once."""
    try:
        units = [n for n in ast.parse(content or "").body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))]
    except (SyntaxError, ValueError):
        return [(file_id, content, 0, 0, 1)]
    return [(file_id, content, len(units), sum(n.end_lineno - n.lineno + 1 for n in units), 0)]


def parse_results(files: DataFrame) -> DataFrame:
    """file_id, source, n_units, coverage, errors for each parser of each file: tree, then regex. coverage: part of the lines between the first
    and the last line of top-level units of the tree, or of heads, as head_units has them. Files stay in their rows: no join, no shuffle."""
    tree_row = "file_id long, content string, n_units long, covered long, errors int"
    parsed = files.select("file_id", "content").mapInPandas(lambda batches: parsing.frames(batches, _tree_result, tree_row), tree_row)
    n_lines = F.greatest(F.size(C.lines(F.rtrim("content", F.lit(" \t\r\n")))), F.lit(1))
    heads = F.filter(F.transform(C.lines("content"), lambda x, i: F.when(x.rlike(_HEAD), i)), lambda i: i.isNotNull())
    # Each head goes to the line before the next, the last to the end: together all lines from the first head on.
    last = F.size(C.lines(F.rtrim("content", F.lit(" \t\r\n"))))
    both = parsed.select("file_id", "n_units", "covered", "errors", n_lines.alias("n_lines"), last.alias("last"), F.coalesce(heads, F.array().cast("array<int>")).alias("heads"))
    covered = F.when(F.size("heads") > 0, (F.col("last") - F.col("heads")[0]).cast("long")).otherwise(F.lit(0).cast("long"))
    row = lambda source, n, lines, errors: F.struct(F.lit(source).alias("source"), n.cast("long").alias("n_units"), F.least(F.lit(1.0), lines / F.col("n_lines")).alias("coverage"), errors.cast("int").alias("errors"))
    rows = F.array(row("tree", F.col("n_units"), F.col("covered"), F.col("errors")), row("regex", F.size("heads"), covered, F.lit(0)))
    return both.select("file_id", F.inline(rows))


def best_results(results: DataFrame, order: Sequence[str] = ("tree", "regex")) -> DataFrame:
    """The best row of results(file_id, source, n_units, coverage, errors) for each file: by coverage, units, fewer errors, then by order of source."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    best = Window.partitionBy("file_id").orderBy(F.desc("coverage"), F.desc("n_units"), "errors", place)
    return results.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


#: A class of equal features is gone through in so many parts.
PARTS = 64
BRANCHES = ("if", "loop", "while", "try", "case")


def structure_features(nodes: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """file_id, features of nodes(file_id, node_id, parent_id, node_type): the number of nodes of each of kinds, one more than the branches, and
    the greatest depth below the root."""
    depth = tree.ways(nodes.withColumnRenamed("file_id", "tree_id")).groupBy(F.col("tree_id").alias("file_id")).agg((F.max(F.size("way")) - 1).alias("depth"))
    counts = nodes.groupBy("file_id").agg(*(F.count_if(F.col("node_type") == k).cast("double").alias(f"n_{i}") for i, k in enumerate(kinds)), (F.count_if(F.col("node_type").isin(*BRANCHES)) + 1).cast("double").alias("complexity"))
    return counts.join(depth.hint("merge"), "file_id").select("file_id", F.array(*(f"n_{i}" for i in range(len(kinds))), "complexity", F.col("depth").cast("double")).alias("features"))


def file_structures(files: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """The structure_features of files(file_id, content), one row for each file_id, counted where a file is parsed."""

    def features(file_id: int, content: str | None) -> Iterator[tuple]:
        depth: list[int] = []
        nodes = property_graph.statement_nodes(file_id, content)
        for _, _, parent, *_ in nodes:  # a parent stands before its children
            depth.append(0 if parent is None else depth[parent] + 1)
        n = Counter(kind for _, _, _, _, kind, *_ in nodes)
        if nodes:
            yield file_id, [*(float(n[k]) for k in kinds), 1.0 + sum(n[k] for k in BRANCHES), float(max(depth))]

    return property_graph.per_file(files, features, "file_id long, features array<double>")


def similar_structures(features: DataFrame, asked: Column, k: int = 10) -> DataFrame:
    """query_id, file_id, score, rank: for each file of features(file_id, features) that asked selects, the k others of the highest cosine, ties to the
    smaller id.

    Files of equal features are one class, which takes part once, by its smallest id, and carries its k + 1 smallest ids: the k best files lie in
    the k + 1 best classes. So classes are compared, of which there are far fewer than files, and no class is gathered.
    """
    classes = features.groupBy("features").agg(F.min("file_id").alias("vec_id"))
    # The smallest ids of a class by parts first: a class may hold most files.
    part = Window.partitionBy("features", F.pmod(F.xxhash64("file_id"), F.lit(PARTS))).orderBy("file_id")
    few = features.withColumn("n", F.row_number().over(part)).where(F.col("n") <= k + 1)
    smallest = few.withColumn("n", F.row_number().over(Window.partitionBy("features").orderBy("file_id"))).where(F.col("n") <= k + 1)
    members = smallest.join(classes, "features").select("vec_id", "file_id")
    mine = features.where(asked).select(F.col("file_id").alias("query_id"), "features").join(classes, "features")
    heads = mine.groupBy("vec_id").agg(F.first("features").alias("q")).select(F.col("vec_id").alias("query_id"), "q")
    near = search.vector_top_k(classes.select("vec_id", F.col("features").alias("embedding")), heads, k).select(F.col("query_id").alias("head"), "vec_id", "score")
    own = heads.select(F.col("query_id").alias("head"), F.col("query_id").alias("vec_id"), F.lit(1.0).alias("score"))
    found = near.unionByName(own).join(members, "vec_id").select("head", "file_id", "score")
    # k + 1 best of a class of queries first; each query then leaves itself out.
    best = Window.partitionBy("head").orderBy(F.desc("score"), "file_id")
    short = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    rows = mine.select("query_id", F.col("vec_id").alias("head")).join(short, "head").where(F.col("file_id") != F.col("query_id"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "file_id")
    return rows.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "file_id", "score", "rank")
