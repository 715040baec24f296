"""Rules against units: matching by kind of pattern, sites, their merge, statistics, selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def pattern_rows(rules: Sequence[tuple]) -> list[tuple]:
    """(rule_id, category, risk, kind, text) of rules (id, category, risk, [patterns]); a pattern is `kind:text` or plain text for exact."""
    out = []
    for rule_id, category, risk, patterns in rules:
        for p in patterns:
            kind, _, text = p.partition(":")
            known = kind in ("prefix", "suffix", "contains", "regex")
            out.append((rule_id, category, risk, kind if known else "exact", text if known else p))
    return out


def match_names(names: DataFrame, name: str, rules: Sequence[tuple]) -> DataFrame:
    """names with rule_id for each rule that matches. Exact patterns join by equality; the others are one expression for each rule."""
    rows = pattern_rows(rules)
    exact = [(r[0], r[4]) for r in rows if r[3] == "exact"]
    found = names.withColumn("rule_ids", F.array_distinct(F.concat(_exact(name, exact), F.array_compact(F.array(*[F.when(_matches(name, kind, text), F.lit(rule)) for rule, _, _, kind, text in rows if kind != "exact"])))))
    return found.select("*", F.explode("rule_ids").alias("rule_id")).drop("rule_ids")


def _exact(name: str, pairs: Sequence[tuple[str, str]]) -> Column:
    """The rules of an exact name, looked up in a map literal."""
    by_name: dict[str, list[str]] = {}
    for rule, text in pairs:
        by_name.setdefault(text, []).append(rule)
    if not by_name:
        return F.array().cast("array<string>")
    table = F.create_map(*[x for text, ids in by_name.items() for x in (F.lit(text), F.array(*map(F.lit, ids)))])
    return F.coalesce(F.try_element_at(table, F.col(name)), F.array().cast("array<string>"))


def _matches(name: str, kind: str, text: str) -> Column:
    """Regular expressions are anchored at the start and tell case apart."""
    c = F.col(name)
    return {"prefix": c.startswith(text), "suffix": c.endswith(text), "contains": c.contains(text), "regex": c.rlike(f"^(?:{text})")}[kind]


def scan_units(units: DataFrame, rules: Sequence[tuple], confidence: float = 0.95) -> DataFrame:
    """A site for each rule and line of a unit that its pattern is found in: the rules are one array of structs in the plan,
    so a line is read once for all of them and no join is needed."""
    lines = units.select("unit_id", "file_path", "symbol", "language", F.posexplode(C.lines("code")).alias("i", "line"))
    hits = F.array_compact(
        F.array(*[F.when(F.lower("line").rlike(regex), F.struct(F.lit(r).alias("rule_id"), F.lit(c).alias("category"), F.lit(risk).alias("risk_level"))) for r, c, risk, regex in rules])
    )
    found = lines.withColumn("hit", F.explode(hits))
    return found.select("unit_id", "file_path", "symbol", "language", (F.col("i") + 1).cast("long").alias("line_start"), "hit.*", F.lit(confidence).alias("confidence"), F.substring("line", 1, 80).alias("snippet"))


def merge_sites(sites: DataFrame, seq: str = "seq") -> DataFrame:
    """One site for each unit and line: all rules, the highest risk, the highest confidence, the category of the first."""
    merged = sites.groupBy("unit_id", "line_start").agg(
        F.array_sort(F.collect_set("rule_id")).alias("rule_ids"),
        F.max(C.risk_rank("risk_level")).alias("risk_rank"),
        F.max("confidence").alias("confidence"),
        F.min_by("category", seq).alias("category"),
        F.min_by("file_path", seq).alias("file_path"),
        F.min_by("symbol", seq).alias("symbol"),
    )
    site_id = F.substring(F.md5(F.concat_ws(":", "file_path", F.col("line_start").cast("string"), "symbol").cast("binary")), 1, 8)
    return merged.withColumn("risk_level", C.risk_name("risk_rank")).withColumn("site_id", site_id)


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    """dimension, value, n: counts by each key alone and in all, in one pass."""
    sets = rows.groupingSets([[k] for k in keys] + [[]], *keys).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    n = len(keys)
    dimension, value = F.lit("total"), F.lit("")
    for i, k in enumerate(keys):
        # grouping_id has a 1 for each key that is left out
        this = F.col("g") == ((1 << n) - 1) ^ (1 << (n - 1 - i))
        dimension, value = F.when(this, F.lit(k)).otherwise(dimension), F.when(this, F.col(k).cast("string")).otherwise(value)
    return sets.select(dimension.alias("dimension"), value.alias("value"), "n")


def risk_summary(rows: DataFrame, level: str = "risk_level") -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(level) == r).alias(r) for r in reversed(C.RISKS)))


def category_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("risk_level") == "critical").alias("critical"), F.count_if(F.col("risk_level") == "high").alias("high"), F.count_distinct("file_path").alias("files")
    )


def prescan(sites: DataFrame, risks: Sequence[str] = ("high", "critical"), least: float = 0.5, most: int = 50, deny: Sequence[str] = ()) -> DataFrame:
    """Sites of the wanted risks and confidence, the first of each category in scan order."""
    kept = sites.where(F.col("risk_level").isin(*risks) & (F.col("confidence") >= least) & ~F.col("category").isin(*deny))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("category").orderBy("seq"))).where(F.col("place") <= most)


def page(rows: DataFrame, limit: int, offset: int = 0, *order: Column) -> DataFrame:
    """A page in a total order."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def vulnerabilities(units: DataFrame, kinds: Sequence[tuple[str, str, str, str, str]]) -> DataFrame:
    """kinds (name, severity, sink, source, context): a sink is needed; .8 with a source else .5, +.1 with context, +.05 over three hits, at most .95."""
    rows = []
    for name, severity, sink, source, context in kinds:
        sinks, sources = F.regexp_count(F.lower("code"), F.lit(sink)), F.regexp_count(F.lower("code"), F.lit(source))
        score = F.when(sources > 0, 0.8).otherwise(0.5) + F.when(F.lower("code").rlike(context), 0.1).otherwise(0.0) + F.when(sinks + sources > 3, 0.05).otherwise(0.0)
        rows.append(F.when(sinks > 0, F.struct(F.lit(name).alias("vuln_type"), F.lit(severity).alias("severity"), F.round(F.least(score, F.lit(0.95)), 6).alias("confidence"), (sinks + sources).cast("long").alias("hits"))))
    return units.select("unit_id", F.explode(F.array_compact(F.array(*rows))).alias("f")).select("unit_id", "f.*")


def scenarios(units: DataFrame, wanted: Sequence[tuple[str, Sequence[str], Sequence[str]]]) -> DataFrame:
    """(name, keywords, patterns): .3 of the keywords or two patterns are needed; confidence .4 + .3 share + .1 patterns, at most .9."""
    rows = []
    for name, words, patterns in wanted:
        hit = sum((F.contains(F.lower("code"), F.lit(w)).cast("int") for w in words), F.lit(0))
        regex = sum((F.lower("code").rlike(p).cast("int") for p in patterns), F.lit(0))
        share = hit / F.lit(len(words))
        score = F.round(F.least(F.lit(0.4) + F.lit(0.3) * share + F.lit(0.1) * regex, F.lit(0.9)), 6)
        rows.append(F.when((share >= 0.3) | (regex >= 2), F.struct(F.lit(name).alias("scenario"), F.round(share, 6).alias("keyword_share"), regex.cast("long").alias("pattern_hits"), score.alias("confidence"))))
    return units.select("unit_id", F.explode(F.array_compact(F.array(*rows))).alias("f")).select("unit_id", "f.*")


def candidates(units: DataFrame, rules: Sequence[tuple[str, str, str, str]], most: int = 100) -> DataFrame:
    """(rule_id, risk, type, text): the first rule whose text a unit holds; priority by risk and type; the highest few."""
    by_risk = {"info": 0.25, "low": 0.25, "medium": 0.5, "high": 0.75, "critical": 1.0}
    by_type = {"sink": 0.3, "source": 0.2, "sanitizer": 0.1}
    hits = F.array_compact(F.array(*[F.when(F.contains("code", F.lit(text)), F.struct(F.lit(i).alias("rule_id"), F.lit(min(1.0, round(by_risk[risk] + by_type[kind], 6))).alias("priority"))) for i, risk, kind, text in rules]))
    found = units.withColumn("hit", F.get(hits, F.lit(0))).where("hit is not null").select("unit_id", "file_path", "hit.*")
    return found.orderBy(F.desc("priority"), "unit_id").limit(most)


def sort_findings(findings: DataFrame, least: float, severity: str = "severity") -> DataFrame:
    """At least of that confidence, with their place by severity, then confidence, then id."""
    kept = findings.where(F.col("confidence") >= least)
    return kept.orderBy(C.risk_rank(severity).desc(), F.desc("confidence"), "id")


def match_calls(calls: DataFrame, patterns: Sequence[tuple], language: str | None = None, categories: Sequence[str] | None = None, min_severity: str = "info") -> DataFrame:
    """calls(callee, ...) with pattern_id, category, severity of each of patterns(id, category, severity, languages, callees) that
    names the callee or its last part. No languages: all. The patterns are literals of the caller, so their table is broadcast."""
    asked = [p for p in patterns if (language is None or not p[3] or language in p[3]) and (categories is None or p[1] in categories) and C.RISKS.index(p[2]) >= C.RISKS.index(min_severity)]
    names = calls.sparkSession.createDataFrame([(n, *p[:3]) for p in asked for n in dict.fromkeys(p[4])], "name string, pattern_id string, category string, severity string")
    named = calls.withColumn("name", F.explode(F.array_distinct(F.array("callee", F.substring_index("callee", ".", -1)))))
    return named.join(F.broadcast(names), "name").drop("name").distinct()
