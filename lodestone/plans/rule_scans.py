"""Rules on documents, and sink sites (events) merged, counted and chosen."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import rule_index, rules
from .query import SITES_SQL, UNITS_SQL, query, sites, table, units

#: Rules for the synthetic texts: id, category, risk, pattern on a lower-case line.
SCAN_RULES = (
    ("secret-key", "secrets", "critical", "(password|token|api_key) ?[:=]"),
    ("e-mail", "personal_data", "medium", "[a-z0-9.]+@[a-z0-9.]+"),
    ("card", "personal_data", "high", "[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}"),
    ("license", "license", "info", "licensed under"),
    ("insult", "language", "low", "(idiot|scum|trash)"),
)

_RULES_SQL = "rules(rule_id, category, risk_level, risk_rank, regex) as (values " + ", ".join(f"('{r}', '{c}', '{k}', {C.RISKS.index(k)}, '{p}')" for r, c, k, p in SCAN_RULES) + ")"
SCAN_SQL = f"""{UNITS_SQL}, {_RULES_SQL},
  ls as (select unit_id, file_path, symbol, unnest(range(1, len(l) + 1)) as n, l from (select *, string_split(code, chr(10)) as l from units)),
  found as (select unit_id, file_path, symbol, n::bigint as line_start, rule_id, category, risk_level, risk_rank, 0.95::double as confidence from ls join rules on regexp_matches(lower(l[n]), regex))"""


def scanned(spark, sf):
    return rules.scan_units(units(spark, sf), SCAN_RULES)


@query("g5_sink_scan", f"with {SCAN_SQL} select unit_id, line_start, rule_id, category, risk_level, confidence from found")
def g5(spark, sf):
    return scanned(spark, sf).select("unit_id", "line_start", "rule_id", "category", "risk_level", "confidence")


@query("flagship_risk_scan", f"""
with {SCAN_SQL}, m as (select unit_id, line_start, max(risk_rank) as r, count(distinct rule_id) as n_rules, min(category) as category from found group by unit_id, line_start)
select category, (['info', 'low', 'medium', 'high', 'critical'])[1 + r] as risk_level, count(*)::bigint as sites, count(distinct unit_id)::bigint as units, sum(n_rules)::bigint as rule_hits from m group by category, r""")
def flagship(spark, sf):
    merged = scanned(spark, sf).groupBy("unit_id", "line_start").agg(F.max(C.risk_rank("risk_level")).alias("r"), F.count_distinct("rule_id").alias("n_rules"), F.min("category").alias("category"))
    return merged.groupBy("category", C.risk_name("r").alias("risk_level")).agg(F.count(F.lit(1)).alias("sites"), F.count_distinct("unit_id").alias("units"), F.sum("n_rules").alias("rule_hits"))


@query("i1_merge_sites", f"""
with {SITES_SQL} select unit_id, line_start, array_to_string(list_sort(list_distinct(list(rule_id))), ',') as rule_ids, (['info', 'low', 'medium', 'high', 'critical'])[1 + max(risk_rank)] as risk_level, max(confidence) as confidence,
  arg_min(category, seq) as category, md5(any_value(file_path) || ':' || line_start || ':' || any_value(symbol))[1:8] as site_id from sites group by unit_id, line_start""")
def i1(spark, sf):
    return rules.merge_sites(sites(spark, sf)).select("unit_id", "line_start", F.array_join("rule_ids", ",").alias("rule_ids"), "risk_level", "confidence", "category", "site_id")


@query("i2_site_statistics", f"""
with {SITES_SQL} select 'category' as dimension, category as value, count(*)::bigint as n from sites group by 2 union all select 'risk_level', risk_level, count(*)::bigint from sites group by 2
union all select 'file_path', file_path, count(*)::bigint from sites group by 2 union all select 'total', '', count(*)::bigint from sites""")
def i2(spark, sf):
    return rules.counts_by(sites(spark, sf), "category", "risk_level", "file_path")


@query("i3_risk_summary", f"with {SITES_SQL} select count(*)::bigint as total, " + ", ".join(f"count(*) filter (risk_level = '{r}')::bigint as {r}" for r in C.RISKS) + " from sites")
def i3(spark, sf):
    return rules.risk_summary(sites(spark, sf))


@query("i4_category_summary", f"with {SITES_SQL} select category, count(*)::bigint as n, count(*) filter (risk_level = 'critical')::bigint as critical, count(*) filter (risk_level = 'high')::bigint as high, count(distinct file_path)::bigint as files from sites group by category")
def i4(spark, sf):
    return rules.category_summary(sites(spark, sf))


@query("f14_prescan", f"""
with {SITES_SQL} select seq, category, place from (select *, (row_number() over (partition by category order by seq))::int as place from sites where risk_level in ('high', 'critical') and confidence >= 0.5 and category <> 'view') where place <= 50""")
def f14(spark, sf):
    return rules.prescan(sites(spark, sf), deny=("view",)).select("seq", "category", "place")


@query("j16_sort_and_page", f"with {SITES_SQL} select seq, risk_level, file_path, line_start from sites order by risk_rank desc, file_path, line_start, seq limit 200 offset 40")
def j16(spark, sf):
    s = sites(spark, sf)
    return rules.page(s, 200, 40, C.risk_rank("risk_level").desc(), F.col("file_path"), F.col("line_start"), F.col("seq")).select("seq", "risk_level", "file_path", "line_start")


@query("f15_sort_findings", f"with {SITES_SQL} select seq as id, risk_level as severity, confidence from sites where confidence >= 0.7 ")
def f15(spark, sf):
    found = sites(spark, sf).select(F.col("seq").alias("id"), F.col("risk_level").alias("severity"), "confidence")
    return rules.sort_findings(found, 0.7)


NAME_RULES = (
    ("r-exact", "a", "high", ["Customer#000000007", "Customer#000000011"]),
    ("r-prefix", "b", "low", ["prefix:Customer#00000010"]),
    ("r-suffix", "b", "low", ["suffix:99"]),
    ("r-contains", "c", "medium", ["contains:0042"]),
    ("r-regex", "d", "critical", ["regex:Customer#0+[123]$"]),
)


@query("f1_name_patterns", """
select c_custkey, rule_id from customer, (values ('r-exact', 'c_name in'), ('r-prefix', ''), ('r-suffix', ''), ('r-contains', ''), ('r-regex', '')) v(rule_id, x)
where (rule_id = 'r-exact' and c_name in ('Customer#000000007', 'Customer#000000011')) or (rule_id = 'r-prefix' and starts_with(c_name, 'Customer#00000010')) or (rule_id = 'r-suffix' and ends_with(c_name, '99'))
  or (rule_id = 'r-contains' and contains(c_name, '0042')) or (rule_id = 'r-regex' and regexp_matches(c_name, '^(?:Customer#0+[123]$)'))""")
def f1(spark, sf):
    return rules.match_names(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", NAME_RULES).select("c_custkey", "rule_id")


@query("f2_indexed_lookup", """
select c_custkey, case when c_name in ('Customer#000000007', 'Customer#000000011') then 'exact' else 'scan' end as found_by from customer
where c_name in ('Customer#000000007', 'Customer#000000011') or starts_with(c_name, 'Customer#00000010') or ends_with(c_name, '99') or contains(c_name, '0042') or regexp_matches(c_name, '^(?:Customer#0+[123]$)')""")
def f2(spark, sf):
    found = rules.match_names(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", NAME_RULES)
    return found.groupBy("c_custkey").agg(F.when(F.bool_or(F.col("rule_id") == "r-exact"), "exact").otherwise("scan").alias("found_by"))


@query("f3_rule_filters", "select p_partkey, p_brand from part where p_type in ('ECONOMY', 'STANDARD') and p_size between 10 and 20")
def f3(spark, sf):
    return table(spark, sf, "part").where(F.array_contains(F.array(F.lit("ECONOMY"), F.lit("STANDARD")), F.col("p_type")) & F.col("p_size").between(10, 20)).select("p_partkey", "p_brand")


@query("f4_metadata_filter", "select event_id from events where event_type in ('error', 'click') and user_id = 8")
def f4(spark, sf):
    wanted = {"event_type": ["error", "click"], "user_id": 8}
    keep = F.lit(True)
    for k, v in wanted.items():
        keep = keep & (F.col(k).isin(*v) if isinstance(v, list) else F.col(k) == v)
    return table(spark, sf, "events").where(keep).select("event_id")


VULNS = (
    ("leak", "critical", "(password|token|secret) ?[:=]", "@[a-z0-9.]+[.]com", "licensed"),
    ("contact", "medium", "[a-z0-9.]+@[a-z0-9.]+", "[0-9]{3}-[0-9]{4}", "http"),
)


@query("g7_vulnerabilities", f"with {UNITS_SQL}, c as (select unit_id, lower(code) as code from units) " + " union all ".join(
    f"select unit_id, '{n}' as vuln_type, '{s}' as severity, round(least(case when len(regexp_extract_all(code, '{b}')) > 0 then 0.8 else 0.5 end::double + case when regexp_matches(code, '{c}') then 0.1 else 0.0 end::double + case when len(regexp_extract_all(code, '{a}')) + len(regexp_extract_all(code, '{b}')) > 3 then 0.05 else 0.0 end::double, 0.95), 6) as confidence, (len(regexp_extract_all(code, '{a}')) + len(regexp_extract_all(code, '{b}')))::bigint as hits from c where regexp_matches(code, '{a}')"
    for n, s, a, b, c in VULNS))
def g7(spark, sf):
    return rules.vulnerabilities(units(spark, sf), VULNS)


@query("g8_scenarios", f"""
with {UNITS_SQL}, c as (select unit_id, (contains(lower(code), 'license')::int + contains(lower(code), 'version')::int + contains(lower(code), 'password')::int) as hit, regexp_matches(lower(code), '[0-9]+[.][0-9]+')::int + regexp_matches(lower(code), 'apache')::int as p from units)
select unit_id, 'licensing' as scenario, round(hit / 3.0::double, 6) as keyword_share, p::bigint as pattern_hits, round(least(0.4::double + 0.3::double * (hit / 3.0::double) + 0.1::double * p, 0.9), 6) as confidence from c where hit / 3.0::double >= 0.3 or p >= 2""")
def g8(spark, sf):
    return rules.scenarios(units(spark, sf), [("licensing", ["license", "version", "password"], ["[0-9]+[.][0-9]+", "apache"])])


CANDIDATE_RULES = (("c-1", "critical", "sink", "password"), ("c-2", "high", "source", "token"), ("c-3", "low", "sink", "License"), ("c-4", "medium", "sanitizer", "the "))


@query("g6_candidates", f"""
with {UNITS_SQL} select unit_id, file_path, case when contains(code, 'password') then 'c-1' when contains(code, 'token') then 'c-2' when contains(code, 'License') then 'c-3' else 'c-4' end as rule_id,
  case when contains(code, 'password') then 1.0 when contains(code, 'token') then 0.95 when contains(code, 'License') then 0.55 else 0.6 end::double as priority
from units where contains(code, 'password') or contains(code, 'token') or contains(code, 'License') or contains(code, 'the ') order by priority desc, unit_id limit 100""")
def g6(spark, sf):
    return rules.candidates(units(spark, sf), CANDIDATE_RULES)


@query("f8_security_indicators", f"with {UNITS_SQL} select unit_id, regexp_matches(lower(code || symbol), 'password|token|secret|auth|exec') as indicated from units")
def f8(spark, sf):
    return units(spark, sf).select("unit_id", F.lower(F.concat("code", "symbol")).rlike("password|token|secret|auth|exec").alias("indicated"))


@query("f9_dangerous_operations", f"with {UNITS_SQL} select unit_id, contains(lower(code), 'trash') or contains(lower(code), 'delete') as deletes, contains(lower(code), 'token') or contains(lower(code), 'password') as credentials, not (contains(lower(code), 'trash') or contains(lower(code), 'delete') or contains(lower(code), 'token') or contains(lower(code), 'password')) as safe from units")
def f9(spark, sf):
    low = F.lower("code")
    groups = {"deletes": ("trash", "delete"), "credentials": ("token", "password")}
    flags = {g: F.lit(False) for g in groups}
    for g, words in groups.items():
        for w in words:
            flags[g] = flags[g] | F.contains(low, F.lit(w))
    rows = units(spark, sf).select("unit_id", *(f.alias(g) for g, f in flags.items()))
    return rows.withColumn("safe", ~(F.col("deletes") | F.col("credentials")))


@query("f10_auth_check", f"with {UNITS_SQL}, h as (select unit_id, len([x for x in ['token', 'password', 'login'] if contains(lower(code), x)]) as a, len([x for x in ['role', 'admin'] if contains(lower(code), x)]) as z from units) select unit_id, case when a > 0 and z > 0 then 'low' when a > 0 or z > 0 then 'medium' else 'high' end as risk from h")
def f10(spark, sf):
    hits = lambda words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("code"), w)))
    a, z = hits(("token", "password", "login")), hits(("role", "admin"))
    return units(spark, sf).select("unit_id", F.when((a > 0) & (z > 0), "low").when((a > 0) | (z > 0), "medium").otherwise("high").alias("risk"))


@query("f11_symbol_match", "select c_custkey, case when c_name = 'Customer#000000012' then 3 when ends_with(c_name, '.000000012') then 2 when contains(c_name, '12') then 1 else 0 end as level from customer")
def f11(spark, sf):
    name = F.col("c_name")
    return table(spark, sf, "customer").select("c_custkey", F.when(name == "Customer#000000012", 3).when(name.endswith(".000000012"), 2).when(name.contains("12"), 1).otherwise(0).alias("level"))


@query("f13_sink_listing", f"with {SITES_SQL} select seq, category, risk_level, count(*) over ()::bigint as total from sites where risk_level in ('critical', 'high') and regexp_matches(file_path, '(?s)^src/u1.*$') order by seq limit 100")
def f13(spark, sf):
    kept = sites(spark, sf).where(F.col("risk_level").isin("critical", "high") & C.matches_glob("file_path", "src/u1*"))
    total = kept.agg(F.count(F.lit(1)).alias("total"))
    # The total is one row; it joins on a constant.
    return kept.orderBy("seq").limit(100).withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one").select("seq", "category", "risk_level", "total")


@query("k16_severity_mapping", "select p_partkey, case when p_retailprice / 110.0 >= 9.0 then 'critical' when p_retailprice / 110.0 >= 7.0 then 'high' when p_retailprice / 110.0 >= 4.0 then 'medium' when p_retailprice / 110.0 >= 1.0 then 'low' else 'info' end as severity from part")
def k16(spark, sf):
    s = F.col("p_retailprice") / F.lit(110.0)
    return table(spark, sf, "part").select("p_partkey", F.when(s >= 9.0, "critical").when(s >= 7.0, "high").when(s >= 4.0, "medium").when(s >= 1.0, "low").otherwise("info").alias("severity"))


@query("k17_category_inference", "select p_partkey, case when contains(lower(p_name), 'ring') then 'jewel' when contains(lower(p_name), 'widget') then 'tool' when contains(lower(p_name), 'red') or contains(lower(p_name), 'blue') then 'colour' else 'other' end as category from part")
def k17(spark, sf):
    out = F.when(F.lit(False), "")
    for word, category in (("ring", "jewel"), ("widget", "tool"), ("red", "colour"), ("blue", "colour")):
        out = out.when(F.contains(F.lower("p_name"), F.lit(word)), category)
    return table(spark, sf, "part").select("p_partkey", out.otherwise("other").alias("category"))


@query("i7_rule_statistics", "select 'type' as dimension, p_type as value, count(*)::bigint as n from part group by 2 union all select 'word', w, count(*)::bigint from (select unnest(list_distinct(string_split(p_name, ' '))) as w from part) group by 2")
def i7(spark, sf):
    p = table(spark, sf, "part")
    words = p.select(F.explode(F.array_distinct(F.split("p_name", " "))).alias("value"))
    return p.groupBy(F.lit("type").alias("dimension"), F.col("p_type").alias("value")).agg(F.count(F.lit(1)).alias("n")).unionByName(words.groupBy(F.lit("word").alias("dimension"), "value").agg(F.count(F.lit(1)).alias("n")))


@query("p40_pattern_type", f"with {UNITS_SQL} select unit_id, case when contains(lower(code), 'password') then 'secret' when contains(lower(code), 'token') then 'token' when contains(lower(code), 'licensed') then 'license' else 'generic' end as pattern_type from units")
def p40(spark, sf):
    out = F.when(F.lit(False), "")
    for word, kind in (("password", "secret"), ("token", "token"), ("licensed", "license")):
        out = out.when(F.contains(F.lower("code"), F.lit(word)), kind)
    return units(spark, sf).select("unit_id", out.otherwise("generic").alias("pattern_type"))


@query("p44_rule_summary", "select p_brand as category, '- ' || p_name || ' (' || p_type || ')' as line from (select *, row_number() over (partition by p_brand order by p_partkey) as k from part) where k <= 3")
def p44(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    return table(spark, sf, "part").withColumn("k", F.row_number().over(w)).where("k <= 3").select(F.col("p_brand").alias("category"), F.concat(F.lit("- "), "p_name", F.lit(" ("), "p_type", F.lit(")")).alias("line"))


@query("c9_framework_detection", """
select distinct page_id, f as framework from pages, (values ('analytics', 'track\\('), ('advert', 'class="ad"'), ('article', '<article>'), ('table', '<table'), ('form', '<form')) v(f, p) where regexp_matches(html, p)""")
def c9(spark, sf):
    signatures = (("analytics", r"track\("), ("advert", 'class="ad"'), ("article", "<article>"), ("table", "<table"), ("form", "<form"))
    hits = F.array_compact(F.array(*[F.when(F.col("html").rlike(p), F.lit(f)) for f, p in signatures]))
    return table(spark, sf, "pages").select("page_id", F.explode(hits).alias("framework"))


@query("c10_routes", """
select page_id, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) as route from pages""")
def c10(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="(/[^"]*)"'), F.lit(1))).alias("route"))


@query("c5_regex_fallback", """
with l as (select page_id, unnest(range(1, len(ls) + 1)) as n, ls from (select page_id, string_split(regexp_replace(html, '<', chr(10) || '<', 'g'), chr(10)) as ls from pages))
select page_id, regexp_extract(ls[n], '^<(h1|article|nav|script|table)', 1) as symbol, n::bigint as line_no from l where regexp_matches(ls[n], '^<(h1|article|nav|script|table)')""")
def c5(spark, sf):
    lines = table(spark, sf, "pages").select("page_id", F.posexplode(C.lines(F.regexp_replace("html", "<", "\n<"))).alias("i", "line"))
    head = "^<(h1|article|nav|script|table)"
    return lines.where(F.col("line").rlike(head)).select("page_id", F.regexp_extract("line", head, 1).alias("symbol"), (F.col("i") + 1).cast("long").alias("line_no"))


def _part_rules(spark, sf):
    """A rule for each part, of five kinds, about names of customers; some begin with no letter, and some are no expression."""
    k = F.col("p_partkey")
    number = F.format_string("%09d", k)
    pattern = (
        F.when(k % 5 == 0, F.concat(F.lit("Customer#"), number))
        .when(k % 5 == 1, F.concat(F.lit("prefix:Customer#"), F.expr("left(format_string('%09d', p_partkey), cast(6 + p_partkey % 3 as int))")))
        .when(k % 5 == 2, F.concat(F.lit("suffix:"), F.expr("right(format_string('%09d', p_partkey), 4)")))
        .when(k % 5 == 3, F.concat(F.lit("contains:0"), k % 1000))
        .otherwise(F.when(k % 100 == 4, F.concat(F.lit("regex:[A-C]ustomer#0*"), k, F.lit("$"))).when(k % 100 == 9, "regex:Customer(#").otherwise(F.concat(F.lit("regex:Customer#0+"), k, F.lit("[0-4]?$"))))
    )
    return table(spark, sf, "part").select(F.format_string("R%d", k).alias("rule_id"), pattern.alias("pattern"))


@query("f2_rule_index", """
with p as (select p_partkey as k, printf('%09d', p_partkey) as s from part),
r as (select 'R' || k as rule_id, k % 5 as t, case k % 5 when 0 then 'Customer#' || s when 1 then 'Customer#' || left(s, (6 + k % 3)::int) when 2 then right(s, 4) when 3 then '0' || (k % 1000)
  else case when k % 100 = 4 then '^([A-C]ustomer#0*' || k || '$)' when k % 100 = 9 then null else '^(Customer#0+' || k || '[0-4]?$)' end end as x from p),
m as (select c_name, rule_id, t from (select distinct c_name from customer) c, r where case t when 0 then c_name = x when 1 then starts_with(c_name, x) when 2 then ends_with(c_name, x) when 3 then contains(c_name, x) else regexp_matches(c_name, x) end)
select c_custkey, rule_id, (['exact', 'prefix', 'suffix', 'contains', 'regex'])[t + 1] as kind, (row_number() over (partition by c_custkey order by case when t = 0 then 0 else 1 end, rule_id))::int as place from customer join m using (c_name)""")
def f2_index(spark, sf):
    index = rule_index.rule_index(_part_rules(spark, sf))
    return rule_index.lookup(table(spark, sf, "customer").select("c_custkey", "c_name"), "c_name", index).drop("c_name")
