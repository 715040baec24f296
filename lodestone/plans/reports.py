"""Findings, messages, logs and reports: queries over events, conversations and sites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import analytics as A
from ..operators import rules
from .query import SITES_SQL, UNITS_SQL, query, sites, table, units


@query("b1_json_report", f"with {SITES_SQL} select count(*)::bigint as total, " + ", ".join(f"count(*) filter (risk_level = '{r}')::bigint as {r}" for r in ("critical", "high", "medium", "low")) + " from sites")
def b1(spark, sf):
    return rules.risk_summary(sites(spark, sf)).drop("info")


@query("b2_sarif_rules", f"with {SITES_SQL} select category, arg_min(rule_id, seq) as rule_id, case when max(risk_rank) >= 3 then 'error' when max(risk_rank) = 2 then 'warning' else 'note' end as level, count(*)::bigint as results from sites group by category")
def b2(spark, sf):
    rank = F.max(C.risk_rank("risk_level"))
    return sites(spark, sf).groupBy("category").agg(F.min_by("rule_id", "seq").alias("rule_id"), F.when(rank >= 3, "error").when(rank == 2, "warning").otherwise("note").alias("level"), F.count(F.lit(1)).alias("results"))


@query("i5_taint_summary", f"with {SITES_SQL} select 'risk_level' as dimension, risk_level as value, count(*)::bigint as n from sites group by 2 union all select 'category', category, count(*)::bigint from sites group by 2 union all select 'total', '', count(*)::bigint from sites union all select 'confident', '', count(*)::bigint from sites where confidence >= 0.7")
def i5(spark, sf):
    s = sites(spark, sf)
    sure = s.agg(F.lit("confident").alias("dimension"), F.lit("").alias("value"), F.count_if(F.col("confidence") >= 0.7).alias("n"))
    return rules.counts_by(s, "risk_level", "category").unionByName(sure)


@query("i6_vulnerability_statistics", f"with {SITES_SQL} select risk_level, category, count(*)::bigint as n, count(*) filter (confidence >= 0.8)::bigint as high_confidence, count(*) filter (confidence < 0.5)::bigint as needs_review from sites group by grouping sets ((risk_level), (category), ())")
def i6(spark, sf):
    return sites(spark, sf).groupingSets([["risk_level"], ["category"], []], "risk_level", "category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") >= 0.8).alias("high_confidence"), F.count_if(F.col("confidence") < 0.5).alias("needs_review"))


@query("i12_severity_rollup", "select user_id as scan_id, " + ", ".join(f"count(*) filter (event_type = '{t}')::bigint as n_{t}" for t in ("error", "click", "view", "purchase")) + ", count(*)::bigint as total from events group by user_id")
def i12(spark, sf):
    return A.severity_rollup(table(spark, sf, "events").withColumnRenamed("user_id", "scan_id"), "scan_id", ("error", "click", "view", "purchase"), "event_type")


@query("i13_message_aggregates", "select conv_id, count(*)::bigint as messages, coalesce(sum(case when role = 'assistant' then length(text) end), 0)::bigint as tokens, sum(case when role = 'user' then turn % 3 else 0 end)::bigint as tool_calls from conversations group by conv_id")
def i13(spark, sf):
    calls = F.when(F.col("role") == "user", F.to_json(F.when(F.col("turn") % 3 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), (F.col("turn") % 3).cast("int")))))
    c = table(spark, sf, "conversations").withColumn("tool_calls", calls)
    n = F.when(F.col("tool_calls").isNotNull() & (F.col("tool_calls") != "[]"), F.json_array_length("tool_calls")).otherwise(0)
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.coalesce(F.sum(F.when(F.col("role") == "assistant", F.char_length("text"))), F.lit(0)).cast("long").alias("tokens"), F.sum(n).alias("tool_calls"))


@query("i15_parse_summary", f"with {SITES_SQL} select category as source, count(*)::bigint as n, round(avg(confidence), 6) as mean_confidence from sites group by category")
def i15(spark, sf):
    return sites(spark, sf).groupBy(F.col("category").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


@query("i16_performance_statistics", "select event_type as metric, count(*)::bigint as n, round(sum(value), 4) as total, round(avg(value), 6) as mean, min(value) as least, max(value) as most, round(count(*) filter (value > 10) / count(*)::double, 6) as success_rate from events group by event_type")
def i16(spark, sf):
    n = F.count(F.lit(1))
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("metric")).agg(n.alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.count_if(F.col("value") > 10) / n, 6).alias("success_rate"))


@query("j17_last_messages", "select conv_id, turn, role from (select *, row_number() over (partition by conv_id order by turn desc) as k from conversations) where k <= 3")
def j17(spark, sf):
    return A.last_n(table(spark, sf, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role")


@query("k13_priority_packing", """with recursive o as materialized (select conv_id, turn::bigint as id, length(text) // 3 as tokens, row_number() over (partition by conv_id order by case role when 'system' then 0 when 'user' then 1 else 2 end, turn, length(text) // 3) as k from conversations),
w(conv_id, k, used, id, taken) as (select distinct conv_id, 0::bigint, 0::bigint, null::bigint, false from o
  union all select o.conv_id, o.k, case when used + tokens <= 400 then used + tokens else used end, o.id, used + tokens <= 400 from w join o on o.conv_id = w.conv_id and o.k = w.k + 1)
select conv_id, final as used, id from (select *, max(used) over (partition by conv_id) as final from w) where taken""")
def k13(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2).alias("priority"), F.col("turn").alias("id"), C.tokens_third("text").alias("tokens"))
    return A.pack_by_priority(c, "conv_id", 400)


@query("k14_fifo_trim", "select conv_id, turn from (select *, row_number() over (partition by conv_id order by turn desc) as k, count(*) over (partition by conv_id) as n from conversations) where k <= greatest(2, n // 2)")
def k14(spark, sf):
    return A.fifo_trim(table(spark, sf, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn")


@query("k15_budget_cuts", "select conv_id as session, turn as id, case when sum(length(text) // 3) over (partition by conv_id) <= 300 then length(text) // 3 else greatest(least(length(text) // 3, 10), floor((length(text) // 3) * case role when 'user' then 0.6 when 'assistant' then 0.3 else 1.0 end::double)) end::bigint as kept from conversations")
def k15(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("id"), F.col("role").alias("priority"), C.tokens_third("text").alias("tokens"))
    return A.budget_cut(c, {"user": 0.6, "assistant": 0.3}, 300).select("session", "id", "kept")


@query("p43_token_breakdown", "select role, sum(length(text) // 3)::bigint as tokens, count(*)::bigint as messages from conversations group by role")
def p43(spark, sf):
    return table(spark, sf, "conversations").groupBy("role").agg(F.sum(C.tokens_third("text")).alias("tokens"), F.count(F.lit(1)).alias("messages"))


@query("p42_history_compression", "select conv_id, string_agg(text[1:200], chr(10) order by turn) as summary from (select *, row_number() over (partition by conv_id order by turn desc) as k, sum(length(text)) over (partition by conv_id) as n from conversations) where n > 1000 and k > 2 and k <= 12 group by conv_id")
def p42(spark, sf):
    w = Window.partitionBy("conv_id")
    c = table(spark, sf, "conversations").withColumn("k", F.row_number().over(w.orderBy(F.desc("turn")))).withColumn("n", F.sum(F.char_length("text")).over(w))
    old = c.where("n > 1000 and k > 2 and k <= 12").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.substring("text", 1, 200).alias("t")))).alias("m"))
    return old.select("conv_id", F.array_join(F.transform("m", lambda x: x["t"]), "\n").alias("summary"))


@query("n1_cursor_tail", "select event_id, event_type from events where event_id > 9000 order by event_id limit 50")
def n1(spark, sf):
    return table(spark, sf, "events").where("event_id > 9000").orderBy("event_id").limit(50).select("event_id", "event_type")


@query("n2_timeline", "select user_id, event_id, (row_number() over (partition by user_id order by ts, event_id))::int as place from events")
def n2(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("place"))


@query("n4_session_expiry", """
with s as (select *, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) <= 3600000000 then 0 else 1 end as starts from events),
n as (select *, sum(starts) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from s)
select user_id, session::bigint as session, count(*)::bigint as n, min(ts) as started, max(ts) as ended from n group by user_id, session""")
def n4(spark, sf):
    return A.sessions(table(spark, sf, "events"), "user_id", 3600)


@query("n5_rate_window", "select event_id, count(*) over w::bigint as n_recent, round(sum(value) over w, 4) as amount_recent from events window w as (partition by user_id order by epoch_us(ts) range between 86400000000 preceding and current row)")
def n5(spark, sf):
    return A.sliding_counts(table(spark, sf, "events"), "user_id", 86400, "value").select("event_id", "n_recent", "amount_recent")


@query("n3_event_windows", "select time_bucket(interval 1 hour, ts) as started, event_type, count(*)::bigint as n, round(sum(value), 4) as total from events group by 1, 2")
def n3(spark, sf):
    return table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("started"), "event_type", "n", "total")


_FINDINGS_SQL = f"""{SITES_SQL}, f as (select seq as id, 'src/u' || (unit_id % 160) || '.py' as file_path, line_start, line_start + seq % 3 as line_end, seq % 6 <> 0 as sink_ok, seq % 9 <> 0 as chain_ok, (seq % 4 // 2)::int as missing, confidence from sites),
files as (select distinct 'src/u' || user_id || '.py' as file_path, 6 as n_lines from events),
v as (select f.*, (n_lines is null)::int as no_file, coalesce((line_start < 1 or line_end < line_start or line_end > n_lines), false)::int as bad from f left join files using (file_path)),
s as (select id, no_file + bad as errors, (not sink_ok)::int + (not chain_ok)::int + missing as warnings, round(greatest(0.0, confidence - 0.3::double * no_file - 0.2::double * bad - 0.25::double * (not sink_ok)::int - 0.15::double * (not chain_ok)::int - 0.1::double * missing), 6) as score from v)"""


def _validated(spark, sf):
    s = sites(spark, sf)
    f = s.select(F.col("seq").alias("id"), F.concat(F.lit("src/u"), F.col("unit_id") % 160, F.lit(".py")).alias("file_path"), "line_start", (F.col("line_start") + F.col("seq") % 3).alias("line_end"), (F.col("seq") % 6 != 0).alias("sink_ok"), (F.col("seq") % 9 != 0).alias("chain_ok"), F.floor(F.col("seq") % 4 / 2).cast("int").alias("missing_evidence"), "confidence")
    return A.validate(f, s.select("file_path").distinct().withColumn("n_lines", F.lit(6)))


_STATUS = "case when errors > 0 then 'INVALID' when warnings >= 2 then 'NEEDS_REVIEW' when score < 0.5 then 'UNCERTAIN' when score < 0.7 then 'NEEDS_REVIEW' else 'VALID' end"


@query("m1_finding_validation", f"with {_FINDINGS_SQL} select id, score, {_STATUS} as status from s")
def m1(spark, sf):
    return _validated(spark, sf).select("id", "score", "status")


@query("p36_validator_checks", f"with {_FINDINGS_SQL} select {_STATUS} as status, sum(errors)::bigint as errors, sum(warnings)::bigint as warnings, count(*)::bigint as n from s group by 1")
def p36(spark, sf):
    return _validated(spark, sf).groupBy("status").agg(F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"), F.count(F.lit(1)).alias("n"))


@query("m2_checklist", f"with {UNITS_SQL}, p as (select unit_id, contains(lower(code), 'trash') as bad_word, (contains(lower(code), 'the')::int + contains(lower(code), 'and')::int + contains(lower(code), 'licensed')::int + contains(lower(code), 'of')::int) as n from units) select unit_id, case when bad_word then 'fail' when n = 0 or n < 2 then 'fail' else 'pass' end as result, n::int as positives from p")
def m2(spark, sf):
    n = sum((F.contains(F.lower("code"), F.lit(w)).cast("int") for w in ("the", "and", "licensed", "of")), F.lit(0))
    return units(spark, sf).select("unit_id", F.when(F.contains(F.lower("code"), F.lit("trash")), "fail").when(n < 2, "fail").otherwise("pass").alias("result"), n.alias("positives"))


@query("m4_schema_check", """select event_id, regexp_matches(props, '^[{]"k": [0-9]+[}]$') as valid, case when regexp_matches(props, '^[{]"k": [0-9]+[}]$') then regexp_extract(props, '[0-9]+')::bigint end as k from events""")
def m4(spark, sf):
    parsed = F.from_json("props", "k long")
    return table(spark, sf, "events").select("event_id", parsed["k"].isNotNull().alias("valid"), parsed["k"].alias("k"))


@query("p1_deterministic_findings", f"""
with {SITES_SQL}, c as (select file_path, line_start, symbol, count(*) as n from sites where risk_level = 'critical' group by all)
select 'f-' || sha256('scan1:' || s.file_path || ':' || s.line_start || ':' || s.symbol)[1:12] as id, seq, case when category in ('purchase', 'error') then 'HIGH' else 'MEDIUM' end as severity, 0.5::double as confidence, coalesce(c.n, 0)::bigint as chain_count from sites s left join c using (file_path, line_start, symbol)""")
def p1(spark, sf):
    s = sites(spark, sf)
    return A.deterministic_findings(s, s.where("risk_level = 'critical'"), "scan1")


@query("p24_throughput", "select user_id, round(count(*) / nullif(epoch_us(max(ts)) - epoch_us(min(ts)), 0) * 86400000000.0::double, 6) as per_day from events group by user_id")
def p24(spark, sf):
    span = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(F.try_divide(F.count(F.lit(1)), span) * 86400000000.0, 6).alias("per_day"))


@query("p26_error_ratio", "select user_id, round(avg(case when event_type = 'error' then 1.0 else 0.0 end), 6)::double as error_ratio, count(*) filter (event_type = 'error') / count(*)::double > 0.25 as falls_back from events group by user_id")
def p26(spark, sf):
    ratio = F.count_if(F.col("event_type") == "error") / F.count(F.lit(1))
    return table(spark, sf, "events").groupBy("user_id").agg(F.round(ratio, 6).alias("error_ratio"), (ratio > 0.25).alias("falls_back"))


@query("p34_chain_auth", f"with {SITES_SQL} select unit_id, bool_or(category = 'signup') as has_auth, bool_or(category = 'view') as has_sanitizer from sites group by unit_id")
def p34(spark, sf):
    return sites(spark, sf).groupBy("unit_id").agg(F.bool_or(F.col("category") == "signup").alias("has_auth"), F.bool_or(F.col("category") == "view").alias("has_sanitizer"))


@query("p37_finding_states", "select user_id as finding_id, case arg_min(event_type, event_id) when 'purchase' then 'confirmed' when 'error' then 'rejected' else 'pending' end as state from events where event_type in ('purchase', 'error') group by user_id")
def p37(spark, sf):
    decided = table(spark, sf, "events").where(F.col("event_type").isin("purchase", "error"))
    first = F.min_by("event_type", "event_id")
    return decided.groupBy(F.col("user_id").alias("finding_id")).agg(F.when(first == "purchase", "confirmed").when(first == "error", "rejected").otherwise("pending").alias("state"))


@query("p38_variant_feedback", "select user_id as pattern_id, count(*) filter (event_type = 'purchase')::bigint as confirmed, count(*) filter (event_type = 'error')::bigint as false_positives from events group by user_id")
def p38(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("pattern_id")).agg(F.count_if(F.col("event_type") == "purchase").alias("confirmed"), F.count_if(F.col("event_type") == "error").alias("false_positives"))


@query("p47_scan_delete", "select 'events' as tbl, count(*)::bigint as n from events where user_id % 7 <> 0 union all select 'conversations', count(*)::bigint from conversations where conv_id % 7 <> 0")
def p47(spark, sf):
    e, c = table(spark, sf, "events"), table(spark, sf, "conversations")
    gone = e.where("user_id % 7 = 0").select(F.col("user_id").alias("scan_id")).unionByName(c.where("conv_id % 7 = 0").select(F.col("conv_id").alias("scan_id"))).distinct()
    kept = [("events", e, "user_id"), ("conversations", c, "conv_id")]
    out = [t.join(gone, F.col(k) == F.col("scan_id"), "left_anti").agg(F.lit(n).alias("tbl"), F.count(F.lit(1)).alias("n")) for n, t, k in kept]
    return out[0].unionByName(out[1])


@query("p48_project_registry", "select distinct md5(source)[1:12] as project_id, source from documents")
def p48(spark, sf):
    return table(spark, sf, "documents").select("source").distinct().select(F.substring(F.md5(F.col("source").cast("binary")), 1, 12).alias("project_id"), "source")


@query("p49_task_lifecycle", "select case when event_type = 'error' and event_id % 4 < 3 then 'retry' when event_type = 'error' then 'failed' else 'done' end as state, count(*)::bigint as n from events group by 1")
def p49(spark, sf):
    error = F.col("event_type") == "error"
    return table(spark, sf, "events").groupBy(F.when(error & (F.col("event_id") % 4 < 3), "retry").when(error, "failed").otherwise("done").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("p5_security_markers", f"with {UNITS_SQL} select unit_id, regexp_matches(lower(code), 'request|input|read') as is_source, regexp_matches(lower(code), 'exec|write|trash') as is_sink, regexp_matches(lower(code), 'clean|escape|licensed') as is_sanitizer from units")
def p5(spark, sf):
    low = F.lower("code")
    return units(spark, sf).select("unit_id", low.rlike("request|input|read").alias("is_source"), low.rlike("exec|write|trash").alias("is_sink"), low.rlike("clean|escape|licensed").alias("is_sanitizer"))


@query("p4_user_input", f"with {UNITS_SQL} select unit_id, case language when 'en' then contains(lower(code), 'trash') or contains(lower(code), 'token') when 'de' then contains(lower(code), 'und') else contains(lower(code), 'de ') end as has_input from units")
def p4(spark, sf):
    low = F.lower("code")
    any_of = lambda *w: F.exists(F.array(*map(F.lit, w)), lambda x: F.contains(low, x))
    return units(spark, sf).select("unit_id", F.when(F.col("language") == "en", any_of("trash", "token")).when(F.col("language") == "de", any_of("und")).otherwise(any_of("de ")).alias("has_input"))


@query("p8_file_outline", f"with {SITES_SQL} select file_path, line_start, symbol, count(*)::bigint as n from sites where file_path = 'src/u8.py' or ends_with(file_path, '/u9.py') group by all")
def p8(spark, sf):
    wanted = (F.col("file_path") == "src/u8.py") | F.endswith("file_path", F.lit("/u9.py"))
    return sites(spark, sf).where(wanted).groupBy("file_path", "line_start", "symbol").agg(F.count(F.lit(1)).alias("n"))


@query("p33_site_flow_relevance", f"with {SITES_SQL}, f as (select unit_id, count(*) filter (category = 'error') as e, count(*) filter (category = 'click') as c from sites group by unit_id) select seq, case when e > 0 and category = 'error' then 0.8 when c > 0 and category = 'click' then 0.3 when e + c > 0 then 0.2 else 0.0 end::double as relevance from sites join f using (unit_id)")
def p33(spark, sf):
    s = sites(spark, sf)
    f = s.groupBy("unit_id").agg(F.count_if(F.col("category") == "error").alias("e"), F.count_if(F.col("category") == "click").alias("c"))
    k = F.col("category")
    return s.join(f, "unit_id").select("seq", F.when((F.col("e") > 0) & (k == "error"), 0.8).when((F.col("c") > 0) & (k == "click"), 0.3).when(F.col("e") + F.col("c") > 0, 0.2).otherwise(0.0).alias("relevance"))


@query("k18_cwe_extraction", """
with t as (select p_partkey, case p_partkey % 3 when 0 then ['CWE-' || p_size] when 1 then ['CWE-' || p_size, 'CWE-' || p_partkey % 9] else [] end as named, case when p_partkey % 2 = 0 then ['CWE-' || p_partkey % 4] else [] end as tagged from part)
select p_partkey, array_to_string(list_sort(list_distinct(named || tagged)), ',') as cwe from t""")
def k18(spark, sf):
    # Rules of three kinds: the field is a string, a list or absent; tags carry ids among other words.
    k, size = F.col("p_partkey"), F.concat(F.lit("CWE-"), "p_size")
    one, two = F.to_json(F.struct(size.alias("cwe"))), F.to_json(F.struct(F.array(size, F.concat(F.lit("CWE-"), k % 9)).alias("cwe")))
    metadata = F.when(k % 3 == 0, one).when(k % 3 == 1, two).otherwise("{}")
    tags = F.array(F.lit("security"), F.when(k % 2 == 0, F.concat(F.lit("CWE-"), k % 4)).otherwise("external"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(C.cwe_ids(metadata, tags), ",").alias("cwe"))


@query("g9_site_details", f"with {SITES_SQL}, d as (select unit_id, arg_min(rule_id, seq) as rule_id from sites group by unit_id) select c_custkey, coalesce(d.rule_id, 'none') as rule_id from customer left join d on c_custkey = d.unit_id")
def g9(spark, sf):
    d = sites(spark, sf).groupBy("unit_id").agg(F.min_by("rule_id", "seq").alias("rule_id"))
    return table(spark, sf, "customer").join(d, F.col("c_custkey") == F.col("unit_id"), "left").select("c_custkey", F.coalesce("rule_id", F.lit("none")).alias("rule_id"))


@query("p32_flow_sort", f"with {SITES_SQL} select seq, (row_number() over (order by risk_rank desc, confidence desc, seq))::int as place from sites where category <> 'view' and risk_level = 'critical'")
def p32(spark, sf):
    kept = sites(spark, sf).where("category <> 'view' and risk_level = 'critical'")
    return kept.withColumn("place", F.row_number().over(Window.orderBy(C.risk_rank("risk_level").desc(), F.desc("confidence"), "seq"))).select("seq", "place")
