"""Queries over programs with sinks made from lineitem, model answers made from conversations, checklists of documents, and handlers made from part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import parsing, review
from ..operators import property_graph as P
from .programs import GRAPH_SQL, LINES_SQL, order_lines, programs
from .query import SITES_SQL, UNITS_SQL, query, sites, table, units


def risky_programs(spark, sf):
    """file_id, content: a function for each order, a line for each of its lines: requests, assignments, sinks, sanitizers and functions within; one
    whose first line is a call of the last kind lacks a parenthesis in its head."""
    k, t, s = F.col("k"), F.col("t"), F.col("s")
    text = (
        F.when(t == 0, F.format_string("    %s = request.args", "a"))
        .when(t == 1, F.format_string("    %s = %s + limit", "a", "b"))
        .when((t == 2) & (s == 0), F.format_string("    os.system(%s)", "b"))
        .when((t == 2) & (s == 1), F.format_string("    eval(%s)", "b"))
        .when((t == 2) & (s == 2), F.format_string("    db.query(%s, limit)", "b"))
        .when(t == 2, F.format_string("    log(%s)", "b"))
        .when((t == 3) & (s == 3), F.format_string("    def inner_%d(x): return x", "k"))
        .when(t == 3, F.format_string("    %s = escape(%s)", "a", "b"))
        .when(s == 3, F.format_string("    subprocess.run(%s, %s)", "a", "b"))
        .otherwise(F.format_string("    %s = clean.quote(%s)", "a", "b"))
    )
    rows = F.array_sort(F.collect_list(F.struct("k", text.alias("x"))))
    broken = F.max((k == 1) & (t == 4))
    head = F.format_string("def order_%d(request, limit%s:\n", F.first("o"), F.when(broken, "").otherwise(")"))
    return order_lines(spark, sf).groupBy(F.col("o").alias("file_id")).agg(F.concat(head, F.array_join(F.transform(rows, lambda r: r["x"]), "\n"), F.lit("\n    return v0\n")).alias("content"))


RISKY_SQL = f"""{LINES_SQL},
broken as materialized (select o from ls where k = 1 and t = 4),
called as materialized (select o, k + 1 as line, case when t = 2 then (['os.system', 'eval', 'db.query', 'log'])[s + 1] when t = 3 then 'escape' when s = 3 then 'subprocess.run' else 'clean.quote' end as name,
    case when t = 2 and s = 2 then b || ',limit' when t = 4 and s = 3 then a || ',' || b else b end as arguments from ls where t in (2, 4) or (t = 3 and s <> 3))"""


@query("c2_program_units", f"""with {RISKY_SQL}, names as (select o, name from called union select o, split_part(name, '.', -1) from called)
select l.o as file_id, 'order_' || l.o as symbol, 'function' as unit_type, 1::int as start_line, (l.n + 2)::int as end_line, coalesce(c.calls, '') as calls
from (select o, count(*) as n from ls group by o) l left join (select o, string_agg(name, ',' order by name) as calls from names group by o) c using (o) where l.o not in (select o from broken)""")
def c2_programs(spark, sf):
    u = parsing.parse_python(risky_programs(spark, sf))
    return u.select("file_id", "symbol", "unit_type", "start_line", "end_line", F.array_join(F.array_sort("calls"), ",").alias("calls"))


@query("c6_program_fallback", f"""with {RISKY_SQL}, f as (select o, count(*) filter (t = 3 and s = 3) as inner_heads, o in (select o from broken) as bad from ls group by o)
select o as file_id, case when bad or inner_heads > 0 then 'regex' else 'tree' end as source, (1 + inner_heads)::bigint as n_units, 1.0::double as coverage, 0::int as errors from f""")
def c6_programs(spark, sf):
    return review.best_results(review.parse_results(risky_programs(spark, sf)))


@query("p25_program_isolation", f"with {RISKY_SQL} select o as file_id, case when o in (select o from broken) then 0 else 1 end::bigint as n_units, case when o in (select o from broken) then 'SyntaxError' end as error from (select distinct o from ls)")
def p25_programs(spark, sf):
    return parsing.isolated(risky_programs(spark, sf))


@query("p28_program_calls", f"with {RISKY_SQL} select o as file_id, line::int as line, name from called where contains(name, '.') and o not in (select o from broken)")
def p28_programs(spark, sf):
    return parsing.property_graph(risky_programs(spark, sf), ("Call",)).where(F.contains("name", F.lit("."))).select("file_id", "line", "name")


@query("p30_program_arguments", f"with {RISKY_SQL} select o as file_id, line::int as line, arguments from called")
def p30_programs(spark, sf):
    calls = risky_programs(spark, sf).select("file_id", F.posexplode(C.lines("content")).alias("i", "text")).where(F.contains("text", F.lit("(")) & ~F.col("text").rlike(r"^\s*def "))
    return calls.select("file_id", (F.col("i") + 1).alias("line"), F.array_join(parsing.call_arguments("text"), ",").alias("arguments"))


#: The state before each line: where v0, v1 and v2 were first tainted.
FLOWS_SQL = f"""{LINES_SQL},
taint(o, k, m) as (
  select o, 1::bigint, [null, null, null]::bigint[] from ls where k = 1
  union all
  select g.o, g.k + 1, [case when ls.a = 'v' || j and (ls.t = 0 or ls.t = 1 or (ls.t in (3, 4) and ls.s <> 3)) then coalesce(g.m[j + 1], case when ls.t = 0 then g.k + 1 else g.m[ls.b[2:2]::int + 1] end) else g.m[j + 1] end for j in [0, 1, 2]]
  from taint g join ls on ls.o = g.o and ls.k = g.k),
flows as materialized (
  select ls.o as file_id, g.m[ls.b[2:2]::int + 1] as source_line, ls.k + 1 as sink_line, ls.b as variable, (['system', 'eval', 'query'])[ls.s + 1] as sink,
    exists (select 1 from ls c where c.o = ls.o and c.k between ls.k - 1 and ls.k + 1 and c.t in (3, 4) and c.s <> 3) as sanitized
  from ls join taint g on g.o = ls.o and g.k = ls.k where ls.t = 2 and ls.s < 3 and g.m[ls.b[2:2]::int + 1] is not null)"""


@query("l13_program_taint", f"with recursive {FLOWS_SQL} select file_id, source_line::int as source_line, sink_line::int as sink_line, variable, sink, sanitized, case when sanitized then 0.4 else 0.8 end::double as confidence from flows")
def l13_programs(spark, sf):
    return parsing.taint_units(risky_programs(spark, sf))


@query("i5_program_flows", f"with recursive {FLOWS_SQL} select sink, sanitized, count(*)::bigint as n, count(distinct file_id)::bigint as files, min(sink_line - source_line)::int as nearest from flows group by sink, sanitized")
def i5_programs(spark, sf):
    f = parsing.taint_units(risky_programs(spark, sf))
    return f.groupBy("sink", "sanitized").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_id").alias("files"), F.min(F.col("sink_line") - F.col("source_line")).alias("nearest"))


CHECKS = (
    review.CheckItem("licence", "critical", ("licensed under", "copyright", "the"), ("trash",)),
    review.CheckItem("contact", "high", (r"[a-z]+@[a-z]+", "phone", "und")),
    review.CheckItem("keys", "high", (), ("token|password",)),
    review.CheckItem("words", "medium", ("and", "of", "der", "la")),
)


@query("m2_checklist_risk", f"""with {UNITS_SQL},
i(name, severity) as (values ('licence', 'critical'), ('contact', 'high'), ('keys', 'high'), ('words', 'medium')),
p(name, kind, pattern) as (values ('licence', 'good', 'licensed under'), ('licence', 'good', 'copyright'), ('licence', 'good', 'the'), ('licence', 'bad', 'trash'), ('contact', 'good', '[a-z]+@[a-z]+'), ('contact', 'good', 'phone'), ('contact', 'good', 'und'),
  ('keys', 'bad', 'token|password'), ('words', 'good', 'and'), ('words', 'good', 'of'), ('words', 'good', 'der'), ('words', 'good', 'la')),
h as (select unit_id, name, count(*) filter (kind = 'good') as asked, count(*) filter (kind = 'good' and regexp_matches(code, pattern, 'i')) as found, count(*) filter (kind = 'bad' and regexp_matches(code, pattern, 'i')) as bad from units, p group by unit_id, name),
r as (select unit_id, name, severity, bad = 0 and (asked = 0 or (found > 0 and found * 2 >= asked)) as passed from h join i using (name))
select unit_id, case when count(*) filter (not passed and severity = 'critical') > 0 or count(*) filter (not passed and severity = 'high') > 1 then 'critical' when count(*) filter (not passed and severity = 'high') > 0 then 'high' when count(*) filter (not passed) > 0 then 'medium' else 'low' end as risk_level,
  coalesce(string_agg(name, ',' order by name) filter (not passed), '') as failed from r group by unit_id""")
def m2_risk(spark, sf):
    failed = F.array_sort(F.transform(F.filter("checks", lambda c: ~c["passed"]), lambda c: c["name"]))
    return review.checklist(units(spark, sf), CHECKS).select("unit_id", "risk_level", F.array_join(failed, ",").alias("failed"))


_VERDICTS_SQL = f"""{SITES_SQL}, v as (select *, case when confidence < 0.5 then 'drop' when line_start = 0 then 'need_more_context' else 'keep' end as triage, case when confidence >= 0.8 then 'vulnerable' when confidence < 0.65 then 'false_positive' else 'uncertain' end as deep, risk_rank >= 3 as skipped from sites),
w as (select *, not skipped as triaged, skipped or triage <> 'drop' as deeper from v)"""


def _judged(spark, sf):
    c = F.col("confidence")
    triage = F.when(c < 0.5, "drop").when(F.col("line_start") == 0, "need_more_context").otherwise("keep")
    deep = F.when(c >= 0.8, "vulnerable").when(c < 0.65, "false_positive").otherwise("uncertain")
    return sites(spark, sf).select(F.col("seq").alias("id"), "unit_id", "category", "risk_level", triage.alias("triage"), deep.alias("deep"))


@query("m3_verification_stages", f"with {_VERDICTS_SQL} select seq as id, concat_ws('>', case when triaged then 'triage' end, case when deeper then 'deep_verify' end, case when deeper and deep = 'vulnerable' then 'patch_suggest' end) as stages, case when triaged and triage = 'need_more_context' then 'event ' || event_type end as context from w join events on event_id = seq")
def m3_stages(spark, sf):
    contexts = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("event "), "event_type").alias("context"))
    return review.verify_stages(_judged(spark, sf), contexts).select("id", F.array_join("stages", ">").alias("stages"), "context")


@query("m3_stage_counters", f"""with {_VERDICTS_SQL} select count(*) filter (triaged)::bigint as triage_total, count(*) filter (triaged and triage = 'drop')::bigint as triage_drop, count(*) filter (triaged and triage = 'need_more_context')::bigint as triage_need_context,
count(*) filter (triaged and triage = 'keep')::bigint as triage_keep, count(*) filter (deeper)::bigint as deep_verify_total, count(*) filter (deeper and deep = 'vulnerable')::bigint as deep_verify_confirmed, count(*) filter (deeper and deep = 'false_positive')::bigint as deep_verify_false_positive,
count(*) filter (deeper and deep = 'vulnerable')::bigint as patch_total from w""")
def m3_counters(spark, sf):
    return review.stage_counters(review.verify_stages(_judged(spark, sf)))


def answers(spark, sf):
    """conv_id, turn, content: an object whose message is the turn's text, plain, in a fence, between words, or cut off."""
    i, n = F.col("conv_id"), F.col("turn")
    file = F.concat(F.lit("src/u"), (i + n) % 50, F.lit(".py"))
    severity = F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical", "odd"))), ((i * 3 + n) % 5 + 1).cast("int"))
    body = F.to_json(F.struct(file.alias("file"), F.when((i + n) % 7 != 0, severity).alias("severity"), ((i * 7) % 30).alias("line"), (n % 10 / 10).alias("confidence"), F.col("text").alias("message")))
    content = F.when((i + n) % 4 == 0, body).when((i + n) % 4 == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\n"), "text")).when((i + n) % 4 == 2, F.concat("text", F.lit(" "), body, F.lit(" as asked"))).otherwise(F.left(body, F.char_length(body) - 1))
    return table(spark, sf, "conversations").select("conv_id", "turn", content.alias("content"))


@query("p41_answer_json", "select conv_id, turn, case when (conv_id + turn) % 4 <> 3 then md5(text) end as message_md5 from conversations")
def p41_answers(spark, sf):
    found = F.try_variant_get(F.try_parse_json(review.salvaged_json("content")), "$.message", "string")
    return answers(spark, sf).select("conv_id", "turn", F.md5(found.cast("binary")).alias("message_md5"))


@query("m4_answer_check", """with a as (select *, conv_id + turn as s, 'src/u' || (conv_id + turn) % 50 || '.py' as f, (conv_id * 7) % 30 as l, (turn % 10) / 10::double as c from conversations),
files as (select 'src/u' || c_custkey || '.py' as f, (c_custkey % 20 + 5) as n from customer where c_custkey < 40),
j as (select a.*, n from a left join files using (f))
select conv_id, turn, case when s % 4 = 3 then 'invalid_json' when n is null then 'hallucination' when s % 7 = 0 or (conv_id * 3 + turn) % 5 = 4 then 'schema_error' else 'valid' end as result,
  case when s % 4 = 3 then '' else concat_ws(',', case when c < 0.3 then 'low_confidence' end, case when n is not null and (l < 1 or l > n) then 'invalid_line' end) end as warnings from j""")
def m4_answers(spark, sf):
    i = F.col("c_custkey")
    files = table(spark, sf, "customer").where(i < 40).select(F.concat(F.lit("src/u"), i, F.lit(".py")).alias("path"), (i % 20 + 5).alias("n_lines"))
    checked = review.check_answers(answers(spark, sf), files, ("file", "severity", "message"), {"severity": ("low", "medium", "high", "critical")}, 0.3)
    return checked.select("conv_id", "turn", "result", F.array_join("warnings", ",").alias("warnings"))


@query("p31_handler_parameters", """with h as (select p_partkey as i, p_size % 4 as d, p_partkey % 3 as g, 'p' || p_size as own from part),
p as (select i, d, g, unnest([own, 'item', case when g = 1 then 'REQ' else 'limit' end]) as parameter from h)
select i as file_id, parameter, d = 2 or (d = 0 and parameter = 'item') or (d = 1 and parameter = 'limit') or (g = 0 and parameter = 'item') or parameter = 'REQ' as tainted from p""")
def p31_handlers(spark, sf):
    i, n = F.col("p_partkey"), F.col("p_size")
    mark = F.when(n % 4 == 0, F.lit("app.Route('/parts/<item>')")).when(n % 4 == 1, F.lit("router.get('/parts/<limit>')")).when(n % 4 == 2, F.lit("inject(Header)"))
    signature = F.format_string("def part_%d(p%d: int = max(1, 2), item%s, %s) -> dict[str, int]:", i, n, F.when(i % 3 == 0, ": str = Query(None, alias='x')").when(i % 3 == 1, "").otherwise(": str = Other(1)"), F.when(i % 3 == 1, "REQ").otherwise("*limit"))
    u = table(spark, sf, "part").select(i.alias("file_id"), F.array_compact(F.array(mark)).alias("decorators"), signature.alias("signature"))
    return review.tainted_parameters(u).select("file_id", "parameter", "tainted")


NODE_KINDS = ("function", "parameter", "assignment", "call", "if", "loop", "return")


@query("j15_program_structures", f"""with {GRAPH_SQL},
c as materialized (select o, count(*) filter (ty = 'function') as n1, count(*) filter (ty = 'parameter') as n2, count(*) filter (ty = 'assignment') as n3, count(*) filter (ty = 'call') as n4, count(*) filter (ty = 'if') as n5, count(*) filter (ty = 'loop') as n6, count(*) filter (ty = 'return') as n7, 1 + count(*) filter (ty in ('if', 'loop')) as cx, case when count(*) filter (ty in ('if', 'loop')) > 0 then 2 else 1 end as dp from n group by o),
f as materialized (select o, [n1, n2, n3, n4, n5, n6, n7, cx, dp]::double[] as v from c),
g as materialized (select v, sqrt(list_inner_product(v, v)) as norm, min(o) as head from f group by v),
m as materialized (select v, o from (select v, o, row_number() over (partition by v order by o) as r from f) where r <= 11),
s as (select a.v as qv, b.v as ev, round(list_inner_product(a.v, b.v) / (a.norm * b.norm), 6) as score from g a, g b),
t as (select qv, o, score, row_number() over (partition by qv order by score desc, o) as r from s join m on m.v = s.ev qualify r <= 11),
x as (select f.o as query_id, t.o as file_id, score from f join t on t.qv = f.v where f.o % 20 = 0 and f.o <> t.o)
select query_id, file_id, score, (row_number() over (partition by query_id order by score desc, file_id))::int as rank from x qualify rank <= 10""")
def j15_programs(spark, sf):
    features = review.file_structures(programs(spark, sf), NODE_KINDS)
    return review.similar_structures(P.stored(features), F.col("file_id") % 20 == 0)
