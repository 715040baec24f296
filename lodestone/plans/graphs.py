"""Call graphs and taint: queries over a graph of customers, suppliers, nations and regions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import graph as G
from .query import UNITS_SQL, query, table, units


def nodes(spark, sf):
    c, s, n, r = (table(spark, sf, t) for t in ("customer", "supplier", "nation", "region"))
    k = F.col("s_suppkey")
    return (
        c.select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.when(F.col("c_acctbal") < 0, "entry").when(F.col("c_mktsegment") == "BUILDING", "source").otherwise("plain").alias("node_type"), F.lit(0).alias("risk_rank"))
        .unionByName(s.select(F.concat(F.lit("s"), k).alias("id"), F.when(k % 5 == 0, "sanitizer").otherwise("plain").alias("node_type"), F.lit(0).alias("risk_rank")))
        .unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.lit("sink").alias("node_type"), (F.col("n_nationkey") % 4 + 1).cast("int").alias("risk_rank")))
        .unionByName(r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("plain").alias("node_type"), F.lit(0).alias("risk_rank")))
    )


def edges(spark, sf, cyclic: bool = True):
    c, s, n = (table(spark, sf, t) for t in ("customer", "supplier", "nation"))
    count, k = F.lit(s.count()), F.col("s_suppkey")
    out = c.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("s"), F.col("c_custkey") % count).alias("dst"))
    out = out.unionByName(s.select(F.concat(F.lit("s"), k).alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst")))
    if cyclic:
        out = out.unionByName(s.where((k * 7 + 3) % count != k).select(F.concat(F.lit("s"), k).alias("src"), F.concat(F.lit("s"), (k * 7 + 3) % count).alias("dst")))
    return out.unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst")))


GRAPH_SQL = """nodes as (
  select 'c' || c_custkey as id, case when c_acctbal < 0 then 'entry' when c_mktsegment = 'BUILDING' then 'source' else 'plain' end as node_type, 0 as risk_rank from customer
  union all select 's' || s_suppkey, case when s_suppkey % 5 = 0 then 'sanitizer' else 'plain' end, 0 from supplier
  union all select 'n' || n_nationkey, 'sink', (n_nationkey % 4 + 1)::int from nation union all select 'r' || r_regionkey, 'plain', 0 from region),
dag as (
  select 'c' || c_custkey as src, 's' || (c_custkey % (select count(*) from supplier)) as dst from customer union all select 's' || s_suppkey, 'n' || s_nationkey from supplier
  union all select 'n' || n_nationkey, 'r' || n_regionkey from nation),
edges as (
  select src, dst from dag union all select 's' || s_suppkey, 's' || ((s_suppkey * 7 + 3) % (select count(*) from supplier)) from supplier where (s_suppkey * 7 + 3) % (select count(*) from supplier) <> s_suppkey)"""


def _paths_sql(start: str, goal: str, most: int) -> str:
    return f"""walk(path, last, done) as (
  select [id], id, false from nodes where {start}
  union all select list_append(path, dst), dst, dst in (select id from nodes where {goal}) from walk join edges on last = src where not done and not list_contains(path, dst) and len(path) < {most}),
paths as (select path from walk where done)"""


_FORWARD = _paths_sql("node_type = 'source'", "node_type = 'sink'", 5)


def _forward(spark, sf):
    n = nodes(spark, sf)
    return G.simple_paths(edges(spark, sf), n.where("node_type = 'source'"), n.where("node_type = 'sink'"), 5)


@query("l1_node_classification", f"with {GRAPH_SQL} select id, node_type, (['info', 'low', 'medium', 'high', 'critical'])[1 + risk_rank] as risk_level from nodes")
def l1(spark, sf):
    return nodes(spark, sf).select("id", "node_type", C.risk_name("risk_rank").alias("risk_level"))


@query("i11_graph_statistics", f"with {GRAPH_SQL} select (select count(*) from nodes)::bigint as nodes, (select count(*) from (select distinct * from edges))::bigint as edges, " + ", ".join(f"(select count(*) from nodes where node_type = '{t}')::bigint as n_{t}" for t in ("entry", "source", "sink", "sanitizer")))
def i11(spark, sf):
    counts = nodes(spark, sf).agg(F.count(F.lit(1)).alias("nodes"), *(F.count_if(F.col("node_type") == t).alias(f"n_{t}") for t in ("entry", "source", "sink", "sanitizer")), F.lit(1).alias("one"))
    e = edges(spark, sf).distinct().agg(F.count(F.lit(1)).alias("edges"), F.lit(1).alias("one"))
    return counts.join(e, "one").drop("one")


@query("l18_neighbours", f"with {GRAPH_SQL}, e as (select distinct * from edges) select id, (select count(*) from e where src = id)::bigint as successors, (select count(*) from e where dst = id)::bigint as predecessors from nodes")
def l18(spark, sf):
    e = edges(spark, sf).distinct()
    out, into = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("successors")), e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("predecessors"))
    return nodes(spark, sf).select("id").join(out, "id", "left").join(into, "id", "left").fillna(0, ["successors", "predecessors"])


@query("l2_simple_paths", f"with recursive {GRAPH_SQL}, {_FORWARD} select array_to_string(path, '>') as path, len(path)::int as n from paths")
def l2(spark, sf):
    return _forward(spark, sf).select(F.array_join("path", ">").alias("path"), F.size("path").alias("n"))


@query("l4_taint_paths", f"""with recursive {GRAPH_SQL}, {_FORWARD}, t as (
  select array_to_string(path, '>') as path, len(path) as n, len([x for x in path[2:len(path) - 1] if starts_with(x, 's') and x[2:]::bigint % 5 = 0]) as sanitizers, (path[len(path)][2:]::bigint % 4 + 1)::int as risk from paths)
select path, sanitizers::bigint as sanitizers, (case when sanitizers > 0 then greatest(risk - 1, 1) else risk end)::int as risk_rank, round(case when sanitizers > 0 then 0.4 else 0.8 end::double * case when n > 5 then 0.8 else 1.0 end::double, 6) as confidence from t""")
def l4(spark, sf):
    return G.taint_paths(_forward(spark, sf), nodes(spark, sf)).select(F.array_join("path", ">").alias("path"), "sanitizers", "risk_rank", "confidence")


_BACK_SQL = """roots as (select id from nodes where id not in (select dst from edges)), stops as (select id from nodes where node_type = 'entry' union select id from roots),
back(path, last, done) as (select [id], id, false from nodes where node_type = 'sink'
  union all select list_prepend(src, path), src, src in (select id from stops) from back join (select distinct * from edges) e on last = dst where not done and not list_contains(path, src) and len(path) < 4)"""


@query("l5_backward_trace", f"with recursive {GRAPH_SQL}, {_BACK_SQL} select array_to_string(path, '>') as path from back where done")
def l5(spark, sf):
    n = nodes(spark, sf)
    return G.traces(edges(spark, sf), n.where("node_type = 'sink'"), n.where("node_type = 'entry'"), 4).select(F.array_join("path", ">").alias("path"))


@query("l6_dangerous_chains", f"with recursive {GRAPH_SQL}, {_BACK_SQL} select array_to_string(path, '>') as path, case when len([x for x in path[1:len(path) - 1] if starts_with(x, 's') and x[2:]::bigint % 5 = 0]) > 0 then greatest(path[len(path)][2:]::bigint % 4, 1) else path[len(path)][2:]::bigint % 4 + 1 end::int as effective_rank from back where done and starts_with(path[1], 'c')")
def l6(spark, sf):
    n = nodes(spark, sf)
    chains = G.traces(edges(spark, sf), n.where("node_type = 'sink'"), n.where("node_type = 'entry'"), 4)
    return G.taint_paths(chains, n).where(F.startswith(F.element_at("path", 1), F.lit("c"))).select(F.array_join("path", ">").alias("path"), F.col("risk_rank").alias("effective_rank"))


@query("l7_shortest_chains", f"with recursive {GRAPH_SQL}, {_BACK_SQL} select sink, path, place from (select path[len(path)] as sink, array_to_string(path, '>') as path, (row_number() over (partition by path[len(path)] order by len(path), array_to_string(path, '>')))::int as place from back where done) where place <= 5")
def l7(spark, sf):
    n = nodes(spark, sf)
    p = G.traces(edges(spark, sf), n.where("node_type = 'sink'"), n.where("node_type = 'entry'"), 4).select(F.element_at("path", -1).alias("sink"), F.size("path").alias("n"), F.array_join("path", ">").alias("path"))
    return p.withColumn("place", F.row_number().over(Window.partitionBy("sink").orderBy("n", "path"))).where("place <= 5").drop("n")


@query("l8_neighbourhood", f"""with recursive {GRAPH_SQL}, both_ways as (select src, dst from edges union select dst, src from edges),
hop(id, depth) as (select 'n3', 0 union select dst, depth + 1 from hop join both_ways on id = src where depth < 3)
select id, min(depth)::int as depth from hop group by id""")
def l8(spark, sf):
    e = edges(spark, sf)
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return G.reach(both, nodes(spark, sf).where("id = 'n3'"), 3)


@query("l9_depth_to_entry", f"""with recursive {GRAPH_SQL}, hop(id, depth) as (select id, 0 from nodes where node_type = 'entry' union select dst, depth + 1 from hop join edges on id = src where depth < 6)
select n.id, coalesce(min(h.depth), -1)::int as depth from nodes n left join hop h on n.id = h.id group by n.id""")
def l9(spark, sf):
    n = nodes(spark, sf)
    found = G.reach(edges(spark, sf), n.where("node_type = 'entry'"), 6)
    return n.select("id").join(found, "id", "left").select("id", F.coalesce("depth", F.lit(-1)).alias("depth"))


@query("l10_paths_between", f"with recursive {GRAPH_SQL}, {_paths_sql(chr(105) + 'd = ' + chr(39) + 's1' + chr(39), 'id like ' + chr(39) + 'r%' + chr(39), 6)} select array_to_string(path, '>') as path, case when len([x for x in path if starts_with(x, 's') and x[2:]::bigint % 5 = 0]) = 0 then 'high' else 'low' end as exploitability from paths order by len(path), 1 limit 10")
def l10(spark, sf):
    n = nodes(spark, sf)
    found = G.simple_paths(edges(spark, sf), n.where("id = 's1'"), n.where("id like 'r%'"), 6).withColumn("text", F.array_join("path", ">"))
    first = found.orderBy(F.size("path"), "text").limit(10)
    clean = ~F.exists("path", lambda x: x.startswith("s") & (F.try_to_number(F.substring(x, 2, 20), F.lit("99999999999")) % 5 == 0))
    return first.select(F.col("text").alias("path"), F.when(clean, "high").otherwise("low").alias("exploitability"))


@query("l11_source_sink_pairs", f"with recursive {GRAPH_SQL}, {_FORWARD} select source, sink, path from (select path[1] as source, path[len(path)] as sink, array_to_string(path, '>') as path, row_number() over (partition by path[1], path[len(path)] order by len(path), array_to_string(path, '>')) as k from paths) where k <= 3")
def l11(spark, sf):
    p = _forward(spark, sf).select(F.element_at("path", 1).alias("source"), F.element_at("path", -1).alias("sink"), F.size("path").alias("n"), F.array_join("path", ">").alias("path"))
    return p.withColumn("k", F.row_number().over(Window.partitionBy("source", "sink").orderBy("n", "path"))).where("k <= 3").select("source", "sink", "path")


@query("l12_topological_order", f"""with recursive {GRAPH_SQL}, depth(id, level) as (select id, 0 from nodes where id not in (select dst from dag) union select dst, level + 1 from depth join dag on id = src where level < 20)
select id, max(level)::int as level from depth group by id""")
def l12(spark, sf):
    return G.levels(edges(spark, sf, cyclic=False), nodes(spark, sf))


@query("l14_taint_fixpoint", f"""with recursive {GRAPH_SQL}, t(param, origin, depth) as (select id, id, 0 from nodes where node_type = 'source' union select dst, origin, depth + 1 from t join edges on param = src where depth < 4),
m as (select param, min(depth) as depth from t group by param)
select m.param, m.depth::int as depth from m""")
def l14(spark, sf):
    e = edges(spark, sf).distinct()
    return G.propagate(e, nodes(spark, sf).where("node_type = 'source'").select(F.col("id").alias("param")), 4).select("param", "depth")


@query("p35_chain_scores", f"with recursive {GRAPH_SQL}, {_FORWARD} select array_to_string(path, '>') as path, case when len(path) <= 2 then 0.9 when len(path) <= 4 then 0.7 when len(path) >= 8 then 0.3 else 0.5 end::double as risk_score from paths")
def p35(spark, sf):
    return _forward(spark, sf).select(F.array_join("path", ">").alias("path"), G.chain_risk(F.size("path")).alias("risk_score"))


@query("l17_typed_paths", f"with recursive {GRAPH_SQL}, {_paths_sql(chr(105) + 'd like ' + chr(39) + 's%' + chr(39), 'id like ' + chr(39) + 'r%' + chr(39), 3)} select path[1] as source, path[len(path)] as sink, count(*)::bigint as n from paths group by 1, 2")
def l17(spark, sf):
    n = nodes(spark, sf)
    p = G.simple_paths(edges(spark, sf), n.where("id like 's%'"), n.where("id like 'r%'"), 3)
    return p.groupBy(F.element_at("path", 1).alias("source"), F.element_at("path", -1).alias("sink")).agg(F.count(F.lit(1)).alias("n"))


def callers(spark, sf):
    """The words of a document as the names that a function calls."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("code"), F.lit("[a-z]{2,}"), F.lit(0)))
    return units(spark, sf).select(F.col("symbol").alias("caller"), "file_path", "language", words.alias("names"))


def calls(spark, sf):
    """A row for each call."""
    return callers(spark, sf).select("caller", "file_path", "language", F.explode("names").alias("name"))


CALLS_SQL = f"{UNITS_SQL}, calls as (select symbol as caller, file_path, language, unnest(list_distinct(regexp_extract_all(lower(code), '[a-z]{{2,}}'))) as name from units)"
_NAMED_SQL = "named as (select 'fn-' || doc_id as id, lower(regexp_extract(text, '[A-Za-z]{2,}')) as name, source || '/' || lang || '/doc' || doc_id || '.txt' as file_path, lang as language from documents)"


@query("g1_call_resolution", f"""with {CALLS_SQL}, {_NAMED_SQL},
f as (select c.caller, c.name, n.id, n.language = c.language as same, row_number() over (partition by c.caller, c.name order by case when n.language = c.language then 0 else 1 end, case when n.file_path = c.file_path then 0 else 1 end, n.id nulls first) as k from calls c left join named n on c.name = n.name)
select caller, name, coalesce(id, 'external:' || name) as target from f where k = 1 and (id is null or same)""")
def g1(spark, sf):
    d = table(spark, sf, "documents")
    named = d.select(F.concat(F.lit("fn-"), "doc_id").alias("id"), F.lower(F.regexp_extract("text", "[A-Za-z]{2,}", 0)).alias("name"), F.concat("source", F.lit("/"), "lang", F.lit("/doc"), "doc_id", F.lit(".txt")).alias("file_path"), F.col("lang").alias("language"))
    return G.resolve_units(callers(spark, sf), named)


@query("g2_caller_index", f"with {CALLS_SQL} select name, count(distinct caller || '|' || file_path)::bigint as callers, count(distinct file_path)::bigint as files from calls where name not in ('the', 'and', 'of') and name <> caller group by name")
def g2(spark, sf):
    return G.callers_of_units(callers(spark, sf), ("the", "and", "of"))


@query("g3_callees_to_depth", f"""with recursive {GRAPH_SQL}, hop(start_id, id, depth) as (select id, id, 0 from nodes where node_type = 'entry' union select start_id, dst, depth + 1 from hop join edges on hop.id = src where depth < 2)
select start_id as caller, id as callee, min(depth)::int as depth from hop where depth > 0 group by start_id, id""")
def g3(spark, sf):
    e = edges(spark, sf).distinct()
    front = nodes(spark, sf).where("node_type = 'entry'").select(F.col("id").alias("caller"), F.col("id").alias("callee"))
    found = None
    for d in (1, 2):
        front = front.join(e, F.col("callee") == F.col("src")).select("caller", F.col("dst").alias("callee")).distinct()
        step = front.withColumn("depth", F.lit(d))
        found = step if found is None else found.unionByName(step)
    return found.groupBy("caller", "callee").agg(F.min("depth").alias("depth"))


@query("g4_callers_with_fallback", f"with {GRAPH_SQL}, g as (select dst as id, count(distinct src) as n from edges group by dst) select nodes.id, coalesce(g.n, 0)::bigint as callers, case when g.n is null then 'scan' else 'graph' end as found_by from nodes left join g using (id)")
def g4(spark, sf):
    into = edges(spark, sf).groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n"))
    return nodes(spark, sf).select("id").join(into, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("callers"), F.when(F.col("n").isNull(), "scan").otherwise("graph").alias("found_by"))


@query("b4_graph_export", f"with {GRAPH_SQL} select 'node' as kind, '{{\"id\":\"' || id || '\",\"node_type\":\"' || node_type || '\"}}' as json from nodes union all select 'edge', '{{\"src\":\"' || src || '\",\"dst\":\"' || dst || '\"}}' from (select distinct * from edges)")
def b4(spark, sf):
    return nodes(spark, sf).select(F.lit("node").alias("kind"), F.to_json(F.struct("id", "node_type")).alias("json")).unionByName(edges(spark, sf).distinct().select(F.lit("edge").alias("kind"), F.to_json(F.struct("src", "dst")).alias("json")))


@query("b5_dot_export", f"with {GRAPH_SQL} select '  \"' || src || '\" -> \"' || dst || '\";' as line from (select distinct * from edges)")
def b5(spark, sf):
    return edges(spark, sf).distinct().select(F.format_string('  "%s" -> "%s";', "src", "dst").alias("line"))


@query("f12_entry_points", f"with {GRAPH_SQL} select id from nodes where node_type = 'entry' union select id from nodes where id not in (select dst from edges)")
def f12(spark, sf):
    n = nodes(spark, sf)
    roots = n.join(edges(spark, sf).select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    return n.where("node_type = 'entry'").select("id").unionByName(roots.select("id")).distinct()


@query("i14_feature_histogram", f"with {GRAPH_SQL} select left(id, 1) as graph_id, node_type, count(*)::bigint as n from nodes group by 1, 2")
def i14(spark, sf):
    return nodes(spark, sf).groupBy(F.substring("id", 1, 1).alias("graph_id"), "node_type").agg(F.count(F.lit(1)).alias("n"))
