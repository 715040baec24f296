"""Sources, parsers, embeddings, streams and composites."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.embeddings import hash_embedding, md5_embedding
from ..operators import graph as G
from ..operators import incremental as inc
from ..operators import parsing, query_language, rules, search, text
from ..sources import readers
from ..sources.scratch import stored
from ..streaming import streams
from . import graphs
from .query import SITES_SQL, UNITS_SQL, query, sites, table, units


@query("a1_folder_scan", None)
def a1(spark, sf):
    return readers.scan_folder(spark, sf, "*.parquet").select(F.substring_index("path", "/", -1).alias("name"), "length")


@query("a9_sarif_import", "select 'rule-' || (event_id % 23) as rule_id, 'src/u' || user_id || '.py' as file_path, (event_id % 7)::int as line_start, case event_id % 23 when 0 then 'critical' when 1 then 'low' else case event_type when 'error' then 'high' when 'click' then 'medium' when 'view' then 'low' else 'medium' end end as severity, case when event_id % 4 <> 0 then 'fp' || event_id % 300 end as fingerprint from events where event_id % 10 <> 0")
def a9(spark, sf):
    e = table(spark, sf, "events")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "warning").when(F.col("event_type") == "view", "note").otherwise("none")
    location = F.struct(F.struct(F.struct(F.concat(F.lit("src/u"), "user_id", F.lit(".py")).alias("uri")).alias("artifactLocation"), F.struct((F.col("event_id") % 7).alias("startLine"), (F.col("event_id") % 7).alias("endLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(
        F.concat(F.lit("rule-"), F.col("event_id") % 23).alias("ruleId"), level.alias("level"), F.struct("event_type").alias("message"),
        F.when(F.col("event_id") % 10 != 0, F.array(location)).alias("locations"),
        F.when(F.col("event_id") % 4 != 0, F.create_map(F.lit("primary"), F.concat(F.lit("fp"), F.col("event_id") % 300))).alias("partialFingerprints"),
    )
    named = F.array(*[F.struct(F.lit(f"rule-{k}").alias("id"), F.create_map(F.lit("security-severity"), F.lit(v)).alias("properties")) for k, v in ((0, "9.1"), (1, "1.5"))])
    run = F.struct(F.struct(F.struct(F.lit("scanner").alias("name"), named.alias("rules")).alias("driver")).alias("tool"), F.collect_list(result).alias("results"))
    reports = e.groupBy("user_id", (F.col("event_id") % 16).alias("part")).agg(F.to_json(F.struct(F.array(run).alias("runs"))).alias("report"))
    return readers.sarif_findings(reports).select("rule_id", "file_path", "line_start", "severity", "fingerprint")


@query("a11_xml_rules", "select 'R' || p_partkey as rule_id, lower(p_type) as category, case p_partkey % 3 when 0 then 'prefix:' || p_brand when 1 then 'suffix:' || p_brand else p_brand end as pattern from part")
def a11(spark, sf):
    kind = F.when(F.col("p_partkey") % 3 == 0, "starts").when(F.col("p_partkey") % 3 == 1, "ends").otherwise("is")
    xml = F.format_string("<Rule><RuleID>R%d</RuleID><Category>%s</Category><Function>%s</Function><Match>%s</Match></Rule>", "p_partkey", "p_type", "p_brand", kind)
    return readers.xml_rules(table(spark, sf, "part").select(xml.alias("xml")))


def _sources(spark, sf):
    """A Python file for each document, its names from the id."""
    i = F.col("doc_id")
    code = F.concat(
        F.lit("import os\n@app.get('/x')\ndef handle_"), i, F.lit("(request):\n    value = request.args\n    other = value + 'x'\n"),
        F.when(i % 3 == 0, F.lit("    other = escape(other)\n")).otherwise(F.lit("")),
        F.lit("    os.system(other)\n\nclass Box"), i, F.lit(":\n    def open(self):\n        return helper(1)\n"),
        F.when(i % 50 == 0, F.lit("def broken(:\n")).otherwise(F.lit("")),
    )
    return table(spark, sf, "documents").select(i.alias("file_id"), code.alias("content"))


@query("c2_python_units", """
with d as (select doc_id, case when doc_id % 3 = 0 then 1 else 0 end as k from documents where doc_id % 50 <> 0)
select doc_id as file_id, 'handle_' || doc_id as symbol, 'handler' as unit_type, 3::int as start_line, (6 + k)::int as end_line, case when k = 1 then 'escape,os.system,system' else 'os.system,system' end as calls from d
union all select doc_id, 'Box' || doc_id, 'class', (8 + k)::int, (10 + k)::int, 'helper' from d union all select doc_id, 'Box' || doc_id || '.open', 'method', (9 + k)::int, (10 + k)::int, 'helper' from d""")
def c2(spark, sf):
    u = parsing.parse_python(_sources(spark, sf))
    return u.select("file_id", "symbol", "unit_type", "start_line", "end_line", F.array_join(F.array_sort("calls"), ",").alias("calls"))


@query("l13_intra_unit_taint", "select doc_id as file_id, 4::int as source_line, (6 + (doc_id % 3 = 0)::int)::int as sink_line, 'other' as variable, 'system' as sink, doc_id % 3 = 0 as sanitized, case when doc_id % 3 = 0 then 0.4 else 0.8 end::double as confidence from documents")
def l13(spark, sf):
    return parsing.taint_units(_sources(spark, sf))


@query("i5_flow_confidence", "select doc_id % 3 = 0 as sanitized, count(*)::bigint as n, count(*)::bigint as reviewed from documents group by 1")
def i5_flows(spark, sf):
    return parsing.taint_units(_sources(spark, sf)).groupBy("sanitized").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") < 0.95).alias("reviewed"))


@query("p30_call_arguments", "select doc_id, 'other' as arguments from documents")
def p30(spark, sf):
    calls = _sources(spark, sf).select("file_id", F.explode(C.lines("content")).alias("line")).where(F.contains("line", F.lit("os.system(")))
    return calls.select(F.col("file_id").alias("doc_id"), F.array_join(parsing.call_arguments("line"), ",").alias("arguments"))


@query("e3_hash_embedding", None)
def e3(spark, sf):
    e = table(spark, sf, "documents").select("doc_id", hash_embedding(64)("text").alias("e"))
    return e.select("doc_id", F.round(C.norm("e"), 4).alias("norm"), F.array_position("e", F.array_max("e")).alias("largest"))


@query("k3_query_language", f"with {UNITS_SQL} select unit_id from units where language = 'en' and not contains(file_path, 'src1') and (contains(lower(code), 'licensed') or contains(lower(code), 'token'))")
def k3(spark, sf):
    return query_language.search(units(spark, sf), "licensed token lang:en -path:src1").select("unit_id")


@query("n3_stream_windows", "select time_bucket(interval 1 hour, ts) as started, event_type, count(*)::bigint as n, round(sum(value), 4) as total from events group by 1, 2")
def n3_stream(spark, sf):
    return streams.drain(streams.window_counts(streams.event_stream(spark, sf)))


@query("h6_stream_keep_latest", "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by user_id")
def h6(spark, sf):
    return streams.keep_latest(streams.event_stream(spark, sf).select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("h7_batch_journal", "select batch_id, state from (select event_id % 500 as batch_id, case event_type when 'purchase' then 'committed' when 'error' then 'failed' else 'pending' end as state, row_number() over (partition by event_id % 500 order by event_id desc) as k from events) where k = 1")
def h7(spark, sf):
    t = F.col("event_type")
    log = table(spark, sf, "events").select((F.col("event_id") % 500).alias("batch_id"), "event_id", F.when(t == "purchase", "committed").when(t == "error", "failed").otherwise("pending").alias("state"))
    return inc.latest(log, "batch_id", F.desc("event_id")).select("batch_id", "state")


@query("b3_console_report", f"with {SITES_SQL} select '[' || upper(risk_level) || '] ' || file_path || ':' || line_start || ' ' || category as line from sites where risk_level = 'critical'")
def b3(spark, sf):
    return sites(spark, sf).where("risk_level = 'critical'").select(F.format_string("[%s] %s:%d %s", F.upper("risk_level"), "file_path", "line_start", "category").alias("line"))


@query("b6_json_coercion", "select event_id, '{\"id\":' || event_id || ',\"ts\":\"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '\",\"tags\":[\"' || event_type || '\"]}' as json from events")
def b6(spark, sf):
    return table(spark, sf, "events").select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.array("event_type").alias("tags"))).alias("json"))


@query("p2_reverse_levels", f"""with recursive {graphs.GRAPH_SQL}, hop(id, depth) as (select id, 0 from nodes where node_type = 'sink' union select src, depth + 1 from hop join edges on id = dst where depth < 3)
select id, min(depth)::int as depth from hop group by id""")
def p2(spark, sf):
    back = graphs.edges(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return G.reach(back, graphs.nodes(spark, sf).where("node_type = 'sink'"), 3)


@query("p6_pattern_pack", f"with {UNITS_SQL}, p(name, regex) as (values ('keys', 'token|password'), ('mail', '[a-z]+@[a-z]+'), ('licence', 'licensed under')), l as (select unit_id, unnest(range(1, len(ls) + 1)) as n, ls from (select unit_id, string_split(code, chr(10)) as ls from units)) select unit_id, n::bigint as line_start, name as rule_id from l join p on regexp_matches(lower(ls[n]), regex)")
def p6(spark, sf):
    pack = (("keys", "x", "info", "token|password"), ("mail", "x", "info", "[a-z]+@[a-z]+"), ("licence", "x", "info", "licensed under"))
    return rules.scan_units(units(spark, sf), pack).select("unit_id", "line_start", "rule_id")


@query("p7_symbol_lookup", f"with {UNITS_SQL} select unit_id, symbol, length(code)::bigint as n_chars from units where symbol = 'doc_12' or ends_with(symbol, '.doc_12')")
def p7(spark, sf):
    u = units(spark, sf)
    return u.where((F.col("symbol") == "doc_12") | F.endswith("symbol", F.lit(".doc_12"))).select("unit_id", "symbol", F.char_length("code").cast("long").alias("n_chars"))


@query("p13_search_within_file", f"with {UNITS_SQL} select unit_id from units where starts_with(file_path, 'src2/') and contains(lower(code), 'the')")
def p13(spark, sf):
    return query_language.search(units(spark, sf), "the path:src2/*").select("unit_id")


@query("p27_ancestors", "select s_suppkey, 'n' || s_nationkey as parent, 'r' || n_regionkey as ancestor, 's' || s_suppkey || '/n' || s_nationkey || '/r' || n_regionkey as node_path from supplier join nation on s_nationkey = n_nationkey")
def p27(spark, sf):
    n = nodes = table(spark, sf, "nation")
    s = table(spark, sf, "supplier").join(nodes, F.col("s_nationkey") == n["n_nationkey"])
    chain = [F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("r"), "n_regionkey")]
    return s.select("s_suppkey", chain[1].alias("parent"), chain[2].alias("ancestor"), F.concat_ws("/", *chain).alias("node_path"))


@query("p41_json_salvage", """select conv_id, turn, 'k' || turn as value from conversations""")
def p41(spark, sf):
    # Answers that carry JSON in a fence or between braces, with text around.
    body = F.concat(F.lit('{"name": "k'), "turn", F.lit('"}'))
    answer = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone"))).otherwise(F.concat(F.lit("The result is "), body, F.lit(" as asked")))
    fenced = F.regexp_extract("answer", r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract("answer", r"(?s)(\{.*\})", 1)
    found = F.from_json(F.when(fenced != "", fenced).otherwise(bare), "name string")
    return table(spark, sf, "conversations").withColumn("answer", answer).select("conv_id", "turn", found["name"].alias("value"))


@query("p46_graph_summary", f"with {graphs.GRAPH_SQL} select node_type, string_agg(id, ',' order by id) as first_ids from (select id, node_type, row_number() over (partition by node_type order by id) as k from nodes) where k <= 5 group by node_type")
def p46(spark, sf):
    first = graphs.nodes(spark, sf).withColumn("k", F.row_number().over(Window.partitionBy("node_type").orderBy("id"))).where("k <= 5")
    return first.groupBy("node_type").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("first_ids"))


@query("p50_prescan_pipeline", f"""
with {SITES_SQL}, m as (select unit_id, line_start, max(risk_rank) as r, max(confidence) as c, arg_min(category, seq) as category, min(seq) as seq from sites group by unit_id, line_start),
p as (select *, row_number() over (partition by category order by seq) as k from m where r >= 3 and c >= 0.5)
select category, count(*)::bigint as n, count(*) filter (r = 4)::bigint as critical from p where k <= 50 group by category""")
def p50(spark, sf):
    s = sites(spark, sf)
    first = s.groupBy("unit_id", "line_start").agg(F.min("seq").alias("seq"))
    merged = rules.merge_sites(s).join(first, ["unit_id", "line_start"])
    return rules.prescan(merged).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("risk_level") == "critical").alias("critical"))


@query("j7_hybrid_merge", f"with {SITES_SQL}, a as (select file_path, line_start, max(confidence) as x from sites where seq % 2 = 0 group by all), b as (select file_path, line_start, max(confidence) as y from sites where seq % 2 = 1 group by all) select file_path, line_start, round(case when x is null then y when y is null then x else (x + 0.5::double * y) * 1.2::double end, 6) as score from a full join b using (file_path, line_start)")
def j7(spark, sf):
    s = sites(spark, sf)
    arm = lambda k, n: s.where(F.col("seq") % 2 == k).groupBy("file_path", "line_start").agg(F.max("confidence").alias(n))
    both = arm(0, "x").join(arm(1, "y"), ["file_path", "line_start"], "full_outer")
    score = F.when(F.col("x").isNull(), F.col("y")).when(F.col("y").isNull(), F.col("x")).otherwise((F.col("x") + F.lit(0.5) * F.col("y")) * F.lit(1.2))
    return both.select("file_path", "line_start", F.round(score, 6).alias("score"))


@query("j15_structure_similarity", None)
def j15(spark, sf):
    return similar_units(sites(spark, sf), F.col("unit_id") % 20 == 0)


def similar_units(found, asked, k=10):
    """query_id, unit_id, score, rank: the k units nearest to each asked one by how many of found(unit_id, category) they have of each category;
    units without a category in common don't meet. A vector has a place for each category; nulls equal nothing, so they count in the
    length of a vector alone, at a place of the units and another of the queries."""
    kinds = [r["category"] for r in found.where("category is not null").select("category").distinct().orderBy("category").collect()]
    n = [*(F.count_if(F.col("category") == c).cast("double") for c in kinds), F.count_if(F.col("category").isNull()).cast("double")]
    counts = stored(found.where("unit_id is not null").groupBy("unit_id").agg(F.array(*n).alias("n")))
    alone, none = F.slice("n", len(kinds) + 1, 1), F.array(F.lit(0.0))
    place = lambda *rest: F.concat(F.slice("n", 1, len(kinds)), *rest)
    store = counts.select(F.col("unit_id").alias("vec_id"), place(alone, none).alias("embedding"))
    queries = counts.where(asked).select(F.col("unit_id").alias("query_id"), place(none, alone).alias("q"))
    return search.vector_top_k(store, queries, k, smooth=0.0, positive=True).select("query_id", F.col("vec_id").alias("unit_id"), "score", "rank")


@query("o2_callback_matcher", "select c_custkey, c_custkey % 7 = 0 as matched from customer")
def o2(spark, sf):
    @F.pandas_udf("boolean")
    def matches(keys: pd.Series) -> pd.Series:
        """A matcher that a user brings; one that raises counts as no match."""
        try:
            return keys % 7 == 0
        except Exception:  # noqa: BLE001
            return pd.Series([False] * len(keys))

    return table(spark, sf, "customer").select("c_custkey", matches("c_custkey").alias("matched"))


@query("d6_overlapping_chunks", None)
def d6(spark, sf):
    chunks = text.overlapping_chunks(table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")), 300, 40)
    return chunks.select("doc_id", "chunk_index", "start_line", "end_line", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query("e2_similar_by_embedding", r"""
with t as (select item_id, regexp_extract_all(lower(text), '\S+') as w from benchmark),
g as (select item_id, unnest(w) as feature, 1.0::double as weight from t union all select item_id, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]), 0.5::double from t),
h as (select item_id, ('0x' || md5(feature)[31:32])::int as low, weight from g),
v as (select item_id, low % 128 as place, sum(case when low < 128 then weight else -weight end) as x from h group by all),
n as (select item_id, sqrt(sum(x * x)) as norm from v group by item_id),
s as (select a.item_id as query_id, b.item_id as vec_id, sum(a.x * b.x) as d from v a join v b using (place) where a.item_id % 20 = 0 and a.item_id <> b.item_id group by all),
r as (select query_id, vec_id, round(d / (q.norm * e.norm), 6) as score from s join n q on q.item_id = query_id join n e on e.item_id = vec_id)
select query_id, vec_id, score, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from r qualify rank <= 3""")
def e2(spark, sf):
    e = table(spark, sf, "benchmark").select(F.col("item_id").alias("vec_id"), md5_embedding(128)("text").alias("embedding"))
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return search.vector_top_k(e, asked, 3).select("query_id", "vec_id", "score", "rank")
