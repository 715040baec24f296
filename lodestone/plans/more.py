"""Further parsers, stores, fallbacks and extension points."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.embeddings import hash_embedding
from ..operators import graph as G
from ..operators import parsing, rules, search
from ..sources import readers
from ..sources.scratch import shared_folder
from . import graphs
from .query import SITES_SQL, UNITS_SQL, pages, query, sites, table, units
from .sources_and_parsers import _sources


@query("a8_rule_source", "select rule_id, category, k as load_order from (select 'r' || p_size as rule_id, p_type as category, p_partkey::bigint as k, row_number() over (partition by p_size order by p_partkey desc) as n from part where p_name <> '') where n = 1")
def a8(spark, sf):
    # A rule file is a JSON line here; one that doesn't parse is skipped, and of rules with one id the last stays.
    raw = table(spark, sf, "part").select(F.when(F.col("p_name") != "", F.to_json(F.struct(F.concat(F.lit("r"), "p_size").alias("id"), F.col("p_type").alias("category"), F.col("p_partkey").alias("k")))).otherwise("{bad").alias("line"))
    r = F.from_json("line", "id string, category string, k long")
    loaded = raw.select(r["id"].alias("rule_id"), r["category"].alias("category"), r["k"].alias("load_order")).where("rule_id is not null")
    return loaded.withColumn("n", F.row_number().over(Window.partitionBy("rule_id").orderBy(F.desc("load_order")))).where("n = 1").drop("n")


@query("a12_unit_store", f"with {UNITS_SQL} select language, count(*)::bigint as n, sum(length(code))::bigint as n_chars from units group by language")
def a12(spark, sf):
    import uuid

    path = f"{shared_folder(spark).rstrip('/')}/units-{uuid.uuid4().hex}"
    readers.write_units(units(spark, sf), path)
    return spark.read.parquet(path).groupBy("language").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("code")).alias("n_chars"))


@query("c3_javascript_units", "select doc_id as file_id, 'load' || doc_id as symbol, 'handler' as unit_type, 1::int as start_line from documents union all select doc_id, 'step' || doc_id, 'function', 4::int from documents")
def c3(spark, sf):
    i = F.col("doc_id")
    code = F.concat(F.lit("function load"), i, F.lit("(req, res) {\n  return 1;\n}\nconst step"), i, F.lit(" = async (req) => {\n};\n"))
    return parsing.javascript_units(table(spark, sf, "documents").select(i.alias("file_id"), code.alias("content")))


@query("c6_fallback_best", "select doc_id as file_id, case when doc_id % 50 = 0 then 'regex' else 'tree' end as source, case when doc_id % 50 = 0 then 3 else 2 end::bigint as n_units from documents")
def c6(spark, sf):
    files = _sources(spark, sf)
    tree = parsing.parse_python(files).where("parent_class is null").groupBy("file_id").agg(F.count(F.lit(1)).alias("tree"))
    heads = files.select("file_id", F.regexp_count("content", F.lit("(?m)^(def|class) ")).cast("long").alias("regex"))
    best = heads.join(tree, "file_id", "left")
    return best.select("file_id", F.when(F.col("tree").isNull(), "regex").otherwise("tree").alias("source"), F.coalesce("tree", "regex").alias("n_units"))


@query("d5_smart_split", None)
def d5(spark, sf):
    parts = parsing.split_oversized(table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content")), 300)
    return parts.select("file_id", "part", "start_line", "end_line", C.tokens_flat("chunk").alias("tokens"))


@query("e4_batched_embedding", "select lang, count(*)::bigint as n, greatest(10, least(300, floor(8191 * 0.8::double / (avg(n_chars) / 4))))::bigint as batch from documents group by lang")
def e4(spark, sf):
    # Arrow batches carry the texts; the batch size for a service follows from their mean length.
    d = table(spark, sf, "documents").select("lang", "n_chars", F.size(hash_embedding(16)("text")).alias("dim"))
    batch = F.greatest(F.lit(10), F.least(F.lit(300), F.floor(F.lit(8191) * F.lit(0.8) / (F.avg("n_chars") / 4))))
    return d.groupBy("lang").agg(F.count_if(F.col("dim") == 16).alias("n"), batch.cast("long").alias("batch"))


CALL_PATTERNS = (("p-track", "tracking", "medium", (), ("track",)), ("p-code", "injection", "critical", (), ("eval", "exec")), ("p-log", "logging", "low", (), ("log",)), ("p-php", "injection", "high", ("php",), ("system", "track")))


@query("f7_security_patterns", r"""
with c as (select distinct page_id, unnest(regexp_extract_all(html, '([A-Za-z_][A-Za-z0-9_.]*)\(', 1)) as callee from pages),
p(pattern_id, severity, name) as (values ('p-track', 'medium', 'track'), ('p-code', 'critical', 'eval'), ('p-code', 'critical', 'exec'))
select distinct page_id as file_id, callee, pattern_id, severity from c join p on name = callee or name = split_part(callee, '.', -1)""")
def f7(spark, sf):
    calls = parsing.calls_of(pages(spark, sf)).distinct()
    found = rules.match_calls(calls, CALL_PATTERNS, "javascript", ("tracking", "injection", "logging"), "medium")
    return found.select("file_id", "callee", "pattern_id", "severity")


@query("l15_cross_function_sinks", f"""with recursive {graphs.GRAPH_SQL}, t(param, origin, depth) as (select id, id, 0 from nodes where node_type = 'source' union select dst, origin, depth + 1 from t join edges on param = src where depth < 4)
select n.id as sink, min(t.depth)::int as depth, round(least(0.95, 0.6::double + 0.05::double * (4 - min(t.depth))), 6) as confidence from t join nodes n on n.id = t.param where n.node_type = 'sink' group by n.id""")
def l15(spark, sf):
    n = graphs.nodes(spark, sf)
    known = G.propagate(graphs.edges(spark, sf).distinct(), n.where("node_type = 'source'").select(F.col("id").alias("param")), 4)
    hit = known.join(n.where("node_type = 'sink'").select(F.col("id").alias("param")), "param")
    return hit.select(F.col("param").alias("sink"), "depth", F.round(F.least(F.lit(0.95), F.lit(0.6) + F.lit(0.05) * (4 - F.col("depth"))), 6).alias("confidence"))


@query("l16_property_graph", "select doc_id as file_id, 2::bigint as functions, 1::bigint as classes, (2 + (doc_id % 3 = 0)::int + 1)::bigint as calls from documents where doc_id % 50 <> 0")
def l16(spark, sf):
    n = parsing.property_graph(_sources(spark, sf))
    count = lambda t: F.count_if(F.col("node_type") == t)
    return n.groupBy("file_id").agg(count("FunctionDef").alias("functions"), count("ClassDef").alias("classes"), count("Call").alias("calls"))


@query("m3_multi_stage", f"with {SITES_SQL}, t as (select *, risk_rank >= 3 or confidence >= 0.5 as triaged, confidence >= 0.6 as deep from sites) select case when not triaged then 'dismissed' when not deep then 'needs_review' else 'verified' end as verdict, count(*)::bigint as n from t group by 1")
def m3(spark, sf):
    triaged = (C.risk_rank("risk_level") >= 3) | (F.col("confidence") >= 0.5)
    return sites(spark, sf).groupBy(F.when(~triaged, "dismissed").when(F.col("confidence") < 0.6, "needs_review").otherwise("verified").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("n6_priority_order", "select user_id, event_id, (row_number() over (partition by user_id order by case event_type when 'error' then 0 when 'purchase' then 1 else 2 end, ts, event_id))::int as place from events")
def n6(spark, sf):
    t = F.col("event_type")
    order = Window.partitionBy("user_id").orderBy(F.when(t == "error", 0).when(t == "purchase", 1).otherwise(2), "ts", "event_id")
    return table(spark, sf, "events").select("user_id", "event_id", F.row_number().over(order).alias("place"))


@query("o3_pluggable_parser", "select page_id as file_id, 'title' as kind, regexp_extract(html, '<title>([^<]*)</title>', 1) as symbol from pages union all select doc_id, 'heading', string_split(text, chr(10))[1] from documents")
def o3(spark, sf):
    # A parser is a function of DataFrames, registered by extension; benchmark items have an extension that none is registered for.
    f = lambda name, i, content, extension: table(spark, sf, name).select(F.col(i).alias("file_id"), F.concat(F.lit(f"{name}/"), i, F.lit(extension)).alias("path"), F.col(content).alias("content"))
    files = f("pages", "page_id", "html", ".HTML").unionByName(f("documents", "doc_id", "text", ".txt")).unionByName(f("benchmark", "item_id", "text", ".bin"))
    registry = {
        "html": lambda rows: rows.select("file_id", F.lit("title").alias("kind"), F.regexp_extract("content", "<title>([^<]*)</title>", 1).alias("symbol")),
        "txt": lambda rows: rows.select("file_id", F.lit("heading").alias("kind"), F.substring_index("content", "\n", 1).alias("symbol")),
    }
    return parsing.parse_by_extension(files, registry)


@query("p11_context_pack", f"""with {graphs.CALLS_SQL}, hits as (select caller from calls where name = 'the' group by caller),
c as (select caller, name, row_number() over (partition by caller order by name) as k from calls where caller in (select caller from hits)) select caller, name as callee from c where k <= 5""")
def p11(spark, sf):
    calls = graphs.calls(spark, sf)
    hits = calls.where("name = 'the'").select("caller").distinct()
    first = calls.join(hits, "caller", "left_semi").withColumn("k", F.row_number().over(Window.partitionBy("caller").orderBy("name")))
    return first.where("k <= 5").select("caller", F.col("name").alias("callee"))


@query("p25_isolated_map", "select doc_id as file_id, case when doc_id % 50 = 0 then 0 else 3 end::bigint as n_units, case when doc_id % 50 = 0 then 'SyntaxError' end as error from documents")
def p25(spark, sf):
    return parsing.isolated(_sources(spark, sf))


@query("p28_dotted_names", "select doc_id as file_id, 'os.system' as name from documents where doc_id % 50 <> 0")
def p28(spark, sf):
    calls = parsing.property_graph(_sources(spark, sf)).where("node_type = 'Call'")
    return calls.where(F.contains("name", F.lit("os."))).select("file_id", "name")


@query("p31_tainted_parameters", "select doc_id as file_id, 'request' as parameter, true as tainted from documents")
def p31(spark, sf):
    heads = _sources(spark, sf).select("file_id", F.explode(C.lines("content")).alias("line")).where(F.startswith("line", F.lit("def ")))
    names = heads.withColumn("parameter", F.explode(parsing.call_arguments("line")))
    return names.select("file_id", "parameter", F.col("parameter").isin("request", "req").alias("tainted"))


@query("p45_category_files", "select p_type as category, count(*)::bigint as n from part group by p_type")
def p45(spark, sf):
    import uuid

    path = f"{shared_folder(spark).rstrip('/')}/rules-{uuid.uuid4().hex}"
    table(spark, sf, "part").select(F.col("p_type").alias("category"), "p_partkey").write.partitionBy("category").parquet(path)
    return spark.read.parquet(path).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("p3_batch_contexts", f"with {SITES_SQL} select unit_id, line_start, category, place from (select unit_id, line_start, category, (row_number() over (partition by unit_id order by risk_rank desc, confidence desc, seq))::int as place from sites) where place <= 3")
def p3(spark, sf):
    best = Window.partitionBy("unit_id").orderBy(C.risk_rank("risk_level").desc(), F.desc("confidence"), "seq")
    return sites(spark, sf).withColumn("place", F.row_number().over(best)).where("place <= 3").select("unit_id", "line_start", "category", "place")


@query("o6_score_extractor", "select vec_id, round(list_sum([x::double * x::double for x in embedding]), 6) as score from embeddings order by score desc, vec_id limit 25")
def o6(spark, sf):
    # The caller brings the score as a column.
    return search.top(table(spark, sf, "embeddings").select("vec_id", F.round(C.dot("embedding", "embedding"), 6).alias("score")), 25, "vec_id").drop("rank")


@query("o1_rule_extension", f"with {UNITS_SQL} select 'own' as rule_id, count(*)::bigint as n from units where regexp_matches(lower(code), 'warranty|licensed')")
def o1(spark, sf):
    added = ("own", "license", "low", "warranty|licensed")
    found = rules.scan_units(units(spark, sf), [added])
    return found.groupBy("rule_id").agg(F.count_distinct("unit_id").alias("n"))
