"""Queries over journaled batches, trees, and contexts of search hits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import context_pack, ignore_rules, tree
from ..operators import taint as T
from ..sources.journal import Journal
from ..sources.scratch import shared_folder, stored
from ..streaming import bounded, streams
from . import programs, searches
from .query import query, table


@query("h7_journaled_batches", "select event_id % 4 as batch, event_type, count(*)::bigint as n, round(sum(value), 4) as total from events where event_id % 4 < 2 group by all")
def h7_batches(spark, sf):
    # Of four batches two are committed, one fails and one is left pending; what is read has the two alone.
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    journal = Journal(spark, f"{shared_folder(spark).rstrip('/')}/journal-{uuid.uuid4().hex}", e.schema)
    for k in range(4):
        journal.begin(f"b{k}", e.where(F.col("event_id") % 4 == k), [f"part-{k}"])
    journal.commit("b0")
    journal.fail("b2", "stopped")
    journal.commit("b1")
    journal.recover()
    journal.purge(max_age=-1)
    return journal.read().groupBy((F.col("event_id") % 4).alias("batch"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


#: A forest of orders: 150 in a tree, each below one of the three before it, so trees are some 75 deep.
FOREST_SQL = """f as materialized (select o_orderkey // 150 as t, o_orderkey as i, case when o_orderkey % 150 > 0 then greatest(o_orderkey // 150 * 150, o_orderkey - 1 - o_orderkey % 3) end as p, 'n' || (o_custkey % 7) as ty from orders)"""


def forest(spark, sf):
    k = F.col("o_orderkey")
    root = F.floor(k / 150) * 150
    return table(spark, sf, "orders").select(F.floor(k / 150).alias("tree_id"), k.alias("node_id"), F.when(k % 150 > 0, F.greatest(root, k - 1 - k % 3)).alias("parent_id"), F.concat(F.lit("n"), F.col("o_custkey") % 7).alias("node_type"))


_WAYS_SQL = f"{FOREST_SQL}, w(t, i, way) as (select t, i, [i] from f where p is null or p not in (select i from f) union all select f.t, f.i, list_append(w.way, f.i) from f join w on f.p = w.i and f.t = w.t)"


@query("p27_interval_labels", f"""with recursive {_WAYS_SQL}, a as (select t, unnest(way) as i, way[len(way)] as d from w), s as (select t, i, count(*) as n from a group by t, i),
o as (select t, i, way, row_number() over (partition by t order by way) as first from w)
select o.t as tree_id, o.i as node_id, first::int as first, (first + n - 1)::int as last, (len(way) - 1)::int as depth, (row_number() over (partition by o.t order by len(way), first))::int as place from o join s on s.t = o.t and s.i = o.i""")
def p27_labels(spark, sf):
    return tree.breadth_first(tree.interval_labels(forest(spark, sf))).drop("way")


@query("p27_nearest_ancestor", f"""with recursive {_WAYS_SQL}, a as (select t, way[len(way)] as i, unnest(way[1:len(way) - 1]) as a, unnest(range(1, len(way))) as k from w),
n as (select a.t, a.i, arg_max(a.a, a.k) as x from a join f on f.t = a.t and f.i = a.a where f.ty = 'n3' group by a.t, a.i)
select w.t as tree_id, w.i as node_id, n.x as ancestor from w left join n on n.t = w.t and n.i = w.i""")
def p27_ancestor(spark, sf):
    nodes = forest(spark, sf)
    return tree.nearest_above(stored(tree.interval_labels(nodes)), nodes, "n3")


@query("p27_subtrees", f"with recursive {_WAYS_SQL}, a as (select t, unnest(way) as top, way[len(way)] as i from w) select a.t as tree_id, a.top, a.i as node_id from a join f on f.t = a.t and f.i = a.top where f.ty = 'n5'")
def p27_below(spark, sf):
    nodes = forest(spark, sf)
    return tree.below(stored(tree.interval_labels(nodes)), nodes.where("node_type = 'n5'"))


@query("p27_type_paths", f"with recursive {_WAYS_SQL}, a as (select t, way[len(way)] as i, unnest(way) as a, unnest(range(1, len(way) + 1)) as k from w) select a.t as tree_id, a.i as node_id, string_agg(f.ty, '/' order by k) as path from a join f on f.t = a.t and f.i = a.a group by a.t, a.i")
def p27_paths(spark, sf):
    nodes = forest(spark, sf)
    return tree.type_paths(stored(tree.interval_labels(nodes)), nodes).select("tree_id", "node_id", F.array_join("path", "/").alias("path"))


@query("p11_context", f"""with {searches._nearest_sql(5)}, {programs.CALLS_SQL},
text as materialized (select o as unit_id, 'def fn_' || o || '(' || case when o % 9 = 0 then 'request' else 'first' end || ', second: str = None):' || chr(10) || string_agg(case t when 0 then '    fn_' || callee || '(' || x1 || ', ' || x2 || ')' when 1 then '    ' || sink || '(' || x1 || ', 1)' when 2 then '    other = quote(' || x1 || ')' else '    note(' || x1 || ')' end, chr(10) order by k) as code from f group by o),
hit as (select query_id, vec_id as unit_id, rank from near where vec_id in (select unit_id from text)),
c as (select o, 'fn_' || callee as name, callee, min(k) as k from f where t = 0 group by o, callee union all select o, case t when 1 then sink when 2 then 'quote' else 'note' end, null, min(k) from f where t > 0 group by 1, 2),
n as (select *, row_number() over (partition by o order by k, name) as nth from c qualify nth <= 5),
m as (select query_id, callee as unit_id, min({{'r': rank, 'n': nth, 'u': hit.unit_id}}) as first from hit join n on o = hit.unit_id where callee in (select unit_id from text) group by query_id, callee),
r as (select m.query_id, m.unit_id, m.first, row_number() over (partition by m.query_id order by m.first) as place from m left join hit h on h.query_id = m.query_id and h.unit_id = m.unit_id where h.rank is null or h.rank > m.first.r)
select query_id, 'primary' as part, (row_number() over (partition by query_id order by rank))::int as place, hit.unit_id, null as relation, md5(code) as code_md5 from hit join text on text.unit_id = hit.unit_id
union all select query_id, 'related', place::int, r.unit_id, 'called by fn_' || r.first.u, md5(left(code, 500)) from r join text on text.unit_id = r.unit_id""")
def p11_pack(spark, sf):
    # Of the functions only those that a context may hold are written out and parsed.
    hits = stored(searches._nearest(spark, sf, 5).select("query_id", F.col("vec_id").alias("unit_id"), "rank"))
    hit_units = programs.calling_units(spark, sf, hits.select("unit_id").distinct())
    calls = T.call_arguments(hit_units).select("unit_id", "callee", F.col("call").alias("place"))
    packed = context_pack.context_pack(hits, programs.calling_heads(spark, sf), calls, code_of=lambda ids: programs.calling_units(spark, sf, ids).select("unit_id", "code"))
    return packed.withColumn("code_md5", F.md5(F.col("code").cast("binary"))).drop("code")


@query("n3_closed_windows", """with w as (select time_bucket(interval 1 hour, ts) as started, event_type, count(*)::bigint as n, round(sum(value), 4) as total from events group by 1, 2)
select * from w where started + interval 1 hour <= (select max(ts) - interval 2 hour from events)""")
def n3_closed(spark, sf):
    base = f"{shared_folder(spark).rstrip('/')}/windows-{uuid.uuid4().hex}"
    stream = bounded.closed_windows(streams.event_stream(spark, sf))
    bounded.append_to(stream, base)
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


@query("h6_bucket_merge", "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by user_id")
def h6_merge(spark, sf):
    stream = streams.event_stream(spark, sf).select("user_id", "event_id", "event_type")
    latest = bounded.LatestTable(spark, f"{shared_folder(spark).rstrip('/')}/latest-{uuid.uuid4().hex}", "user_id", "event_id", buckets=16)
    latest.follow(stream)
    return latest.read(stream.schema)


def tree_files(spark, sf):
    """A file for each order, three folders deep, and a rule file for some folders."""
    k = F.col("o_orderkey")
    r, m = F.concat(F.lit("r"), F.col("o_custkey") % 5), F.concat(F.lit("m"), F.col("o_custkey") % 7)
    suffix = F.element_at(F.array(*map(F.lit, (".py", ".pyc", ".log", ".go"))), (k % 4 + 1).cast("int"))
    files = table(spark, sf, "orders").select(F.concat(r, F.lit("/"), m, F.lit("/d"), k % 11, F.lit("/f"), k, suffix).alias("path"), F.floor("o_totalprice").alias("length"))
    folders = files.select(F.explode(F.array(F.lit(""), F.substring_index("path", "/", 1), F.substring_index("path", "/", 2))).alias("folder")).distinct()
    text = (
        F.when(F.col("folder") == "", "# top\nd3/\nr1/m2\n\n**/d5/f?.py")
        .when(F.col("folder").rlike("^r[024]$"), "!*.pyc\n*.log\n/m4/d[0-2]/")
        .when(F.col("folder").rlike("^r[0-4]/m3$"), "f*7.*\n!f*17.py\n!d3/")
    )
    return files, folders.select("folder", text.alias("content"))


@query("a1_scan_with_rules", """
with f as (select o_orderkey as k, o_custkey % 5 as r, o_custkey % 7 as m, o_orderkey % 11 as d, o_orderkey % 4 as s, floor(o_totalprice)::bigint as length from orders),
p as (select *, 'r' || r || '/m' || m || '/d' || d || '/f' || k || (['.py', '.pyc', '.log', '.go'])[s + 1] as path from f),
g as (select *, case
  when r = 1 and m = 2 then true when d = 3 and m <> 3 then true when r % 2 = 0 and m = 4 and d <= 2 then true
  when m = 3 and k % 10 = 7 then not (k % 100 = 17 and s = 0)
  when r % 2 = 0 and s in (1, 2) then s = 2
  when d = 5 and k < 10 and s = 0 then true
  else s = 1 end as ignored from p)
select path, length, case when ignored then 'ignored' when s not in (0, 1) then 'extension' when length / 1024.0::double > 150 then 'size' end as reason from g""")
def a1_rules(spark, sf):
    files, rule_files = tree_files(spark, sf)
    return ignore_rules.scan(files, rule_files, (".py", ".pyc"), 150)
