"""Queries over line ranges: search results of two sources as events give them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals
from .query import query, table

#: A result for each event: a range of up to nine of 50,000 lines in the file of its user, found by words or by vectors.
RANGES_SQL = """rs as materialized (
  select event_id as seq, 'src/u' || user_id || '.py' as file_path, ((event_id * 7919) % 600 * 12 + event_id % 3)::int as start_line, ((event_id * 7919) % 600 * 12 + event_id % 3 + event_id % 9)::int as end_line,
    round(0.2::double + (event_id * 31 % 71) / 100::double, 6) as score, case when event_type in ('click', 'view') then 'vector' else 'keyword' end as source from events)"""


def results(spark, sf):
    i = F.col("event_id")
    start = (i * 7919) % 600 * 12 + i % 3
    return table(spark, sf, "events").select(
        i.alias("seq"), F.concat(F.lit("src/u"), "user_id", F.lit(".py")).alias("file_path"), start.cast("int").alias("start_line"), (start + i % 9).cast("int").alias("end_line"),
        F.round(F.lit(0.2) + (i * 31 % 71) / F.lit(100), 6).alias("score"), F.when(F.col("event_type").isin("click", "view"), "vector").otherwise("keyword").alias("source"),
    )


@query("j7_overlap_runs", f"""with {RANGES_SQL},
m as (select *, max(end_line) over (partition by file_path order by start_line, end_line, seq rows between unbounded preceding and 1 preceding) as far from rs),
b as (select *, case when far is null or start_line > far then start_line end as begins from m)
select seq, (last_value(begins ignore nulls) over (partition by file_path order by start_line, end_line, seq rows between unbounded preceding and current row))::int as run from b""")
def j7_runs(spark, sf):
    return intervals.overlap_runs(results(spark, sf)).select("seq", "run")


@query("j7_overlapping_pairs", f"with {RANGES_SQL} select a.seq as a, b.seq as b from rs a join rs b on a.file_path = b.file_path and a.seq < b.seq and a.start_line <= b.end_line and b.start_line <= a.end_line")
def j7_pairs(spark, sf):
    return intervals.overlapping_pairs(results(spark, sf), "seq")


_KEPT = "{'k': s || '-' || e, 's': s, 'e': e, 'x': x, 'src': src}"


@query("j7_overlap_merge", f"""with recursive {RANGES_SQL},
o as materialized (select file_path, row_number() over (partition by file_path order by seq) as n, start_line as s, end_line as e, score as x, source as src from rs),
fold(file_path, n, kept) as (
  select file_path, 1::bigint, [{_KEPT}] from o where n = 1
  union all
  select f.file_path, o.n, case
    when list_contains([k.k for k in f.kept], o.s || '-' || o.e) then [case when k.k = o.s || '-' || o.e then {{'k': k.k, 's': k.s, 'e': k.e, 'x': (k.x + o.x * 0.5::double) * case when o.src <> k.src then 1.2::double else 1.0::double end, 'src': case when contains(k.src, o.src) then k.src else k.src || '+' || o.src end}} else k end for k in f.kept]
    when len([k for k in f.kept if k.s <= o.e and o.s <= k.e]) > 0 then [case when k.k = [j for j in f.kept if j.s <= o.e and o.s <= j.e][1].k and o.x > k.x then {{'k': k.k, 's': o.s, 'e': o.e, 'x': o.x, 'src': o.src}} else k end for k in f.kept]
    else list_append(f.kept, {_KEPT.replace("s || '-' || e", "o.s || '-' || o.e").replace("'s': s", "'s': o.s").replace("'e': e", "'e': o.e").replace("'x': x", "'x': o.x").replace("'src': src", "'src': o.src")}) end
  from fold f join o on o.file_path = f.file_path and o.n = f.n + 1),
last as (select file_path, unnest(kept) as k from fold qualify n = max(n) over (partition by file_path))
select file_path, k.s as start_line, k.e as end_line, round(k.x, 6) as score, k.src as source from last""")
def j7_merge(spark, sf):
    return intervals.hybrid_merge(results(spark, sf)).withColumn("score", F.round("score", 6))
