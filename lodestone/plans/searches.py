"""Search and incremental state: queries over documents, embeddings, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import incremental as inc
from ..operators import search, similar
from ..sources.scratch import stored
from .query import PAGES_SQL, SITES_SQL, UNITS_SQL, pages, query, sites, table, units

_COS = "list_sum([p[1]::double * p[2]::double for p in list_zip({a}, {b})]) / (sqrt(list_sum([x::double * x::double for x in {a}])) * sqrt(list_sum([x::double * x::double for x in {b}])) + 1e-10)"
WORDS = ("the", "token", "licensed")


def _nearest(spark, sf, k, every=20, least=None):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    asked = e.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("label").alias("q_label"))
    return search.vector_top_k(e, asked, k, least)


def _nearest_sql(k, every=20, where="true"):
    return f"""near as (select * from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from (
    select q.vec_id as query_id, e.vec_id, e.label, q.label as q_label, round({_COS.format(a='e.embedding', b='q.embedding')}, 6) as score
    from embeddings e join embeddings q on q.vec_id % {every} = 0 and e.vec_id <> q.vec_id) where {where}) where rank <= {k})"""


@query("j1_vector_top_k", f"with {_nearest_sql(10)} select query_id, vec_id, score, rank::int as rank from near")
def j1(spark, sf):
    return _nearest(spark, sf, 10).select("query_id", "vec_id", "score", "rank")


@query("j13_filtered_similarity", f"with {_nearest_sql(20, where='score >= 0.1')} select query_id, vec_id, score from near where label <> q_label")
def j13(spark, sf):
    return _nearest(spark, sf, 20, least=0.1).where(F.col("label") != F.col("q_label")).select("query_id", "vec_id", "score")


@query("g11_known_sinks", f"with {_nearest_sql(10)} select query_id, vec_id, label in (select label from embeddings where vec_id % 97 = 0) as known from near")
def g11(spark, sf):
    known = table(spark, sf, "embeddings").where("vec_id % 97 = 0").select("label").distinct().withColumn("known", F.lit(True))
    return _nearest(spark, sf, 10).join(known, "label", "left").select("query_id", "vec_id", F.coalesce("known", F.lit(False)).alias("known"))


@query("g10_clone_pairs", f"""
select a.vec_id as a, b.vec_id as b, round(list_sum([p[1]::double * p[2]::double for p in list_zip(a.embedding, b.embedding)]) / (sqrt(list_sum([x::double * x::double for x in a.embedding])) * sqrt(list_sum([x::double * x::double for x in b.embedding]))), 6) as score
from embeddings a join embeddings b on a.vec_id < b.vec_id where round(list_sum([p[1]::double * p[2]::double for p in list_zip(a.embedding, b.embedding)]) / (sqrt(list_sum([x::double * x::double for x in a.embedding])) * sqrt(list_sum([x::double * x::double for x in b.embedding]))), 6) >= 0.4""")
def g10(spark, sf):
    return similar.similar_pairs(table(spark, sf, "embeddings").select("vec_id", "embedding"), 0.4)


def _words(spark, sf):
    return search.keyword_scores(units(spark, sf), WORDS)


_WORD_SQL = f"""{UNITS_SQL}, ks as (select unit_id, round(({' + '.join(f"case when len(regexp_extract_all(' ' || regexp_replace(lower(code), '([^A-Za-z0-9_])', chr(92) || '1' || chr(92) || '1', 'g') || ' ', '[^A-Za-z0-9_]{w}[^A-Za-z0-9_]')) > 0 then len(regexp_extract_all(' ' || regexp_replace(lower(code), '([^A-Za-z0-9_])', chr(92) || '1' || chr(92) || '1', 'g') || ' ', '[^A-Za-z0-9_]{w}[^A-Za-z0-9_]'))::double when contains(lower(code), '{w}') then 0.5::double else 0.0::double end" for w in WORDS)}) / 3, 6) as score from units),
  kw as (select unit_id, score, row_number() over (order by score desc, unit_id) - 1 as rank from ks where score > 0 qualify rank < 20),
  lens as (select unit_id, round({_COS.format(a='e.embedding', b='q.embedding')}, 6) as score from embeddings e join units on unit_id = e.vec_id join embeddings q on q.vec_id = 0 and e.vec_id <> 0),
  vec as (select unit_id, score, row_number() over (order by score desc, unit_id) - 1 as rank from lens qualify rank < 20)"""


def _unit_vectors(spark, sf):
    """vec_id, embedding, symbol, language, file_path of the units that have a vector."""
    named = units(spark, sf).select(F.col("unit_id").alias("vec_id"), "symbol", "language", "file_path")
    return table(spark, sf, "embeddings").select("vec_id", "embedding").join(named, "vec_id")


def _asked(spark, sf, condition="vec_id % 20 = 0"):
    return table(spark, sf, "embeddings").where(condition).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def _arms(spark, sf):
    """The 20 units nearest to the vector of number 0, and the 20 best by keywords."""
    near = search.vector_top_k(_unit_vectors(spark, sf), _asked(spark, sf, "vec_id = 0"), 20)
    return near.select(F.col("vec_id").alias("unit_id"), "score", (F.col("rank") - 1).alias("rank")), search.top(_words(spark, sf).select("unit_id", "score"), 20, "unit_id")


_UNIT_NEAR_SQL = f"""{UNITS_SQL}, near as (select query_id, unit_id, symbol, score, (row_number() over (partition by query_id order by score desc, unit_id))::int as rank from (
  select q.vec_id as query_id, unit_id, symbol, round({_COS.format(a='e.embedding', b='q.embedding')}, 6) as score from embeddings e join units on unit_id = e.vec_id join embeddings q on q.vec_id % 20 = 0 and q.vec_id <> e.vec_id where {{where}}))"""


@query("p9_semantic_search", f"with {_UNIT_NEAR_SQL.format(where=chr(39).join(('language = ', 'en', ' and starts_with(file_path, ', 'src1/', ')')))} select query_id, unit_id, symbol, score, rank from near where rank <= 5")
def p9(spark, sf):
    store = _unit_vectors(spark, sf).where((F.col("language") == "en") & C.matches_glob("file_path", "src1/*"))
    return search.vector_top_k(store, _asked(spark, sf), 5).select("query_id", F.col("vec_id").alias("unit_id"), "symbol", "score", "rank")


@query("p10_search_then_filter", f"with {_UNIT_NEAR_SQL.format(where='true')} select query_id, unit_id, symbol, rank from near where rank <= 30 and contains(symbol, '1')")
def p10(spark, sf):
    # First the 30 nearest, then the filter: a query may keep fewer than match in the whole store.
    near = search.vector_top_k(_unit_vectors(spark, sf), _asked(spark, sf), 30)
    return near.where(F.contains("symbol", F.lit("1"))).select("query_id", F.col("vec_id").alias("unit_id"), "symbol", "rank")


@query("j3_keyword_top_k", f"with {_WORD_SQL} select unit_id, score, rank::int as rank from kw")
def j3(spark, sf):
    return _arms(spark, sf)[1]


_FUSED_SQL = f"""{_WORD_SQL}, fused as (select unit_id, round(sum(s), 9) as score, case when count(distinct source) > 1 then 'both' else min(source) end as source from (
  select unit_id, 1.0::double / (60 + rank) as s, 'vector' as source from vec union all select unit_id, 0.8::double / (60 + rank), 'keyword' from kw) group by unit_id)"""


@query("j4_rank_fusion", f"with {_FUSED_SQL} select unit_id, score, source, (row_number() over (order by score desc, unit_id) - 1)::int as rank from fused")
def j4(spark, sf):
    return search.rrf(*_arms(spark, sf), "unit_id")


@query("j5_score_normalisation", f"with {_WORD_SQL} select unit_id, round(score * (select max(score) from vec) / (select max(score) from kw), 6) as score from kw")
def j5(spark, sf):
    vec, kw = _arms(spark, sf)
    one = F.lit(1).alias("one")
    most = vec.agg(F.max("score").alias("v"), one).join(kw.agg(F.max("score").alias("k"), one), "one")
    return kw.withColumn("one", F.lit(1)).join(most, "one").select("unit_id", F.round(F.col("score") * F.col("v") / F.col("k"), 6).alias("score"))


@query("j6_smart_cutoff", f"""
with {_WORD_SQL}, p as (select *, rank + 1 as place, max(score) over () as top from vec),
o as (select *, case when top < 0.3 then place = 1 when place <= 3 then score >= 0.3 else score >= greatest(0.3, least(0.7 * top, top - 0.2)) end as ok from p)
select unit_id, score from (select *, bool_and(ok) over (order by score desc, unit_id) as so_far from o) where so_far and place <= 20""")
def j6(spark, sf):
    return search.smart_cutoff(_arms(spark, sf)[0], "unit_id").select("unit_id", "score")


@query("h9_location_dedup", f"with {SITES_SQL} select seq, file_path, line_start, confidence from (select *, row_number() over (partition by file_path, line_start order by confidence desc, seq) as k from sites) where k = 1")
def h9(spark, sf):
    return search.best_by_location(sites(spark, sf), ("file_path", "line_start"), "confidence", "seq").select("seq", "file_path", "line_start", "confidence")


_PART_SQL = "f as (select p_partkey, round(p_size / 50.0::double, 6) as vector, round((p_partkey % 10) / 10.0::double, 6) as keyword, round((p_partkey % 7) / 7.0::double, 6) as security, round((p_partkey % 3) / 3.0::double, 6) as context from part)"


def _factors(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", F.round(F.col("p_size") / F.lit(50.0), 6).alias("vector"), *(F.round((k % n) / F.lit(float(n)), 6).alias(c) for n, c in ((10, "keyword"), (7, "security"), (3, "context"))))


@query("j8_multi_factor_rerank", f"with {_PART_SQL}, s as (select p_partkey, round(case when security > 0.5 then (0.4::double * vector + 0.25::double * keyword + 0.2::double * security + 0.15::double * context) * 1.5::double else 0.4::double * vector + 0.25::double * keyword + 0.2::double * security + 0.15::double * context end, 6) as score from f) select p_partkey, score, (row_number() over (order by score desc, p_partkey))::int as rank from s order by rank limit 50")
def j8(spark, sf):
    return search.rerank(_factors(spark, sf), (0.4, 0.25, 0.2, 0.15), 1.5, 0.5, "p_partkey", 50).select("p_partkey", "score", "rank")


@query("j9_security_first_rerank", f"with {_PART_SQL}, s as (select p_partkey, round(case when security > 0.6 then (0.35::double * vector + 0.2::double * keyword + 0.3::double * security + 0.15::double * context) * 1.8::double else 0.35::double * vector + 0.2::double * keyword + 0.3::double * security + 0.15::double * context end, 6) as score from f) select p_partkey, score, (row_number() over (order by score desc, p_partkey))::int as rank from s order by rank limit 50")
def j9(spark, sf):
    return search.rerank(_factors(spark, sf), (0.35, 0.2, 0.3, 0.15), 1.8, 0.6, "p_partkey", 50).select("p_partkey", "score", "rank")


@query("j11_hybrid_boost", f"with {_PART_SQL}, near as (select * from f order by vector desc, p_partkey limit 60) select p_partkey, round(0.7::double * vector + 0.3::double * keyword, 6) as score from near order by score desc, p_partkey limit 20")
def j11(spark, sf):
    near = _factors(spark, sf).orderBy(F.desc("vector"), "p_partkey").limit(60)
    return near.select("p_partkey", F.round(F.lit(0.7) * F.col("vector") + F.lit(0.3) * F.col("keyword"), 6).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(20)


@query("j12_enhanced_score", f"""
with {SITES_SQL} select seq, round(least(1.0, greatest(0.0, 0.2::double * confidence + 0.2::double * risk_rank / 4 + case when seq % 3 = 0 then 0.15 else 0 end::double - case when seq % 5 = 0 then 0.05 else 0 end::double + case when seq % 2 = 0 then 0.25 else 0 end::double)), 6) as score from sites""")
def j12(spark, sf):
    n = F.col("seq")
    score = F.lit(0.2) * F.col("confidence") + F.lit(0.2) * C.risk_rank("risk_level") / 4 + F.when(n % 3 == 0, 0.15).otherwise(0.0) - F.when(n % 5 == 0, 0.05).otherwise(0.0) + F.when(n % 2 == 0, 0.25).otherwise(0.0)
    return sites(spark, sf).select("seq", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)), 6).alias("score"))


@query("p12_boosted_search", f"with {_WORD_SQL} select k.unit_id, round(case when regexp_matches(lower(code), 'password|token') then score * 1.5 else score end, 6) as score from kw k join units u using (unit_id)")
def p12(spark, sf):
    hits = search.top(_words(spark, sf), 20, "unit_id")
    return hits.select("unit_id", F.round(F.when(F.lower("code").rlike("password|token"), F.col("score") * 1.5).otherwise(F.col("score")), 6).alias("score"))


@query("p14_keyset_page", "select event_id, event_type from events where event_id > 1000 order by event_id limit 100")
def p14(spark, sf):
    return table(spark, sf, "events").where("event_id > 1000").orderBy("event_id").limit(100).select("event_id", "event_type")


_SNAP_SQL = """o as (select source || '/' || doc_id as path, md5(text) as hash from documents where doc_id % 11 <> 0),
n as (select source || '/' || doc_id as path, case when doc_id % 7 = 0 then md5(text || '!') else md5(text) end as hash from documents where doc_id % 13 <> 0)"""


def _snapshots(spark, sf):
    d = table(spark, sf, "documents")
    path = F.concat("source", F.lit("/"), "doc_id").alias("path")
    old = d.where("doc_id % 11 <> 0").select(path, F.md5(F.col("text").cast("binary")).alias("hash"), "doc_id")
    new = d.where("doc_id % 13 <> 0").select(path, F.when(F.col("doc_id") % 7 == 0, F.md5(F.concat("text", F.lit("!")).cast("binary"))).otherwise(F.md5(F.col("text").cast("binary"))).alias("hash"))
    return old, new


_STATUS_SQL = f"""{_SNAP_SQL}, c as (select coalesce(o.path, n.path) as path, case when o.path is null then 'new' when n.path is null then 'deleted' when o.hash <> n.hash then 'modified' else 'unchanged' end as status from o full join n on o.path = n.path)"""


@query("h1_change_detection", f"with {_STATUS_SQL} select path, status from c")
def h1(spark, sf):
    return inc.changes(*_snapshots(spark, sf)).select("path", "status")


@query("h2_incremental_plan", f"with {_STATUS_SQL} select c.path, case status when 'new' then 'add' when 'modified' then 'update' when 'deleted' then 'delete' else 'keep' end as action, count(o.path)::bigint as units from c left join o on c.path = o.path group by c.path, status")
def h2(spark, sf):
    old, new = _snapshots(spark, sf)
    return inc.plan(inc.changes(old, new), old.select("path", F.col("doc_id").alias("unit_id")))


_KEY_SQL = "sha256(regexp_replace(trim(code, ' ' || chr(9) || chr(10) || chr(13)), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))[1:16]"


@query("h3_content_dedup", f"with {UNITS_SQL} select {_KEY_SQL} as key, min(unit_id) as canonical, count(*)::bigint as n_units, count(distinct file_path)::bigint as n_files from units group by 1")
def h3(spark, sf):
    return inc.dedup_content(units(spark, sf))


@query("h4_reference_removal", f"with {UNITS_SQL} select {_KEY_SQL} as key, count(*)::bigint as n_units from units where not starts_with(file_path, 'src1/') group by 1")
def h4(spark, sf):
    return inc.dedup_content(units(spark, sf).where(~F.startswith("file_path", F.lit("src1/")))).select("key", "n_units")


@query("h5_shards", f"with {UNITS_SQL} select 'lang_' || language as by_language, 'dir_' || string_split(file_path, '/')[1] as by_folder, count(*)::bigint as n from units group by 1, 2")
def h5(spark, sf):
    a, b = inc.shard("language", "file_path")
    return units(spark, sf).groupBy(a.alias("by_language"), b.alias("by_folder")).agg(F.count(F.lit(1)).alias("n"))


@query("h8_stale_files", "select event_id, (epoch_us(ts) // 1000000 - 1704067200 - event_id * 250)::bigint as stale_seconds from events where epoch_us(ts) // 1000000 - 1704067200 - event_id * 250 > 0")
def h8(spark, sf):
    stale = F.unix_timestamp("ts") - 1704067200 - F.col("event_id") * 250
    return table(spark, sf, "events").select("event_id", stale.alias("stale_seconds")).where("stale_seconds > 0")


@query("h10_fingerprint_dedup", f"with {SITES_SQL} select seq, key from (select seq, coalesce(nullif(case when seq % 4 = 0 then '' else 'fp' || seq % 300 end, ''), file_path || ':' || line_start || ':' || rule_id) as key, row_number() over (partition by coalesce(nullif(case when seq % 4 = 0 then '' else 'fp' || seq % 300 end, ''), file_path || ':' || line_start || ':' || rule_id) order by seq) as k from sites) where k = 1")
def h10(spark, sf):
    fingerprint = F.when(F.col("seq") % 4 == 0, "").otherwise(F.concat(F.lit("fp"), F.col("seq") % 300))
    key = F.coalesce(F.nullif(fingerprint, F.lit("")), F.concat_ws(":", "file_path", F.col("line_start").cast("string"), "rule_id"))
    return inc.latest(sites(spark, sf).withColumn("key", key), "key", F.col("seq")).select("seq", "key")


@query("h11_candidate_dedup", f"with {SITES_SQL} select unit_id, seq, confidence from (select *, row_number() over (partition by unit_id order by seq) as k from sites) where k = 1 order by confidence desc, unit_id limit 40")
def h11(spark, sf):
    return inc.latest(sites(spark, sf), "unit_id", F.col("seq")).orderBy(F.desc("confidence"), "unit_id").limit(40).select("unit_id", "seq", "confidence")


@query("e7_cache_lookup", "select page_id as id, sha256(html) in (select sha256(html) from pages where page_id % 3 = 0) as hit from pages")
def e7(spark, sf):
    p = table(spark, sf, "pages")
    cache = p.where("page_id % 3 = 0").select(F.sha2(F.col("html").cast("binary"), 256).alias("content_hash"))
    return inc.cache_lookup(p.select(F.col("page_id").alias("id"), F.col("html").alias("text")), cache).select("id", "hit")


@query("e8_cache_eviction", "select event_id as id from (select *, row_number() over (order by ts, event_id) as k, count(*) over () as n from events) where k > case when n > 5000 then greatest(n - 5000, 500) else 0 end")
def e8(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("accessed_at"))
    return inc.evict(e, 5000, e.count()).select("id")


@query("e9_cache_statistics", "select count(*)::bigint as total, count(*) filter (ts < timestamp '2024-01-10')::bigint as expired, count(*) filter (event_type = 'view')::bigint as hits, count(*) filter (event_type = 'click')::bigint as misses, round(count(*) filter (event_type = 'view') / greatest(count(*) filter (event_type in ('view', 'click')), 1)::double, 6) as hit_rate from events")
def e9(spark, sf):
    hits, misses = F.count_if(F.col("event_type") == "view"), F.count_if(F.col("event_type") == "click")
    return table(spark, sf, "events").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("ts") < F.lit("2024-01-10").cast("timestamp")).alias("expired"), hits.alias("hits"), misses.alias("misses"), F.round(hits / F.greatest(hits + misses, F.lit(1)), 6).alias("hit_rate"))


@query("b7_vector_upsert", "select vec_id, label from embeddings where vec_id % 5 <> 0 union all select vec_id, label + 100 from embeddings where vec_id % 5 = 0 union all select vec_id + 1000000, label from embeddings where vec_id % 50 = 0")
def b7(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    batch = e.where("vec_id % 5 = 0").select("vec_id", (F.col("label") + 100).alias("label")).unionByName(e.where("vec_id % 50 = 0").select((F.col("vec_id") + 1000000).alias("vec_id"), "label"))
    return inc.upsert(e, batch, "vec_id")


@query("p15_delete_by_file", f"with {UNITS_SQL} select unit_id from units where not starts_with(file_path, 'src3/')")
def p15(spark, sf):
    u = units(spark, sf)
    gone = u.where(F.startswith("file_path", F.lit("src3/"))).select("file_path").distinct()
    return u.join(gone, "file_path", "left_anti").select("unit_id")


@query("p16_compaction", "select vec_id, label, n from (select vec_id, label, count(*) over (partition by label)::bigint as n from embeddings where vec_id % 9 <> 0)")
def p16(spark, sf):
    live = table(spark, sf, "embeddings").where("vec_id % 9 <> 0")
    counts = live.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return live.join(counts, "label").select("vec_id", "label", "n")


@query("p17_upsert_state", "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type from events group by user_id")
def p17(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))


@query("p18_upsert_repository", "select user_id, min(ts) as created_at, max(ts) as updated_at, arg_max(event_type, event_id) as state from events group by user_id")
def p18(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.max_by("event_type", "event_id").alias("state"))


@query("p19_deleted_chunks", "select doc_id, unnest([source || '-' || i for i in range(0, 1 + doc_id % 3)]) as chunk_id from documents where source in ('src1', 'src2')")
def p19(spark, sf):
    d = table(spark, sf, "documents")
    stored = d.withColumn("chunk_ids", F.array_join(F.expr("transform(sequence(0, cast(doc_id % 3 as int)), i -> concat('\"', source, '-', i, '\"'))"), ","))
    stored = stored.withColumn("chunk_ids", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("["), "chunk_ids", F.lit("]"))).otherwise(F.replace("chunk_ids", F.lit('"'), F.lit(""))))
    gone = stored.where(F.col("source").isin("src1", "src2"))
    ids = F.coalesce(F.from_json(F.when(F.startswith("chunk_ids", F.lit("[")), F.col("chunk_ids")), "array<string>"), F.split("chunk_ids", ","))
    return gone.select("doc_id", F.explode(ids).alias("chunk_id"))


@query("p21_mtime_then_hash", "select doc_id, case when doc_id % 4 <> 0 then false else md5(text) <> case when doc_id % 8 = 0 then md5(text) else md5(text || ' ') end end as changed from documents")
def p21(spark, sf):
    text, n = F.col("text"), F.col("doc_id")
    known = F.when(n % 8 == 0, F.md5(text.cast("binary"))).otherwise(F.md5(F.concat(text, F.lit(" ")).cast("binary")))
    return table(spark, sf, "documents").select("doc_id", F.when(n % 4 != 0, False).otherwise(F.md5(text.cast("binary")) != known).alias("changed"))


@query("p22_stale_batches", "select event_id from events where event_type = 'error' and ts < timestamp '2024-01-30' - interval 24 hours")
def p22(spark, sf):
    return table(spark, sf, "events").where((F.col("event_type") == "error") & (F.col("ts") < F.lit("2024-01-30").cast("timestamp") - F.expr("interval 24 hours"))).select("event_id")


@query("p23_chunks_of_files", f"with {UNITS_SQL} select file_path, count(*)::bigint as chunks, min(unit_id) as first_id, max(unit_id) as last_id from units group by file_path")
def p23(spark, sf):
    return units(spark, sf).groupBy("file_path").agg(F.count(F.lit(1)).alias("chunks"), F.min("unit_id").alias("first_id"), F.max("unit_id").alias("last_id"))


@query("i8_index_statistics", "select 'lang' as dimension, lang as value, count(*)::bigint as n from documents group by 2 union all select 'source', source, count(*)::bigint from documents group by 2 union all select 'total', '', count(*)::bigint from documents")
def i8(spark, sf):
    from ..operators.rules import counts_by

    return counts_by(table(spark, sf, "documents"), "lang", "source")


@query("i9_file_index_statistics", f"with {PAGES_SQL} select regexp_extract(path, '/([a-z]{{2}})/', 1) as language, count(*)::bigint as n_files, coalesce(sum(size), 0)::bigint as bytes, count(*) filter (file_id % 10 = 0)::bigint as pending from files group by 1")
def i9(spark, sf):
    return pages(spark, sf).groupBy(F.regexp_extract("path", "/([a-z]{2})/", 1).alias("language")).agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count_if(F.col("file_id") % 10 == 0).alias("pending"))


@query("i10_dedup_statistics", f"with {UNITS_SQL}, k as (select {_KEY_SQL} as key, count(*) as n from units group by 1) select count(*)::bigint as unique_contents, sum(n)::bigint as refs, round(1 - count(*)::double / greatest(sum(n), 1)::double, 6) as ratio from k")
def i10(spark, sf):
    n, refs = F.count(F.lit(1)), F.sum("n_units")
    return inc.dedup_content(units(spark, sf)).agg(n.alias("unique_contents"), refs.alias("refs"), F.round(1 - n / F.greatest(refs, F.lit(1)), 6).alias("ratio"))


@query("i17_distinct_files", f"with {UNITS_SQL} select distinct file_path from units")
def i17(spark, sf):
    return units(spark, sf).select("file_path").distinct()


@query("g12_live_over_stored", "select event_id, ts, 'live' as origin from events where event_id % 10 = 0 union all select event_id, ts, 'stored' from events where event_id % 10 <> 0 and event_id % 2 = 0")
def g12(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts")
    live, stored = e.where("event_id % 10 = 0"), e.where("event_id % 2 = 0")
    return inc.upsert(stored.withColumn("origin", F.lit("stored")), live.withColumn("origin", F.lit("live")), "event_id")


@query("j14_variant_search", f"""
with {_nearest_sql(20, where='score >= 0.4')},
s as (select doc_id, list_distinct([w for w in string_split(regexp_replace(lower(text), '[0-9]+', 'num', 'g'), ' ') if w <> '']) as ws from documents),
j as (select query_id as pattern_id, vec_id as doc_id, score, len(list_intersect(a.ws, b.ws)) / greatest(1, len(list_distinct(a.ws || b.ws)))::double as words from near join s a on a.doc_id = query_id join s b on b.doc_id = vec_id)
select pattern_id, doc_id, round(0.6::double * score + 0.4::double * words, 6) as score from j where round(0.6::double * score + 0.4::double * words, 6) >= 0.3""")
def j14(spark, sf):
    # Vectors choose the candidates; the texts' words, numbers made alike, are compared for those pairs alone.
    near = stored(_nearest(spark, sf, 20, least=0.4).select(F.col("query_id").alias("pattern_id"), F.col("vec_id").alias("doc_id"), "score"))
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("text"), "[0-9]+", "num"), " "), lambda w: w != ""))
    named = near.select(F.explode(F.array("pattern_id", "doc_id")).alias("doc_id")).distinct()
    s = table(spark, sf, "documents").select("doc_id", "text").join(stored(named), "doc_id", "left_semi").select("doc_id", words.alias("ws"))
    pairs = near.join(s, "doc_id").join(s.select(F.col("doc_id").alias("pattern_id"), F.col("ws").alias("qs")), "pattern_id")
    score = F.round(F.lit(0.6) * F.col("score") + F.lit(0.4) * C.jaccard("qs", "ws"), 6)
    return pairs.select("pattern_id", "doc_id", score.alias("score")).where("score >= 0.3")


@query("j10_blended_rerank", f"""with {_PART_SQL}, s as (select *, round(case when security > 0.5 then (0.4::double * vector + 0.25::double * keyword + 0.2::double * security + 0.15::double * context) * 1.5::double else 0.4::double * vector + 0.25::double * keyword + 0.2::double * security + 0.15::double * context end, 6) as score from f),
l as (select * from s order by score desc, p_partkey limit 40), b as (select p_partkey, round(case when p_partkey % 6 = 0 then score else 0.3::double * score + 0.7::double * context end, 6) as score from l)
select p_partkey, score, (row_number() over (order by score desc, p_partkey))::int as rank from b order by rank limit 20""")
def j10(spark, sf):
    # The second model's scores come as a column; a row that it left out has none.
    local = search.rerank(_factors(spark, sf), (0.4, 0.25, 0.2, 0.15), 1.5, 0.5, "p_partkey", 40)
    return search.blended_rerank(local, F.when(F.col("p_partkey") % 6 != 0, F.col("context")), "p_partkey", 20)
