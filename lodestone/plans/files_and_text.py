"""Files, path predicates, scalar text functions: queries over pages and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import files, text
from .query import PAGES_SQL, UNITS_SQL, pages, query, table, units


@query("a2_ignore_with_reason", f"""
with {PAGES_SQL}
select file_id, path,
  case when regexp_matches(path, '/(de|es)/') then 'gitignore'
    when contains(path, 'page=1') and not regexp_matches(path, '(?s)^.*page=1&.*ref=.*$') then 'auditignore'
    when size / 1024.0 > 12 then 'size'
    when not (ends_with(path, 'x') or ends_with(path, '1') or ends_with(path, '2') or ends_with(path, '3')) then 'extension' else '' end as reason,
  not (regexp_matches(path, '/(de|es)/') or (contains(path, 'page=1') and not regexp_matches(path, '(?s)^.*page=1&.*ref=.*$'))
    or size / 1024.0 > 12 or not (ends_with(path, 'x') or ends_with(path, '1') or ends_with(path, '2') or ends_with(path, '3'))) as accepted
from files""")
def a2(spark: SparkSession, sf: str) -> DataFrame:
    return _filtered(spark, sf).select("file_id", "path", "reason", "accepted")


def _filtered(spark: SparkSession, sf: str) -> DataFrame:
    return files.ignore_cascade(
        pages(spark, sf),
        [("gitignore", F.col("path").rlike("/(de|es)/")), ("auditignore", F.contains("path", F.lit("page=1")) & ~C.matches_glob("path", "*page=1&*ref=*"))],
        max_kb=12,
        suffixes=("x", "1", "2", "3"),
    )


@query("a3_filter_stats", f"""
with {PAGES_SQL}, r as (
  select case when regexp_matches(path, '/(de|es)/') then 'gitignore'
    when contains(path, 'page=1') and not regexp_matches(path, '(?s)^.*page=1&.*ref=.*$') then 'auditignore'
    when size / 1024.0 > 12 then 'size'
    when not (ends_with(path, 'x') or ends_with(path, '1') or ends_with(path, '2') or ends_with(path, '3')) then 'extension' else '' end as reason from files)
select count(*)::bigint as total, count(*) filter (reason = '')::bigint as accepted, count(*) filter (reason = 'gitignore')::bigint as by_gitignore,
  count(*) filter (reason = 'auditignore')::bigint as by_auditignore, count(*) filter (reason = 'size')::bigint as by_size, count(*) filter (reason = 'extension')::bigint as by_extension from r""")
def a3(spark, sf):
    return files.filter_stats(_filtered(spark, sf), ("gitignore", "auditignore", "size", "extension"))


@query("a4_gitignore_match", f"""
with {PAGES_SQL}
select file_id, (contains('/' || path || '/', '/fr/') or regexp_matches(path, '(?s)^.*page=3.*$')
  or len([x for x in string_split(path, '/') if regexp_matches(x, '(?s)^9.*$')]) > 0) as ignored from files""")
def a4(spark, sf):
    return pages(spark, sf).select("file_id", files.gitignored("path", ["fr/", "**page=3**", "9*"]).alias("ignored"))


@query("a5_skip_generated", """
select doc_id, length(text) > 10000 as too_long, contains(lower(array_to_string(string_split(text, chr(10))[1:10], chr(10))), 'licensed under') as marked,
  (length(text) > 10000 or contains(lower(array_to_string(string_split(text, chr(10))[1:10], chr(10))), 'licensed under')) as skipped from documents""")
def a5(spark, sf):
    return files.skip_generated(table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")), max_chars=10000, markers=("licensed under",)).drop("content")


@query("a6_read_slice", """
select doc_id, array_to_string(string_split(text, chr(10))[greatest(3 - 1, 1):5 + 1], chr(10)) as slice, least(len(string_split(text, chr(10))), 6)::bigint as end_line from documents""")
def a6(spark, sf):
    return files.read_slice(table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")), 3, 5, context=1)


@query("a7_list_files", f"""
with {PAGES_SQL} select path, size from files where regexp_matches(path, '(?s)^.*/fr/.*$') order by path, file_id limit 50""")
def a7(spark, sf):
    return files.list_files(pages(spark, sf), "*/fr/*", 50).select("path", "size")


@query("f5_path_filter", f"""
with {PAGES_SQL}
select file_id, (regexp_matches(path, '(?s)^.*/de/.*$') or regexp_matches(path, '(?s)^.*/.*/de/.*$')) as by_glob, contains(lower(path), 'ref=x') as by_text from files""")
def f5(spark, sf):
    return pages(spark, sf).select("file_id", C.path_filter("path", "*/de/*").alias("by_glob"), C.path_filter("path", "REF=x").alias("by_text"))


@query("f6_path_exclusion", f"with {PAGES_SQL} select file_id, path from files where not contains(path, 'page=2') and not contains(path, '/es/')")
def f6(spark, sf):
    p = pages(spark, sf)
    return p.where(~(C.path_excluded("path", "page=2") | C.path_excluded("path", "/es/"))).select("file_id", "path")


@query("p20_prefix_scan", "select page_id, url from pages where starts_with(url, 'http://th')")
def p20(spark, sf):
    return table(spark, sf, "pages").where(F.startswith("url", F.lit("http://th"))).select("page_id", "url")


@query("k1_grep_context", """
with l as (
  select doc_id, unnest(range(1, len(ls) + 1)) as n, ls from (select doc_id, string_split(text, chr(10)) as ls from documents)),
m as (select doc_id, n, ls[n] as line, coalesce(ls[n - 1], '') as before, coalesce(ls[n + 1], '') as after from l where regexp_matches(ls[n], '(?i)licen[cs]ed? under'))
select doc_id, n::bigint as line_no, (strpos(lower(line), 'licensed under') - 1)::bigint as start, line, before, after from m""")
def k1(spark, sf):
    found = text.grep(table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")), "(?i)licen[cs]ed? under", context=1)
    return found.select("doc_id", "line_no", (F.locate("licensed under", F.lower("line")) - 1).cast("long").alias("start"), "line", F.coalesce(F.element_at("before", 1), F.lit("")).alias("before"), F.coalesce(F.get("after", F.lit(0)), F.lit("")).alias("after"))


@query("k2_term_grep", f"""
with {UNITS_SQL} select unit_id, file_path, 0.4::double as score from units where regexp_matches(lower(code), 'trash|scum|idiot') order by file_path, unit_id limit 30""")
def k2(spark, sf):
    return text.term_grep(units(spark, sf), ["trash", "scum", "idiot"], limit=30).select("unit_id", "file_path", "score")


@query("k4_keywords", """
select doc_id, array_to_string(list_sort(list_distinct([lower(w) for w in regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]+') if not list_contains(['the', 'and', 'of', 'to', 'in'], lower(w))])), ' ') as keywords from documents""")
def k4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.keywords("text", ("the", "and", "of", "to", "in")), " ").alias("keywords"))


@query("k5_redaction", """
select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}', '[REDACTED:EMAIL]', 'g'), '[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}', '[REDACTED:CARD]', 'g'), '(api_key|password|secret|token)( ?[:=] ?)["'']?[A-Za-z0-9+/_-]{8,}', '\\1\\2[REDACTED:KEY]', 'g')) as redacted_md5 from documents""")
def k5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(text.redact("text").cast("binary")).alias("redacted_md5"))


@query("k6_mask", "select c_custkey, case when length(c_name) <= 4 then repeat('*', length(c_name)) else c_name[1:4] || repeat('*', length(c_name) - 4) end as masked from customer")
def k6(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.mask("c_name", 4).alias("masked"))


@query("k7_hash_ids", f"with {UNITS_SQL} select unit_id, sha256(file_path || ':' || symbol || ':1:' || len(string_split(code, chr(10))))[1:16] as id, md5(file_path || ':1:' || symbol)[1:8] as site_id, sha256(code) as content_hash from units")
def k7(spark, sf):
    u = units(spark, sf)
    return u.select(
        "unit_id",
        C.short_id("file_path", "symbol", F.lit(1), F.size(C.lines("code"))).alias("id"),
        F.substring(F.md5(F.concat_ws(":", "file_path", F.lit("1"), "symbol").cast("binary")), 1, 8).alias("site_id"),
        F.sha2(F.col("code").cast("binary"), 256).alias("content_hash"),
    )


@query("k8_signature", """
select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '"[^"]*"', '"STR"', 'g'), '[0-9]+', 'NUM', 'g'), '[A-Za-z_][A-Za-z0-9_]*', 'VAR', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')[1:500] as signature from documents""")
def k8(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.signature("text").alias("signature"))


@query("k9_comments", """
select page_id, length(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'))::bigint as n_chars, regexp_extract(html, 'function ([A-Za-z_]+)', 1) as first_function, len(string_split(html, chr(10)))::bigint as n_lines from pages""")
def k9(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.char_length(text.without_comments("html", "html")).cast("long").alias("n_chars"), F.regexp_extract("html", "function ([A-Za-z_]+)", 1).alias("first_function"), F.size(C.lines("html")).cast("long").alias("n_lines"))


@query("k10_formatting", """
select doc_id, case when n_chars < 1024 then n_chars || ' B' when n_chars < 1048576 then format('{:.1f} KB', round(n_chars / 1024.0::double, 1)) else format('{:.1f} MB', round(n_chars / 1048576.0::double, 1)) end as size_text, case when length(text) <= 20 then text else text[1:17] || '...' end as short, regexp_replace(source || '/' || lang || '?', '[<>:"/\\\\|?*]', '_', 'g') as file_name from documents""")
def k10(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", text.size_text("n_chars").alias("size_text"), text.truncate("text", 20).alias("short"), text.safe_name(F.concat("source", F.lit("/"), "lang", F.lit("?"))).alias("file_name"))


@query("k11_paths", """
select page_id, regexp_extract(url, '^https?://([^/]+)', 1) as host, regexp_matches(url, '^https?://[A-Za-z0-9.-]+(:[0-9]+)?(/.*)?$') as valid, case when starts_with(url, 'http://') then url[8:] else url end as relative from pages""")
def k11(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.col("url").rlike("^https?://[A-Za-z0-9.-]+(:[0-9]+)?(/.*)?$").alias("valid"), text.relative("url", "http://").alias("relative"))


@query("k12_head_tail", """
with l as (select doc_id, string_split(text, chr(10)) as ls from documents)
select doc_id, case when len(ls) <= 8 then array_to_string(ls, chr(10)) else array_to_string(ls[1:(len(ls) * 4) // 10], chr(10)) || chr(10) || '... ' || (len(ls) - (len(ls) * 4) // 10 - (len(ls) * 3) // 10) || ' lines omitted ...' || chr(10) || array_to_string(ls[len(ls) - (len(ls) * 3) // 10 + 1:len(ls)], chr(10)) end as trimmed from l""")
def k12(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.head_tail("text", 8).alias("trimmed"))


@query("d7_token_estimates", """
select doc_id, floor(length(text) * 3 / 10)::bigint as flat, floor(length(text) / 3)::bigint as third, floor(len(regexp_extract_all(text, '[一-鿿]')) / 1.5 + (length(text) - len(regexp_extract_all(text, '[一-鿿]'))) / 4.0)::bigint as cjk from documents""")
def d7(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.tokens_flat("text").alias("flat"), C.tokens_third("text").alias("third"), C.tokens_cjk("text").alias("cjk"))


@query("e1_embedding_text", f"with {UNITS_SQL} select unit_id, 'Language: ' || language || chr(10) || 'File: ' || file_path || chr(10) || 'Symbol: ' || symbol || chr(10) || 'Type: function' || chr(10) || 'Signature: ' || symbol || '()' || chr(10) || 'Code:' || chr(10) || code[1:2000] as embedding_text from units")
def e1(spark, sf):
    u = units(spark, sf).withColumns({"unit_type": F.lit("function"), "signature": F.concat("symbol", F.lit("()"))})
    return u.select("unit_id", text.embedding_text().alias("embedding_text"))


@query("e5_batch_size", """
select lang, case when avg(n_chars) <= 0 then 100 else greatest(5, least(200, floor(8191 * 0.8::double / (avg(n_chars) / 4))))::bigint end as batch_size from documents group by lang""")
def e5(spark, sf):
    mean = F.avg("n_chars")
    return table(spark, sf, "documents").groupBy("lang").agg(F.when(mean <= 0, F.lit(100)).otherwise(F.greatest(F.lit(5), F.least(F.lit(200), F.floor(F.lit(8191) * F.lit(0.8) / (mean / 4))))).cast("long").alias("batch_size"))


@query("d3_line_windows", """
with l as (select doc_id, string_split(text, chr(10)) as ls from documents),
w as (select doc_id, s, ls[s + 1:s + 50] as part, len(ls) as n from (select doc_id, ls, unnest(range(0, len(ls), 45)) as s from l))
select doc_id, (s + 1)::bigint as start_line, least(s + 50, n)::bigint as end_line, md5(array_to_string(part, chr(10))) as content_md5 from w where trim(array_to_string(part, ''), ' ' || chr(9) || chr(13)) <> ''""")
def d3(spark, sf):
    found = text.line_windows(table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")), 50, 5)
    return found.select("doc_id", "start_line", "end_line", F.md5(F.col("chunk").cast("binary")).alias("content_md5"))


@query("d2_reassemble", f"with {UNITS_SQL} select unit_id, md5(code) as code_md5, 1::bigint as start_line, len(string_split(code, chr(10)))::bigint as end_line from units")
def d2(spark, sf):
    chunks = text.line_windows(units(spark, sf).select("unit_id", F.col("code").alias("content")), 20, 0, keep_blank=True)
    return text.reassemble(chunks, "unit_id").select("unit_id", F.md5(F.col("content").cast("binary")).alias("code_md5"), "start_line", "end_line")


@query("d1_unit_chunks", None)
def d1(spark, sf):
    chunks = text.unit_chunks(units(spark, sf), max_tokens=300)
    return chunks.select("unit_id", "chunk_id", "chunk_index", "total_chunks", "start_line", "end_line", F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


@query("p29_offset_to_line", "select doc_id, (len(string_split(text[1:100], chr(10))))::bigint as line, (length(text[1:100]) - length(array_to_string(string_split(text[1:100], chr(10))[1:len(string_split(text[1:100], chr(10))) - 1], chr(10))) - case when contains(text[1:100], chr(10)) then 1 else 0 end)::bigint as col from documents")
def p29(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *text.line_and_column("text", 100))


@query("p39_keyword_lines", """
select doc_id, n::bigint as line_no, k as keyword from (
  select doc_id, unnest(range(1, len(ls) + 1)) as n, ls from (select doc_id, string_split(text, chr(10)) as ls from documents)), (values ('password'), ('token'), ('license')) v(k)
where contains(lower(ls[n]), k)""")
def p39(spark, sf):
    return text.keyword_lines(table(spark, sf, "documents").select("doc_id", F.col("text").alias("content")), ("password", "token", "license"))


@query("j18_token_jaccard", """
with t as (select doc_id, list_distinct([x for x in string_split(lower(text), ' ') if x <> '']) as ws, lag(list_distinct([x for x in string_split(lower(text), ' ') if x <> ''])) over (order by doc_id) as ps from documents)
select doc_id, round(case when len(list_distinct(ws || ps)) = 0 then 0.0 else len(list_intersect(ws, ps))::double / len(list_distinct(ws || ps)) end, 6) as similarity from t where ps is not null""")
def j18(spark, sf):
    words = F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda x: x != ""))
    d = table(spark, sf, "documents").select("doc_id", words.alias("ws"))
    # Each document against the next one of its id: an equality join, no global window.
    pairs = d.join(text.predecessor(d.select("doc_id", F.col("ws").alias("ps")), "doc_id"), "doc_id")
    return pairs.select("doc_id", F.round(C.jaccard("ws", "ps"), 6).alias("similarity"))
