"""Line dedup by winnowing over line hashes.

A text's lines with a word in them are hashed. Of every WINDOW consecutive lines the smallest hash is a fingerprint, so any
run of at least WINDOW lines that two places share has a fingerprint in common (winnowing's guarantee). Only the selected
positions, about half of the lines, are kept; they join on the fingerprints that occur more than once. Around those a match is
extended both ways over the windows whose smallest line the position is, and held against the first place that has the same
lines, by 128 bits of each. Lines in a run of WINDOW or more that an earlier place has are deleted.

Places are in the order of doc_id, hash of the text, line; null ids come first. So the result is exactly: a line goes if
it lies in WINDOW consecutive lines (blank ones aside) that occur at an earlier place.

Grouping needs a minimum only, and what joins a frequent line or window is one row, broadcast if it is one of the few that hold
a thousandth of all rows each; so no group is ever gathered.

Defined cases: null and empty texts stay as they are; blank lines stay and count as no line. Lines are compared without
white space at their ends. Rows with the same id and text are one document: they lose the same lines, and none on account
of each other. An emptied text is ''. Other columns stay, n_chars follows the text if it is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, joined_by_key, stored, table

WINDOW = 3


def text_key(text: Column | str = "text") -> Column:
    return F.xxhash64(text)


def positions(docs: DataFrame, window: int = WINDOW, long_words: int | None = None) -> DataFrame:
    """doc_id, key, fingerprint, at (its line), w: the selected positions of each text, and the windows whose smallest line each is
    (content: 128 bits of the lines, n: their number, lines: their numbers in the text).
    With long_words, runs of fewer lines that have so many words are windows as well."""
    strip = r"btrim(l, ' \t\r\f\u000b')"
    words = rf", size(split({strip}, '[ \t\r\f\u000b]+')) as words" if long_words else ""
    lines = F.expr(rf"filter(transform(split(text, '\n'), (l, i) -> struct(xxhash64({strip}) as h, i as i, char_length({strip}) > 0 as full, xxhash64(7, {strip}) as g{words})), x -> x.full)")
    rows = docs.where("text is not null").select("doc_id", text_key().alias("key"), lines.alias("l")).where(F.size("l") >= (1 if long_words else window))
    # For each line, the windows that begin there: the place of the smallest of their lines, and what they hold.
    sizes = range(1 if long_words else window, window + 1)
    for n in sizes:
        some = f"slice(l, s + 1, {n})"
        least = f"array_min(transform({some}, (x, k) -> struct(x.h as h, s + k as k))).k"
        a, b = (f"aggregate({some}, {seed}L, (a, x) -> xxhash64(a, x.{h}))" for seed, h in enumerate("hg"))
        enough = f" and aggregate({some}, 0, (a, x) -> a + x.words) >= {long_words}" if n < window else ""
        rows = rows.withColumn(f"w{n}", F.expr(f"transform(l, (x, s) -> case when s + {n} <= size(l){enough} then struct({least} as k, s as s, {a} as a, {b} as b) end)"))
    # A line is selected if it is the smallest of one of the windows around it, of which there are as many as they are long.
    around = lambda n: f"filter(slice(w{n}, greatest(k - {n - 2}, 1), least(k + 1, {n})), w -> w.k = k)"
    own = ", ".join(f"transform({around(n)}, w -> struct(w.a as a, w.b as b, {n} as n, transform(slice(l, w.s + 1, {n}), y -> y.i) as lines))" for n in sizes)
    picked = F.expr(f"filter(transform(l, (x, k) -> struct(x.h as fingerprint, x.i as at, concat({own}) as w)), p -> size(p.w) > 0)")
    return rows.select("doc_id", "key", F.explode(picked).alias("p")).select("doc_id", "key", "p.fingerprint", "p.at", "p.w")


def repeated_lines(docs: DataFrame, window: int = WINDOW, long_words: int | None = None) -> DataFrame:
    """doc_id, key, gone: for each text that loses lines, their numbers."""
    found = stored(positions(docs, window, long_words))
    place = F.struct("doc_id", "key", "at")
    again = found.groupBy("fingerprint").agg(F.min(place).alias("a"), F.max(place).alias("b"), F.count(F.lit(1)).alias("n")).where("a != b").select("fingerprint", "n")
    near = joined_by_key(found, again, "fingerprint").select("doc_id", "key", F.explode("w").alias("w")).select("doc_id", "key", "w.*")
    near = stored(near)
    # Positions with a line in common are told apart by the lines around it: those of equal windows match, and the first place stays.
    start = F.struct("doc_id", "key", F.element_at("lines", 1).alias("line"))
    firsts = near.groupBy("a", "b").agg(F.min(start).alias("first"), F.max(start).alias("last"), F.count(F.lit(1)).alias("n")).where("first != last").select("a", "b", "first", "n")
    later = joined_by_key(near.withColumnRenamed("n", "size"), firsts, "a", "b").where(start > F.col("first"))
    return later.select("doc_id", "key", F.explode("lines").alias("line")).groupBy("doc_id", "key").agg(F.collect_set("line").alias("gone"))


def _without(lines: Column, gone: Column) -> Column:
    """The lines but for those of the given numbers, joined."""
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)  # looks numbers up: linear in a long text
    return F.array_join(F.transform(stay, lambda i: F.element_at(lines, i + 1)), "\n")


def line_dedup(docs: DataFrame, window: int = WINDOW, long_words: int | None = None) -> DataFrame:
    """docs with the repeated lines deleted, and the number of those as the last column."""
    gone = repeated_lines(docs, window, long_words)
    key, other_id, other_key, lost, parts, n = fresh(docs, "text_key", "gone_id", "gone_key", "gone", "parts", "n_deleted_lines")
    gone = gone.toDF(other_id, other_key, lost)
    joined = docs.withColumn(key, text_key()).join(gone, F.col("doc_id").eqNullSafe(F.col(other_id)) & (F.col(key) == F.col(other_key)), "left")
    joined = joined.withColumn(parts, F.when(F.col(lost).isNotNull(), F.split("text", "\n")))
    text = F.when(F.col(lost).isNull(), F.col("text")).otherwise(_without(F.col(parts), F.col(lost)))
    out = {"text": text} | ({"n_chars": F.when(F.col(lost).isNull(), F.col("n_chars")).otherwise(F.char_length(text).cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {})
    return joined.select(*(out[c].alias(c) if c in out else F.col(c) for c in docs.columns), F.coalesce(F.size(lost), F.lit(0)).cast("long").alias(n))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs)


def window_sql(source: str, window: int = WINDOW) -> str:
    """DuckDB for the lines that go, as doc_id, text, i, from a table of doc_id, text."""
    return f"""
  select distinct doc_id, text, i from (
    select o.doc_id, o.text, unnest(o.lines) as i from (
      select *, row_number() over (partition by content order by doc_id nulls first, h, first) as place,
        min((doc_id, h, first)) over (partition by content) as earliest
      from (
        select doc_id, text, h, first, content, lines from (
          select doc_id, text, h, i as first,
            list(l) over w as content, list(i) over w as lines
          from (
            select distinct doc_id, text, hash(text) as h, i - 1 as i, trim(ls[i], ' ' || chr(9) || chr(13) || chr(12) || chr(11)) as l
            from (select doc_id, text, ls, unnest(range(1, len(ls) + 1)) as i from (select distinct doc_id, text, string_split(text, chr(10)) as ls from {source} where text is not null)))
          where l <> ''
          window w as (partition by doc_id, text order by i rows between current row and {window - 1} following))
        where len(lines) = {window})) o
    where o.place > 1)"""


ORACLE_SQL = f"""
with gone as ({window_sql('documents')}),
per_text as (select doc_id, text, list(i) as gone, count(*) as n from gone group by doc_id, text)
select d.doc_id,
  case when p.n is null then d.text else array_to_string([x[1] for x in list_zip(string_split(d.text, chr(10)), range(0, len(string_split(d.text, chr(10))))) if not list_contains(p.gone, x[2])], chr(10)) end as text,
  coalesce(p.n, 0)::bigint as n_deleted_lines
from documents d left join per_text p on d.doc_id is not distinct from p.doc_id and d.text = p.text
"""
