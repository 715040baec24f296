"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Every document has an exponential key, -ln(u) / weight: u comes from a hash of its id, the weight is its quality
weight. The documents of a source in the order of their keys are a weighted sample without replacement, whatever the
length of the prefix taken. A source whose target is several times its size is first taken whole that many times
(complete epochs); the rest of the target is the prefix of its documents whose summed sizes come nearest to it.

The prefix sums never gather a source in a task. Its documents are dealt into key ranges of about RANGE_ROWS rows; the
sums of the ranges give each range its offset, and only within a range are rows sorted.

Defined cases: null or empty text has size 0 and isn't taken. A null source is a source of its own, last in
order. Ties in the key go by doc_id, size. Repeated rows are documents of their own; they tie, and which of them falls on the
boundary does not show in the result. Null doc_ids share one u. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, stored, table, unit_hash

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: Rows of one key range, the unit that a task sorts.
RANGE_ROWS = 4096
#: Quality weights: documents labelled good, unlabelled, labelled bad.
QUALITY = (1.5, 1.0, 0.5)


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_EPOCHS) -> DataFrame:
    """sizes(source, source_size, n_docs), a row for each source, with its target.

    Targets share the total of all sizes by weight and stop at cap x size; what is above goes to the others by weight.
    With the sources in order of cap / weight, the stopped ones are a prefix: a source is stopped if its cap is below
    its share of what its predecessors' caps leave. The windows run over a row for each source, not over documents.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    n = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*map(F.lit, weights)), (n + 1).cast("int"))
    rows = sizes.select("*", w.cast("long").alias("w"), (F.lit(cap) * F.col("source_size")).alias("cap"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(
        "*",
        F.sum("source_size").over(whole).alias("total"),
        (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("left_w"),
    )
    rows = rows.withColumn("stopped", F.col("cap") * F.col("left_w") <= F.col("left") * F.col("w"))
    # What the stopped leave is the share base of all others.
    rest = F.sum(F.when(~F.col("stopped"), F.col("w"))).over(whole)
    base = F.col("total") - F.coalesce(F.sum(F.when(F.col("stopped"), F.col("cap"))).over(whole), F.lit(0))
    target = F.when(F.col("stopped"), F.col("cap").cast("double")).otherwise(base.cast("double") * F.col("w") / rest)
    return rows.select("source", "source_size", "n_docs", target.alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of the text), source, size: all that the mix needs, so that texts stay out of every shuffle."""
    return docs.select("doc_id", F.xxhash64("text").alias("key"), "source", word_count("text").alias("size"))


def mix(rows: DataFrame, seed: int = SEED, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_EPOCHS) -> DataFrame:
    """doc_id, key, source, size, source_size, target, times, taken for each row of rows(doc_id, key, source, size, quality_weight)."""
    order = -F.log(unit_hash("doc_id", seed=seed)) / F.greatest(F.col("quality_weight"), F.lit(1e-6))
    rows = rows.select("doc_id", "key", "source", "size", order.alias("order"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    plan = targets(sizes, weights, cap).select(
        "*",
        F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(0).cast("long").alias("epochs"),
    ).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    # The source is a join key that one hot value dominates; a row for each source joins, so Spark may broadcast or split it.
    dealt = rows.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / RANGE_ROWS))
    dealt = dealt.withColumn("part", F.floor(ranges * (F.lit(1.0) - F.exp(-F.col("order")))).cast("long"))
    parts = dealt.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    offset = F.sum("part_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("source").alias("of"), F.col("part").alias("of_part"), F.coalesce(offset, F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "part").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    summed = summed.join(parts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
    before = F.col("offset") + F.col("inner")
    once_more = (F.col("epochs") < cap) & (2 * before + F.col("size") <= 2 * F.col("rest"))
    times = F.when(F.col("size") > 0, F.col("epochs") + F.when(once_more, 1).otherwise(0)).otherwise(0)
    return summed.select("doc_id", "key", "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"))


def quality(labels: DataFrame, good: float = QUALITY[0], bad: float = QUALITY[2]) -> DataFrame:
    """A row for each labelled id with its quality weight; contradicting labels give the mean."""
    return labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("labelled")).agg(F.avg(F.when(F.col("quality") > 0, good).otherwise(bad)).alias("quality_weight"))


def with_quality(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with quality_weight, 1 where there is no label."""
    q = quality(labels)
    return rows.join(q, F.col("doc_id") == F.col("labelled"), "left").drop("labelled").withColumn("quality_weight", F.coalesce("quality_weight", F.lit(QUALITY[1])))


def repeated(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken."""
    taken = stored(mix(with_quality(sized(docs), labels), **how).select("doc_id", "key", "source", "times"))
    key, n, at_id, at_key, at_source, at_n, times, copy = fresh(docs, "text_key", "copy_no", "at_id", "at_key", "at_source", "at_n", "times", "copy")
    docs_keyed = docs.withColumn(key, F.xxhash64("text"))
    if taken.groupBy("doc_id", "key", "source").count().where("count > 1").isEmpty():
        left, right = docs_keyed.withColumn(n, F.lit(1)), taken.withColumn("n", F.lit(1))
    else:  # rows that agree in all three are told apart by a number
        left = docs_keyed.withColumn(n, F.row_number().over(Window.partitionBy("doc_id", key, "source").orderBy("doc_id")))
        right = taken.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "key", "source").orderBy("doc_id")))
    right = right.where("times > 0").select(F.col("doc_id").alias(at_id), F.col("key").alias(at_key), F.col("source").alias(at_source), F.col("n").alias(at_n), F.col("times").alias(times))
    on = F.col("doc_id").eqNullSafe(F.col(at_id)) & (F.col(key) == F.col(at_key)) & F.col("source").eqNullSafe(F.col(at_source)) & (F.col(n) == F.col(at_n))
    return left.join(right, on).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(docs.columns)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sized(table(spark, sf_dir, "documents"))
    return mix(with_quality(rows, table(spark, sf_dir, "labels"))).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
q as (
  select doc_id, avg(case when quality > 0 then 1.5 else 0.5 end) as w from labels
  where doc_id is not null and quality is not null group by doc_id),
k as (
  select d.*, -ln((('0x' || substr(md5(coalesce(d.doc_id::varchar, 'null') || ':17'), 1, 13))::bigint::double + 0.5) / 4503599627370496.0) / coalesce(q.w, 1.0) as key
  from d left join q on d.doc_id = q.doc_id),
s as (
  select source, sum(size)::bigint as source_size,
    [5, 2, 1][1 + (row_number() over (order by source is null, encode(source)) - 1) % 3] as w
  from d group by source),
s1 as (
  select *, sum(source_size) over () as total,
    sum(source_size) over () - coalesce(sum(3 * source_size) over (order by 3 * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(w) over () - coalesce(sum(w) over (order by 3 * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest_w
  from s),
s2 as (select *, 3 * source_size * rest_w <= rest * w as stopped from s1),
s3 as (
  select source, source_size, case when stopped then (3 * source_size)::double
    else (total - coalesce(sum(case when stopped then 3 * source_size end) over (), 0))::double * w / sum(case when not stopped then w end) over () end as target
  from s2),
t as (
  select *, case when source_size > 0 then least(floor(target / source_size), 3) else 0 end::bigint as epochs from s3),
u as (
  select k.doc_id, k.size, t.source_size, t.target, t.epochs, t.target - t.epochs * t.source_size as rest,
    coalesce(sum(k.size) over (partition by k.source order by k.key, k.doc_id, k.size rows between unbounded preceding and 1 preceding), 0) as before
  from k join t on k.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (size * (epochs + case when size > 0 and epochs < 3 and 2 * before + size <= 2 * rest then 1 else 0 end))::bigint as taken
from u
"""
