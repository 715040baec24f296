"""Rules looked up by an index, so that the work doesn't grow with rules times names.

A pattern has a key that a name must hold to match: an exact name or a prefix of it, from its start; a suffix, from its end; the first
letters of a part, anywhere; the letters that a regular expression begins with. Names meet patterns by equality of these keys, with a
row for each length that patterns have, and each candidate is verified. Only expressions that begin with no letter have no key; those
are tried on all names, as a side whose size is counted.

Equal patterns of several rules are looked up once; their rules follow in parts of RULES. Sides that grow with names or rules are never broadcast:
Spark takes the size of exploded rows for that of the rows before, and would send them all through the driver.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Letters of a key of a part; longer ones select no better among short names.
ANCHOR = 4
#: Expressions without a key are broadcast up to so many; beyond, Spark chooses.
BROADCAST_PATTERNS = 10_000
#: Rules of one pattern that travel in a row; hits of a task, which sorts them by name.
RULES, TASK_HITS = 64, 2_000_000


def _beginning(pattern: str | None) -> str | None:
    """What every match of an expression begins with, as far as it is plain; None where the expression is none."""
    try:
        re.compile(pattern)
    except (re.error, TypeError, OverflowError, RecursionError):
        return None
    if "|" in pattern:  # another branch may begin in another way
        return ""
    plain = re.match(r"[A-Za-z0-9_#@:/ -]*", pattern).group()
    return plain[:-1] if pattern[len(plain) :][:1] in ("*", "?", "{", "+") else plain


def _runs(pattern: str) -> list[str]:
    """Plain texts that every match of a sound expression holds, as far as they are sure: none with branches, groups or escaped letters."""
    if re.search(r"[|(]|\\[A-Za-z0-9]|\[[^\]]*\[", pattern):
        return []
    left = re.sub(r"\[\^?\]?[^\]]*\]", "\0", re.sub(r"\\.", "\0", pattern))
    left = re.sub(r".(?:[*?]|\{[^}]*\})[+?]?", "\0", left)
    return re.findall(r"[A-Za-z0-9_#@:/ -]+", re.sub(r"\+[+?]?", "\0", left))


def _grams(pattern: str | None) -> list[str]:
    """The parts of ANCHOR letters of these texts, whole texts where they are shorter."""
    return sorted({r[i : i + ANCHOR] for r in _runs(pattern) for i in range(max(1, len(r) - ANCHOR + 1))})


def _rarest(wanted: DataFrame, distinct: DataFrame) -> DataFrame:
    """wanted with where, the side on which a name has its key. An expression's key becomes the part that the fewest names hold among those that
    its matches must hold: its beginning may be that of all names."""
    where = F.when(F.col("kind") == "exact", "whole").when(F.col("kind").isin("prefix", "regex"), "start").when(F.col("kind") == "suffix", "end").otherwise("part")
    grams = F.pandas_udf(lambda b: b.map(_grams), "array<string>")
    held = wanted.where("kind = 'regex'").select("text").distinct().select("text", F.explode(grams("text")).alias("gram"))
    size = F.char_length("_name")
    sizes = F.sequence(F.lit(1), F.least(F.lit(ANCHOR), size))
    parts = F.flatten(F.transform(sizes, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(F.col("_name"), i, n))))
    named = distinct.select("_name").distinct().where(size > 0).select(F.explode(F.array_distinct(parts)).alias("gram"))
    often = named.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))  # counted where names are: far fewer parts than names
    best = held.join(often.hint("merge"), "gram", "left").groupBy("text").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    chosen = wanted.where("kind = 'regex'").join(best.hint("merge"), "text", "left")
    chosen = chosen.withColumn("where", F.when(F.col("gram").isNotNull(), "part").otherwise("start")).withColumn("key", F.coalesce("gram", "key"))
    return wanted.where("kind <> 'regex'").withColumn("where", where).unionByName(chosen.drop("gram"))


def _literal(pattern: str) -> Column:
    def begin(batch: pd.Series) -> pd.Series:
        return batch.map(_beginning)

    return F.pandas_udf(begin, "string")(pattern)


def rule_index(patterns: DataFrame, name: str = "pattern") -> DataFrame:
    """patterns(rule_id, pattern, ...) with kind, text and the key that a name must hold. `prefix:`, `suffix:`, `contains:` and `regex:` before a text
    give its kind; others are exact. Expressions that don't compile match nothing and are left out, as are nulls."""
    kind = F.regexp_extract(name, r"^(prefix|suffix|contains|regex):", 1)
    rows = patterns.where(F.col(name).isNotNull()).withColumn("kind", F.when(kind == "", "exact").otherwise(kind))
    rows = rows.withColumn("text", F.when(kind == "", F.col(name)).otherwise(F.expr(f"substr({name}, char_length(kind) + 2)")))
    plain, regex = rows.where("kind <> 'regex'").withColumn("literal", F.col("text")), rows.where("kind = 'regex'").withColumn("literal", _literal("text"))
    rows = plain.unionByName(regex).where("literal is not null")
    short = F.expr(f"left(literal, {ANCHOR})")
    return rows.withColumn("key", F.when(F.col("kind") == "contains", short).otherwise(F.col("literal"))).drop("literal")


def _holds(name: Column, kind: Column, text: Column) -> Column:
    """Expressions are anchored at the start."""
    return F.when(kind == "exact", name == text).when(kind == "prefix", F.startswith(name, text)).when(kind == "suffix", F.endswith(name, text)).when(kind == "contains", F.contains(name, text)).otherwise(F.regexp_like(name, F.concat(F.lit("^(?:"), text, F.lit(")"))))


def lookup(names: DataFrame, name: str, index: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """names with rule_id and kind of each rule that matches, once for a rule, and place: exact matches before others, then by rule_id.
    by: further columns that must be equal on both sides, such as a language. A name that is null matches nothing."""
    wanted = stored(index.select("rule_id", "kind", "text", "key", *by).distinct())
    distinct = names.where(F.col(name).isNotNull()).select(F.col(name).alias("_name"), *by).distinct()
    same = Window.partitionBy("kind", "text", *by).orderBy("rule_id")
    part = F.floor((F.row_number().over(same) - 1) / RULES).alias("part")
    rules = wanted.select("kind", "text", *by, "rule_id", part).groupBy("kind", "text", *by, "part").agg(F.collect_list(F.struct("rule_id")).alias("rules"))
    patterns = wanted.groupBy("kind", "text", "key", *by).agg(F.count(F.lit(1)).alias("n"))
    patterns = stored(_rarest(patterns, distinct))
    sizes = patterns.where("key <> ''").groupBy(F.when(F.col("where") == "whole", "start").otherwise(F.col("where")).alias("where")).agg(F.collect_set(F.when(F.col("kind") == "exact", F.lit(-1)).otherwise(F.char_length("key"))).alias("sizes"))
    sizes = {r["where"]: sorted(r["sizes"]) for r in sizes.collect()}  # the lengths that keys have: no more than the longest pattern has letters

    size = F.char_length("_name")
    lengths = lambda where: F.array(*[F.lit(n) for n in sizes.get(where, []) if n > 0]).cast("array<int>")
    fit = lambda where: F.filter(lengths(where), lambda n: n <= size)
    part = lambda begin, n: F.substring(F.col("_name"), begin, n)
    start = F.transform(fit("start"), lambda n: F.struct(F.lit("start").alias("where"), part(F.lit(1), n).alias("key")))
    whole = F.array(F.struct(F.lit("whole").alias("where"), F.col("_name").alias("key")))
    end = F.transform(fit("end"), lambda n: F.struct(F.lit("end").alias("where"), part(size - n + 1, n).alias("key")))
    inner = F.flatten(F.transform(fit("part"), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.struct(F.lit("part").alias("where"), part(i, n).alias("key")))))
    probes = distinct.select("*", F.explode(F.array_distinct(F.concat(whole, start, end, inner))).alias("p")).select("_name", *by, "p.where", "p.key")
    kept = ("_name", *by, "kind", "text", "n")
    found = probes.join(patterns.where("key <> ''").hint("merge"), ["where", "key", *by]).select(*kept)
    bare = patterns.where("key = ''").drop("where", "key")
    tries = bare.count()
    if tries:
        tried = F.broadcast(bare) if tries <= BROADCAST_PATTERNS else bare.hint("merge" if by else "shuffle_replicate_nl")
        found = found.unionByName((distinct.join(tried, list(by)) if by else distinct.crossJoin(tried)).select(*kept))
    matched = stored(found.where(_holds(F.col("_name"), F.col("kind"), F.col("text"))))
    spark = matched.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(matched.agg(F.sum("n")).first()[0] or 0) // TASK_HITS))
    dealt = matched.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RULES))))
    hits = dealt.join(rules.hint("merge"), ["kind", "text", *by, "part"]).select("_name", *by, "kind", "rules")
    # All that follows keeps to a name: rules are told apart where its hits are, and none is shuffled by itself.
    hits = hits.repartition(parts, "_name", *by).select("_name", *by, "kind", F.inline("rules"))
    exact = F.when(F.col("kind") == "exact", 0).otherwise(1)
    if not wanted.groupBy("rule_id", *by).count().where("count > 1").isEmpty():  # a rule of several patterns counts once
        hits = hits.groupBy("_name", *by, "rule_id").agg(F.min_by("kind", F.struct(exact, "kind")).alias("kind"))
    hits = hits.withColumn("place", F.row_number().over(Window.partitionBy("_name", *by).orderBy(exact, "rule_id")))
    columns = [c for c in names.columns if c not in (name, *by)]
    named = names.select(F.col(name).alias("_name"), *by, *columns).hint("merge")
    return named.join(hits, ["_name", *by]).select(F.col("_name").alias(name), *by, *columns, "rule_id", "kind", "place")
