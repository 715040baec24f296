"""Secret scans: three base patterns, and two character Markov models compared by log-likelihood ratio.

The base patterns are found leftmost and non-overlapping for each kind. The gaps between matches (split) and the matches
(regexp_extract_all) come from the same matcher, so their lengths give every match its position, in code points.

The method adds spans of kind markov: runs of CANDIDATE characters that touch no base span and whose summed log-likelihood
ratio, random string against ordinary identifier, is at least MIN_LLR in all and MIN_MEAN for each transition. Both models
are first-order over single characters, with add-one smoothing. They are trained from labelled samples: random strings are
generated digests in three alphabets, ordinary identifiers are the words of a bounded sample of documents, alone and joined
in pairs by an underscore. Ratios are kept as whole thousandths, at most len(ALPHABET) ** 2 of them, a literal in the plan.

All of it is DataFrame functions. Defined cases: null text is empty and has no spans. Texts of any length are taken whole.
Repeated rows and null ids give a row each. Where no document gives words, identifiers are as good as uniform.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The base patterns, without inline flags, so that every engine reads them alike.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Runs that are too short to count aren't found at all: a look-behind keeps a run's tail from being tried again.
_HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
_CANDIDATE = r"(?<![A-Za-z0-9+/_=-])" + CANDIDATE

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SAMPLE_DOCUMENTS = 1000
SAMPLE_STRINGS = 20_000
MIN_LLR = 12_000
MIN_MEAN = 500
KINDS = ("assign", "access", "hex", "markov")


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def spans(text: str, pattern: str) -> str:
    """SQL for the matches of pattern in column text as array<struct<s, e, v>>; null where there is none."""
    p = _literal(pattern)
    return f"""case when {text} rlike {p} then aggregate(
      zip_with(regexp_extract_all({text}, {p}, 0), split({text}, {p}, -1), (m, g) -> struct(char_length(g) as g, m as v)),
      struct(0L as at, array_repeat(struct(0L as s, 0L as e, '' as v), 0) as found),
      (acc, x) -> case when x.v is null then acc else struct(
        acc.at + x.g + char_length(x.v) as at,
        concat(acc.found, array(struct(acc.at + x.g as s, acc.at + x.g + char_length(x.v) as e, x.v as v))) as found) end,
      acc -> acc.found) end"""


def transitions(samples: DataFrame) -> DataFrame:
    """label, a, b, n: how often character b follows a in the strings of samples(label, value)."""
    values = samples.where(F.char_length("value") > 1).groupBy("label", "value").agg(F.count(F.lit(1)).alias("times"))
    pairs = values.select("label", "times", F.explode(F.expr("transform(sequence(1, char_length(value) - 1), i -> substring(value, i, 2))")).alias("ab"))
    return pairs.groupBy("label", F.substring("ab", 1, 1).alias("a"), F.substring("ab", 2, 1).alias("b")).agg(F.sum("times").alias("n"))


def samples(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, strings: int = SAMPLE_STRINGS) -> DataFrame:
    """Labelled strings: label 1 random, 0 ordinary. documents and strings bound their number."""
    digest = F.sha2(F.concat(F.lit("sample:"), F.col("id").cast("string")).cast("binary"), 256)
    coded = F.when(F.col("id") % 4 == 0, digest).when(F.col("id") % 4 == 1, F.upper(F.conv(F.substring(digest, 1, 15), 16, 36))).otherwise(F.base64(F.unhex(digest)))
    random = docs.sparkSession.range(strings).select(F.lit(1).alias("label"), F.rtrim(F.translate(coded, "=", " ")).alias("value"))
    few = docs.where("text is not null and doc_id is not null").select("doc_id", F.md5(F.col("doc_id").cast("string").cast("binary")).alias("h")).groupBy("h").agg(F.min("doc_id").alias("doc_id")).orderBy("h").limit(documents)
    # A row for each of at most SAMPLE_DOCUMENTS ids joins; a bound that doesn't grow with the data.
    texts = docs.select("doc_id", "text").join(F.broadcast(few.select("doc_id")), "doc_id")
    words = texts.select(F.expr("regexp_extract_all(text, r'[A-Za-z]{2,}', 0)").alias("w"))
    alone = words.select(F.lit(0).alias("label"), F.explode("w").alias("value"))
    joined = words.select(F.lit(0).alias("label"), F.explode(F.expr("zip_with(w, slice(w, 2, greatest(size(w) - 1, 0)), (a, b) -> concat(a, '_', b))")).alias("value")).where("value is not null")
    return random.unionByName(alone).unionByName(joined)


def ratios(docs: DataFrame) -> list[int]:
    """The log-likelihood ratio of each transition in thousandths, by place of a * len(ALPHABET) + place of b."""
    n = len(ALPHABET)
    counts = [[0] * (n * n), [0] * (n * n)]
    for r in transitions(samples(docs)).where(F.col("a").isin(*ALPHABET) & F.col("b").isin(*ALPHABET)).collect():  # at most 2 * n * n rows
        counts[r["label"]][ALPHABET.index(r["a"]) * n + ALPHABET.index(r["b"])] = r["n"]
    rows = [[sum(c[a * n : a * n + n]) for a in range(n)] for c in counts]
    return [round(1000 * (math.log((counts[1][k] + 1) / (rows[1][k // n] + n)) - math.log((counts[0][k] + 1) / (rows[0][k // n] + n)))) for k in range(n * n)]


def scan(docs: DataFrame, llr: list[int]) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans for each row of docs(doc_id, text)."""
    n = len(ALPHABET)
    none = "array_repeat(struct(0L as s, 0L as e, '' as v), 0)"
    found = docs.select(
        "doc_id",
        F.expr(f"coalesce(filter({spans('text', ASSIGN)}, x -> char_length(regexp_extract(x.v, {_literal(ASSIGN)}, 2)) >= 6), {none})").alias("assign"),
        F.expr(f"coalesce(filter({spans('text', ACCESS)}, x -> char_length(x.v) >= 20), {none})").alias("access"),
        F.expr(f"coalesce({spans('text', _HEX)}, {none})").alias("hex"),
        F.expr(f"coalesce({spans('text', _CANDIDATE)}, {none})").alias("candidates"),
    )
    weights = F.split(F.lit(",".join(map(str, llr))), ",").cast("array<int>")  # folded to one literal
    place = lambda i: f"locate(substring(x.v, {i}, 1), '{ALPHABET}')"
    ratio = f"aggregate(sequence(1, char_length(x.v) - 1), 0L, (t, i) -> t + element_at(llr, ({place('i')} - 1) * {n} + {place('i + 1')}))"
    base = found.select("*", F.expr("concat(transform(assign, x -> struct(x.s as s, 0 as k, x.e as e)), transform(access, x -> struct(x.s as s, 1 as k, x.e as e)), transform(hex, x -> struct(x.s as s, 2 as k, x.e as e)))").alias("base"))
    base = base.withColumn("free", F.expr("filter(candidates, c -> not exists(base, b -> b.s < c.e and c.s < b.e))"))
    # The table of ratios is named only where a candidate is left, which is seldom.
    judged = base.withColumn("llr", F.when(F.size("free") > 0, weights))
    judged = judged.withColumn("added", F.expr(f"case when size(free) > 0 then transform(free, x -> struct(x.s as s, 3 as k, x.e as e, {ratio} as r)) end"))
    secret = judged.withColumn("markov", F.expr(f"coalesce(transform(filter(added, x -> x.r >= {MIN_LLR} and x.r >= {MIN_MEAN} * (x.e - x.s - 1)), x -> struct(x.s as s, x.k as k, x.e as e)), array_repeat(struct(0L as s, 0 as k, 0L as e), 0))"))
    kinds = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    joined = lambda a: f"array_join(transform(array_sort({a}), x -> concat({kinds}[x.k], ':', x.s, ':', x.e)), ',')"
    return secret.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.expr(joined("base")).cast("binary"), 256).alias("base_sha256"),
        F.expr(joined("concat(base, markov)")).alias("spans"),
    )


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, ratios(docs))
