"""Registration of queries with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers a function of (spark, sf_dir); oracle: the same rows in DuckDB over the same tables."""

    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as code units: unit_id, language, file_path, symbol, code."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("unit_id"),
        F.col("lang").alias("language"),
        F.concat("source", F.lit("/"), "lang", F.lit("/doc"), "doc_id", F.lit(".txt")).alias("file_path"),
        F.concat(F.lit("doc_"), "doc_id").alias("symbol"),
        F.col("text").alias("code"),
    )


#: Rows of a task that makes and parses texts: their bytes tell little of its work.
TASK_ROWS = 100_000


def dealt(rows: DataFrame, key: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """rows by key, in as many parts as their number asks for: adaptive execution would merge parts by their bytes, and parsing would run in few tasks."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // task_rows))
    return rows.repartition(parts, key)


UNITS_SQL = """units as (
  select doc_id as unit_id, lang as language, source || '/' || lang || '/doc' || doc_id || '.txt' as file_path,
    'doc_' || doc_id as symbol, text as code from documents)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as files: file_id, path (of the url), content, size."""
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("file_id"), F.regexp_replace("url", r"^https?://", "").alias("path"), F.col("html").alias("content"), F.octet_length("html").cast("long").alias("size")
    )


PAGES_SQL = """files as (
  select page_id as file_id, regexp_replace(url, '^https?://', '') as path, html as content, strlen(html)::bigint as size from pages)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as sink sites: one rule's match at a line of a unit, in scan order seq."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("unit_id"),
        F.concat(F.lit("src/u"), "user_id", F.lit(".py")).alias("file_path"),
        F.concat(F.lit("fn_"), "user_id").alias("symbol"),
        (F.col("event_id") % 7).cast("int").alias("line_start"),
        F.concat(F.lit("rule-"), F.col("event_id") % 23).alias("rule_id"),
        F.col("event_type").alias("category"),
        F.element_at(F.array(*[F.lit(x) for x in ("info", "low", "medium", "high", "critical")]), (F.col("event_id") % 5 + 1).cast("int")).alias("risk_level"),
        F.round(F.lit(0.3) + (F.col("event_id") % 8) / F.lit(10), 6).alias("confidence"),
        F.col("ts"),
    )


SITES_SQL = """sites as (
  select event_id as seq, user_id as unit_id, 'src/u' || user_id || '.py' as file_path, 'fn_' || user_id as symbol,
    (event_id % 7)::int as line_start, 'rule-' || (event_id % 23) as rule_id, event_type as category,
    (['info', 'low', 'medium', 'high', 'critical'])[1 + event_id % 5] as risk_level, event_id % 5 as risk_rank,
    round(0.3::double + (event_id % 8) / 10::double, 6) as confidence, ts from events)"""
