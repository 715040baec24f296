"""Operators on the text of units: search, redaction, signatures, windows, chunks."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.columns import col
from ..sources.scratch import stored


def grep(files: DataFrame, pattern: str, context: int = 0) -> DataFrame:
    """A row for each line that matches, with the lines around it."""
    rows = files.withColumn("ls", C.lines("content")).drop("content")
    found = rows.select("*", F.posexplode("ls").alias("i", "line")).where(F.col("line").rlike(pattern))
    before = F.expr(f"slice(ls, greatest(1, i + 1 - {context}), least(i, {context}))")
    after = F.expr(f"slice(ls, i + 2, {context})") if context else F.array().cast("array<string>")
    return found.withColumn("before", before).withColumn("after", after).withColumn("line_no", (F.col("i") + 1).cast("long")).drop("ls", "i")


def term_grep(units: DataFrame, terms: Sequence[str], limit: int = 30, score: float = 0.4) -> DataFrame:
    """At most five terms, any of them, whatever the case; a constant score."""
    import re

    return units.where(F.lower("code").rlike("|".join(re.escape(t.lower()) for t in terms[:5]))).withColumn("score", F.lit(score)).orderBy("file_path", "unit_id").limit(limit)


def keywords(text: str, stop: Sequence[str], least: int = 2) -> Column:
    """Distinct lower-case identifiers of at least two characters that aren't stop words, in order."""
    words = F.transform(F.regexp_extract_all(text, F.lit(rf"[A-Za-z_][A-Za-z0-9_]{{{least - 1},}}"), F.lit(0)), F.lower)
    return F.array_sort(F.array_except(words, F.array(*map(F.lit, stop))))


#: What is redacted, in this order.
REDACTIONS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}", "[REDACTED:EMAIL]"),
    (r"[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}", "[REDACTED:CARD]"),
    (r"""(api_key|password|secret|token)( ?[:=] ?)["']?[A-Za-z0-9+/_-]{8,}""", "$1$2[REDACTED:KEY]"),
)


def redact(text: Column | str) -> Column:
    out = col(text)
    for pattern, by in REDACTIONS:
        out = F.regexp_replace(out, pattern, by)
    return out


def mask(key: str, shown: int = 4) -> Column:
    n = F.char_length(key)
    return F.when(n <= shown, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(key, 1, shown), F.repeat(F.lit("*"), n - shown)))


def signature(code: Column | str, most: int = 500) -> Column:
    out = col(code)
    for pattern, by in (('"[^"]*"', '"STR"'), ("[0-9]+", "NUM"), ("[A-Za-z_][A-Za-z0-9_]*", "VAR"), (r"[ \t\n\r\f\x0B]+", " ")):
        out = F.regexp_replace(out, pattern, by)
    return F.substring(out, 1, most)


#: Comments by language.
COMMENTS = {"python": r"#[^\n]*", "c": r"(?s)/\*.*?\*/|//[^\n]*", "html": r"(?s)<!--.*?-->"}


def without_comments(code: Column | str, language: str) -> Column:
    return F.regexp_replace(code, COMMENTS[language], "")


def size_text(n: Column | str) -> Column:
    out = F.when(col(n) < 1024, F.concat(col(n).cast("string"), F.lit(" B")))
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = out.when(col(n) < 1024 ** (k + 1), F.format_string(f"%.1f {unit}", col(n) / F.lit(1024.0**k)))
    return out.otherwise(F.format_string("%.1f TB", col(n) / F.lit(1024.0**4)))


def truncate(text: str, most: int, suffix: str = "...") -> Column:
    return F.when(F.char_length(text) <= most, F.col(text)).otherwise(F.concat(F.substring(text, 1, most - len(suffix)), F.lit(suffix)))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r'[<>:"/\\|?*]', "_")


def relative(path: str, base: str) -> Column:
    return F.when(F.startswith(path, F.lit(base)), F.expr(f"substring({path}, {len(base) + 1})")).otherwise(F.col(path))


def head_tail(code: str, most_lines: int, head: int = 40, tail: int = 30) -> Column:
    """Over most_lines lines, the first head and last tail per cent of them, with the number of those left out."""
    ls = C.lines(code)
    n = F.size(ls)
    a, b = F.floor(n * head / 100).cast("int"), F.floor(n * tail / 100).cast("int")
    short = F.concat(F.array_join(F.slice(ls, F.lit(1), a), "\n"), F.lit("\n... "), (n - a - b).cast("string"), F.lit(" lines omitted ...\n"), F.array_join(F.slice(ls, n - b + 1, b), "\n"))
    return F.when(n <= most_lines, F.col(code)).otherwise(short)


def embedding_text(code_chars: int = 2000) -> Column:
    fixed = [F.concat(F.lit(f"{label}: "), F.col(c)) for label, c in (("Language", "language"), ("File", "file_path"), ("Symbol", "symbol"), ("Type", "unit_type"), ("Signature", "signature"))]
    return F.concat_ws("\n", *fixed, F.lit("Code:"), F.substring("code", 1, code_chars))


def line_windows(files: DataFrame, size: int = 50, overlap: int = 5, keep_blank: bool = False) -> DataFrame:
    """Windows of size lines, each overlapping the one before; blank ones are skipped."""
    rows = files.withColumn("ls", C.lines("content")).drop("content")
    starts = F.explode(F.sequence(F.lit(0), F.size("ls") - 1, F.lit(size - overlap)))
    cut = rows.withColumn("s", starts).withColumn("part", F.expr(f"slice(ls, s + 1, {size})"))
    out = cut.withColumn("chunk", F.array_join("part", "\n")).withColumn("start_line", (F.col("s") + 1).cast("long")).withColumn("end_line", F.least(F.col("s") + size, F.size("ls")).cast("long"))
    if not keep_blank:
        out = out.where(F.array_join("part", "").rlike(r"[^ \t\r]"))
    return out.drop("ls", "s", "part")


def reassemble(chunks: DataFrame, parent: str) -> DataFrame:
    """The parent's text and span from its chunks, in their order."""
    parts = F.array_sort(F.collect_list(F.struct("start_line", "chunk")))
    return chunks.groupBy(parent).agg(F.array_join(F.transform(parts, lambda x: x["chunk"]), "\n").alias("content"), F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line"))


def unit_chunks(units: DataFrame, max_tokens: int = 2000) -> DataFrame:
    """Units over max_tokens (0.3 a character) packed greedily by lines; others are one chunk. A fold over the unit's own lines."""
    budget = int(max_tokens / 0.3)
    fold = f"""aggregate(split(code, '\\n', -1),
      struct(array_repeat(struct(0 as a, 0 as b, 0 as n), 0) as done, struct(0 as a, 0 as b, 0 as n) as open),
      (acc, l) -> if(acc.open.b > acc.open.a and acc.open.n + char_length(l) + 1 > {budget},
        struct(concat(acc.done, array(acc.open)) as done, struct(acc.open.b as a, acc.open.b + 1 as b, char_length(l) + 1 as n) as open),
        struct(acc.done as done, struct(acc.open.a as a, acc.open.b + 1 as b, acc.open.n + char_length(l) + 1 as n) as open)),
      acc -> concat(acc.done, array(acc.open)))"""
    whole = "array(struct(0 as a, size(split(code, '\\n', -1)) as b, 0 as n))"
    rows = units.withColumn("cuts", F.expr(f"if(char_length(code) * 3 > {max_tokens} * 10, {fold}, {whole})"))
    out = rows.select("*", F.posexplode("cuts").alias("chunk_index", "cut")).withColumn("total_chunks", F.size("cuts"))
    return out.select(
        "unit_id",
        F.when(F.col("total_chunks") > 1, F.concat(F.col("unit_id").cast("string"), F.lit("_chunk"), "chunk_index")).otherwise(F.col("unit_id").cast("string")).alias("chunk_id"),
        "chunk_index",
        "total_chunks",
        (F.col("cut.a") + 1).alias("start_line"),
        F.col("cut.b").alias("end_line"),
        F.array_join(F.expr("slice(split(code, '\\n', -1), cut.a + 1, cut.b - cut.a)"), "\n").alias("chunk"),
    )


def packed_spans(counts: Sequence[int], most: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of lines that hold most tokens together; each starts with the last lines of the one before, overlap tokens at most."""
    spans, start, held = [], 0, 0
    for at, n in enumerate(counts):
        if held + n > most and at > start:
            spans.append((start, at))
            first, start, held = start, at, 0
            while start > first and held + counts[start - 1] <= overlap:
                start -= 1
                held += counts[start]
        held += n
    return [*spans, (start, len(counts))]


def overlapping_chunks(files: DataFrame, max_tokens: int, overlap_tokens: int = 100) -> DataFrame:
    """The files' other columns with chunk_index, start_line, end_line, chunk of content; texts within max_tokens are one chunk, nulls none."""

    @F.pandas_udf("array<struct<a: int, b: int>>")
    def spans(counts: pd.Series) -> pd.Series:
        return pd.Series([[{"a": a, "b": b} for a, b in packed_spans([int(x) for x in c], max_tokens, overlap_tokens)] for c in counts])

    ls = C.lines("content")
    rows = files.where(F.col("content").isNotNull()).withColumn("spans", spans(F.transform(ls, C.tokens_cjk)))
    whole = F.array(F.struct(F.lit(0).alias("a"), F.size(ls).alias("b")))
    rows = rows.withColumn("spans", F.when(C.tokens_cjk("content") <= max_tokens, whole).otherwise(F.col("spans")))
    # Chunks are cut out before they become rows, so that no row carries the whole text.
    cut = F.transform("spans", lambda x: F.struct((x["a"] + 1).cast("long").alias("start_line"), x["b"].cast("long").alias("end_line"), F.array_join(F.slice(ls, x["a"] + 1, x["b"] - x["a"]), "\n").alias("chunk")))
    others = [c for c in files.columns if c != "content"]
    return rows.select(*others, cut.alias("chunks")).select(*others, F.posexplode("chunks").alias("chunk_index", "c")).select(*others, "chunk_index", "c.*")


def line_and_column(text: str, offset: int) -> tuple[Column, Column]:
    """Line (from 1) and column (from 0) of a character offset."""
    parts = C.lines(F.substring(text, 1, offset))
    return F.size(parts).cast("long").alias("line"), F.char_length(F.element_at(parts, -1)).cast("long").alias("col")


def keyword_lines(files: DataFrame, words: Sequence[str]) -> DataFrame:
    """Each keyword that a line holds, whatever the case, with the line's number from 1."""
    found = files.select("doc_id", F.posexplode(C.lines("content")).alias("i", "line"))
    hits = F.explode(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower("line"), w)))
    return found.select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), hits.alias("keyword"))


def predecessor(rows: DataFrame, key: str) -> DataFrame:
    """rows, each under the next key of the table: keys are sorted in ranges, so that no task sorts them all.

    The keys and their ranges are written first: ranges drawn twice, or merged by adaptive execution in one branch only, would differ."""
    ranged = rows.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(F.col(key)).sortWithinPartitions(key)
    placed = stored(ranged.withColumn("part", F.spark_partition_id()))
    following = placed.withColumn("next", F.lead(key).over(Window.partitionBy("part").orderBy(key)))
    first = placed.groupBy("part").agg(F.min(key).alias("first")).withColumn("next_first", F.lead("first").over(Window.orderBy("part"))).drop("first")
    steps = following.join(first, "part").select(key, F.coalesce("next", "next_first").alias("next")).where("next is not null")
    return rows.join(steps, key).select(F.col("next").alias(key), *[c for c in rows.columns if c != key])
