"""Column functions for paths, code text, tokens, hashes and vectors. All are built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def glob_regex(pattern: str) -> str:
    """The anchored regular expression of a shell pattern whose * crosses slashes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            while i < len(pattern) and pattern[i] == "*":
                i += 1
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[i + 1 :]:
            j = pattern.index("]", i + 1)
            body = pattern[i:j].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[:1] == "!" else body) + "]")
            i = j + 1
        else:
            out.append(re.escape(c))
    return "(?s)^" + "".join(out) + "$"


def matches_glob(path: Column | str, pattern: str) -> Column:
    return col(path).rlike(glob_regex(pattern))


def path_filter(path: Column | str, pattern: str) -> Column:
    """A path filter in three attempts: the pattern, the pattern below any folder, and plain text as a part of the path."""
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    pattern = pattern.replace("\\", "/")
    found = matches_glob(p, pattern) | matches_glob(p, f"*/{pattern}")
    if not set("*?[") & set(pattern):
        found = found | F.contains(F.lower(p), F.lit(pattern.lower()))
    return found


def path_excluded(path: Column | str, pattern: str) -> Column:
    return F.contains(col(path), F.lit(pattern)) | matches_glob(path, f"*{pattern}*")


def tokens_flat(text: Column | str) -> Column:
    return F.floor(F.char_length(text) * F.lit(3) / F.lit(10)).cast("long")


def tokens_third(text: Column | str) -> Column:
    return F.floor(F.char_length(text) / 3).cast("long")


def tokens_cjk(text: Column | str) -> Column:
    """CJK characters count two thirds of a token, others a quarter."""
    cjk = F.regexp_count(text, F.lit("[\\u4e00-\\u9fff]"))
    return F.floor(cjk / F.lit(1.5) + (F.char_length(text) - cjk) / F.lit(4)).cast("long")


def short_id(*parts: Column | str, bits: int = 256, digits: int = 16, sep: str = ":") -> Column:
    return F.substring(F.sha2(F.concat_ws(sep, *[col(p).cast("string") for p in parts]).cast("binary"), bits), 1, digits)


def lines(text: Column | str) -> Column:
    return F.split(text, "\n", -1)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Dot product over the norms; a zero vector gives 0."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-10))


def jaccard(a: Column | str, b: Column | str) -> Column:
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(0.0)).otherwise(both / either)


def cwe_ids(metadata: Column | str, tags: Column | str) -> Column:
    """The distinct CWE ids of a JSON object's field cwe, a string or a list, and of those tags that begin with CWE-; sorted."""
    named = F.coalesce(F.regexp_extract_all(F.get_json_object(metadata, "$.cwe"), F.lit("CWE-[0-9]+"), F.lit(0)), F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(named, F.filter(tags, lambda t: t.rlike("^CWE-[0-9]+$")))))


#: The order of risks and severities.
RISKS = ("info", "low", "medium", "high", "critical")


def risk_rank(risk: Column | str) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, RISKS)), F.lower(col(risk))).cast("int") - 1, F.lit(-1))


def risk_name(rank: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, RISKS)), col(rank) + 1)
