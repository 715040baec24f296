"""A search query's modifiers as predicates: key:value, -key:value, quoted values and plain words."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

_MODIFIER = re.compile(r'(-?)(\w+):("[^"]*"|\S+)')
#: The keys that are known, by what they filter.
KEYS = {"path": "path", "file": "path", "lang": "language", "language": "language", "symbol": "symbol", "exclude": "path", "ext": "path"}


@dataclass
class Query:
    words: list[str] = field(default_factory=list)
    filters: list[tuple[str, str]] = field(default_factory=list)
    exclusions: list[tuple[str, str]] = field(default_factory=list)


def parse(text: str) -> Query:
    out = Query()

    def take(m: re.Match) -> str:
        minus, key, value = m[1], m[2].lower(), m[3].strip('"')
        if key not in KEYS:
            return m[0]
        value = f"*.{value.lstrip('.')}" if key == "ext" else value
        (out.exclusions if minus or key == "exclude" else out.filters).append((KEYS[key], value))
        return " "

    out.words = [w.lower() for w in re.findall(r"[A-Za-z0-9_.]{2,}", _MODIFIER.sub(take, text))]
    return out


def predicate(query: Query) -> Column:
    """All filters hold, no exclusion does, and a word is found if there are words. Nothing at all matches nothing."""
    if not (query.words or query.filters or query.exclusions):
        return F.lit(False)
    one = {"path": lambda v: C.path_filter("file_path", v), "language": lambda v: F.lower("language") == v.lower(), "symbol": lambda v: F.contains("symbol", F.lit(v))}
    out = F.lit(True)
    for key, value in query.filters:
        out = out & one[key](value)
    for key, value in query.exclusions:
        out = out & ~(C.path_excluded("file_path", value) if key == "path" else one[key](value))
    if query.words:
        out = out & F.exists(F.array(*map(F.lit, query.words)), lambda w: F.contains(F.lower("code"), w))
    return out


def search(units: DataFrame, text: str) -> DataFrame:
    return units.where(predicate(parse(text)))
