"""All queries of the library's own operators, by name, and their DuckDB equivalents."""

from __future__ import annotations

from . import files_and_text, graphs, more, programs, ranges, reports, reviews, rule_scans, searches, sources_and_parsers, stores_and_trees  # noqa: F401  registers its queries
from .query import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "flagship_risk_scan"
