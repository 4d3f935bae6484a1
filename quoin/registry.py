"""All queries outside the subpackage llm, with their SQL."""

from __future__ import annotations

from . import layout_queries

QUERIES: dict = layout_queries.QUERIES
ORACLES: dict = layout_queries.ORACLES
