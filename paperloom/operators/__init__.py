"""Relational operators; each module registers its queries when it is imported."""

from paperloom.operators import aggregates, edits, joins, lexing, notes, reading, spans, windows  # noqa: F401
from paperloom.operators.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
