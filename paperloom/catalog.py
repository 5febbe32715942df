"""The registered queries over the tables, by name, with DuckDB SQL for each.

The tables stand in for the relations of shredded word-processing packages: documents and their
lines for blocks, lineitem and orders for tables and rows, events for review changes,
conversations for comment threads, pages for markup.
"""

from __future__ import annotations

from paperloom.operators import QUERIES as _QUERIES
from paperloom.operators import SQL as _SQL

QUERIES = dict(_QUERIES)
ORACLE_SQL = dict(_SQL)
