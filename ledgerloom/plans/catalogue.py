"""The core queries and their SQL."""

from __future__ import annotations

from . import ledger_queries, ledger_sql, problems, problems_sql


def queries():
    return ledger_queries.QUERIES | problems.QUERIES


def oracle_sql():
    return ledger_sql.SQL | problems_sql.SQL
