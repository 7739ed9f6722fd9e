"""The queries of the operators on text."""

from __future__ import annotations

from . import queries as Q


def queries():
    return dict(Q.QUERIES)


def oracle_sql():
    return dict(Q.SQL)
