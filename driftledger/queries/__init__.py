"""Registered queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def whole_counts(sql: str) -> str:
    """count_if() written as count(case ...), which is a BIGINT and zero where nothing counts."""
    while (at := sql.find("count_if(")) >= 0:
        end, open_ = at + 9, 1
        while open_:
            open_ += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(case when {sql[at + 9 : end - 1]} then 1 end){sql[end:]}"
    return sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is omitted where SQL cannot express it."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = whole_counts(sql)
        return f

    return register


def load() -> None:
    from . import dag, graph, history, keyed, measure, mutations, project, review, static, streams, text  # noqa: F401
