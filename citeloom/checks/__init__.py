"""Queries over the given tables, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Check:
    run: Query
    sql: str | None = None


class Registry(dict):
    """name → Check, filled by decorator."""

    def query(self, sql: str | None = None, name: str | None = None):
        def add(run: Query) -> Query:
            self[name or run.__name__] = Check(run, sql)
            return run

        return add


def all_checks() -> dict[str, Check]:
    from citeloom.checks import answering, corpus_state, curation, discovery, incremental, retrieval, runs, scalars, selection

    merged: dict[str, Check] = {}
    for module in (retrieval, scalars, discovery, corpus_state, selection, curation, answering, incremental, runs):
        for name, check in module.CHECKS.items():
            assert name not in merged, name
            merged[name] = check
    return merged
