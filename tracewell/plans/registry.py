"""The table of named queries with the SQL that checks each one."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import tune
from .bindings import Tables

CTES: dict[str, str] = {}


@dataclass(frozen=True)
class Query:
    name: str
    survey: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(tune(spark), sf_dir))


QUERIES: dict[str, Query] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def expand(sql: str) -> str:
    """Put the shared table expressions a statement names in front of it, in order of need."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in ordered and re.search(rf"\b{name}\b", text):
                visit_one(name)

    def visit_one(name: str) -> None:
        for other in CTES:
            if other != name and other not in ordered and re.search(rf"\b{other}\b", CTES[name]):
                visit_one(other)
        if name not in ordered:
            ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    body = ",\n".join(f"{name} AS (\n{CTES[name]}\n)" for name in ordered)
    return f"WITH RECURSIVE {body}\n{sql}"


def query(name: str, *survey: str, sql: str | None = None):
    def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, survey, build, None if sql is None else sql.strip())
        return build

    return register
