"""Registry of the runnable queries and, where SQL can say the same, their ANSI text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from fabsight.views import SQL_VIEWS, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def portable(df: DataFrame) -> DataFrame:
    """Zone-free timestamps and doubles, so results compare with any SQL engine."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def with_views(body: str) -> str:
    """Prefix ``body`` with the common table expressions of the domain views it names."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, sql in SQL_VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit_deps(name, sql)

    def visit_deps(name: str, sql: str) -> None:
        for dep, dep_sql in SQL_VIEWS.items():
            if dep != name and dep not in needed and re.search(rf"\b{dep}\b", sql):
                visit_deps(dep, dep_sql)
        if name not in needed:
            needed.append(name)

    visit(body)
    body = body.strip()
    text = " ".join([body, *[SQL_VIEWS[n] for n in needed]])
    # what is read more than once is computed once
    kept = {n: " MATERIALIZED" if len(re.findall(rf"\b{n}\b", text)) > 1 else "" for n in needed}
    ctes = ",\n".join(f"{n} AS{kept[n]} (\n{SQL_VIEWS[n].strip()}\n)" for n in needed)
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):]}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[4:]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under an operator name."""

    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return portable(fn(Views.of(spark, sf_dir)))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return deco
