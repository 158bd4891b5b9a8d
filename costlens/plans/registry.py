"""Registry of named test queries: a Spark plan plus its DuckDB oracle SQL.

Each registered query reads the driver's test tables (through
`costlens.sources.fixtures.Tables`) and runs one or more engine operators
over the whole tables.  Dates and timestamps are presented as ISO text on
both sides so the value comparison does not depend on client-side type
conversions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from costlens.sources.fixtures import with_fixtures


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: tuple[str, ...]
    raw_sql: str | None = None
    fixtures: tuple[str, ...] = ()
    fn: Callable[[SparkSession, str], DataFrame] | None = None


REGISTRY: dict[str, Query] = {}


def present(df: DataFrame) -> DataFrame:
    """Dates -> 'yyyy-MM-dd', timestamps -> 'yyyy-MM-dd HH:mm:ss.SSSSSS'."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, ops: str, fixtures: list[str] | None = None, sql: str | None = None):
    """Register `fn(spark, sf_dir) -> DataFrame` under `name`.

    `sql` is the oracle query; `fixtures` names the engine inputs it reads,
    which are prepended as CTEs.  `sql=None` marks a query without an exact
    SQL form (model fitting); the driver then checks rows only.
    """

    def deco(fn):
        full = with_fixtures(sql, fixtures) if (sql is not None and fixtures) else sql

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(spark, sf_dir))

        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        REGISTRY[name] = Query(name, build, full, tuple(ops.split()), sql, tuple(fixtures or ()), fn)
        return fn

    return deco


# SQL snippets used by oracle texts.
def d_(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d')"


def ts_(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def dsum_(expr: str) -> str:
    return f"cast(sum(cast({expr} as decimal(38,10))) as double)"


def davg_(expr: str) -> str:
    return f"({dsum_(expr)} / cast(count({expr}) as double))"
