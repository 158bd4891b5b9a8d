"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.session import materialize

__all__ = ["free_name", "materialize", "shuffle_partitions", "table", "text_or_empty", "worker_cache"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; `sf_dir` may be any path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_cache(kind: str, key, make):
    """`make()` once per Python worker and `key`; one entry of each `kind` is kept.

    Functions reach the workers by value, so their module globals are fresh in
    every task; a holder module outlives the task with the (reused) worker.
    """
    holder = sys.modules.setdefault("_costlens_llm_cache", types.ModuleType("_costlens_llm_cache"))
    held = holder.__dict__.get(kind)
    if held is None or held[0] != key:
        held = (key, make())
        holder.__dict__[kind] = held
    return held[1]


def free_name(df: DataFrame, taken: set[str], stem: str) -> str:
    """A column name starting with `stem` that no column of `df` (and none of `taken`) has, in any case."""
    used = {c.lower() for c in df.columns} | {c.lower() for c in taken}
    name = stem
    while name.lower() in used:
        name += "_"
    return name


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit(""))
