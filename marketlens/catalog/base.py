"""Registry of runnable queries with the SQL each one must agree with."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.catalog.model import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers fn(tables) under `name`; `sql` may use the canonical views by name."""
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn
    return register


def digest(df: DataFrame, keys: list[str], columns: list[str], digits: int = 4) -> DataFrame:
    """Per key the number of values and their rounded sum for each column: a compact form of a wide result."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in columns:
        aggs += [F.count(c).alias(f"n_{c}"), F.round(F.sum(F.col(c).cast("double")), digits).alias(f"s_{c}")]
    return df.groupBy(*keys).agg(*aggs)


def digest_sql(source: str, keys: list[str], columns: list[str], digits: int = 4) -> str:
    parts = [f'count("{c}") as "n_{c}", round(sum("{c}"::double), {digits}) as "s_{c}"' for c in columns]
    return f"select {', '.join(keys)}, count(*) as n_rows, {', '.join(parts)} from {source} group by {', '.join(keys)}"
