"""Named queries over the given tables, each with its output columns and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadsift.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# d: double rounded to six decimals, n: bigint, b: boolean as 0/1, s: string
SQL_CAST = {
    "s": "CAST({c} AS VARCHAR)",
    "n": "CAST({c} AS BIGINT)",
    "b": "CAST({c} AS BIGINT)",
    "d": "floor(CAST({c} AS DOUBLE) * 1000000.0 + 0.5) / 1000000.0 + 0.0",
}


def _spark_cast(c: Column, kind: str) -> Column:
    if kind == "s":
        return c.cast("string")
    if kind in ("n", "b"):
        return c.cast("bigint")
    # "+ 0.0" turns a negative zero into zero
    return F.floor(c.cast("double") * 1000000.0 + 0.5) / F.lit(1000000.0) + F.lit(0.0)


def parse(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in spec.split()]


def finish(df: DataFrame, spec: str) -> DataFrame:
    """Project to the declared columns with one plain type each."""
    return df.select(*[_spark_cast(F.col(f"`{name}`"), kind).alias(name) for name, kind in parse(spec)])


class Tables:
    """The given Parquet tables, read on first use."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def query(name: str, spec: str, sql: str | None = None):
    """Register a function of ``Tables`` under ``name`` with its output columns and oracle SQL."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: finish(fn(Tables(tune(spark), sf_dir)), spec)
        if sql is not None:
            cols = ", ".join(f"{SQL_CAST[kind].format(c=col)} AS {col}" for col, kind in parse(spec))
            ORACLES[name] = f"SELECT {cols} FROM ({sql}) AS answer"
        return fn

    return register
