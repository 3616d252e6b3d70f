"""The queries by name, each with its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.plans.derive import derive, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *relations: str, sql: str):
    """Registers f(relation, ...) under a name, with its SQL."""

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(*[derive(spark, sf_dir, r) for r in relations])
        ORACLES[name] = oracle(sql)
        return f

    return register


def recursive(name: str, *relations: str, sql: str):
    """As `query`, for SQL with a recursive common table expression."""

    def register(f):
        query(name, *relations, sql=sql)(f)
        ORACLES[name] = ORACLES[name].replace("WITH ", "WITH RECURSIVE ", 1)
        return f

    return register


def r4(*names: str):
    return [F.round(n, 4).alias(n) for n in names]
