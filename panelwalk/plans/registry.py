"""Queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.common import rounded
from .sql import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, exact: bool = False, digits: int = 6) -> Callable[[Query], Query]:
    """Registers a query; its doubles are rounded here, as in its SQL, unless they are exact. Prices are cents
    by a quantity of up to 50, which can end in a five at the seventh digit: eight digits leave no ties."""

    def put(f: Query) -> Query:
        QUERIES[name] = f if exact else lambda spark, d: rounded(f(spark, d), digits)
        if oracle:
            ORACLES[name] = sql(oracle.replace(', 6)', f', {digits})'))
        return f

    return put
