"""Registered queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tradelattice.plans.views import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Named SQL queries the oracles share, besides the views of the test tables.
SHARED: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Register ``f(tables) -> DataFrame`` under ``name``; ``oracle`` is SQL with ``{view}`` references."""

    def register(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, folder: f(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = with_views(oracle, SHARED)
        return f

    return register


# Columns that come out of standardised scores carry more rounding noise than plain ratios.
COARSE = {"eci", "pci", "cog", "coi", "score"}
# Amounts of money that are not plain sums.
AMOUNTS = {"predicted_value", "gravity_pred"}


def rounded(df: DataFrame, digits: int = 8, coarse: int = 6) -> DataFrame:
    """Doubles rounded for comparison across engines."""
    places = lambda name: coarse if name in COARSE else 2 if name in AMOUNTS else digits
    return df.select(*[
        F.round(f.name, places(f.name)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ])


def r(expression: str, digits: int = 8) -> str:
    """The same rounding in SQL, without negative zero."""
    return f"(round({expression}, {digits}) + 0.0)"


def r6(expression: str) -> str:
    return r(expression, 6)
