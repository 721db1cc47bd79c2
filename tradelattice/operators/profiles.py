"""Grouped sums, table profiles and the focus-country reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tradelattice.functions import constants as K
from tradelattice.operators.ordering import top_k


def total_by(df: DataFrame, by: Sequence[str], value: str, total: str | None = None) -> DataFrame:
    """Grouped sum; pre-aggregated in every task, so hot keys shrink before the exchange."""
    return df.groupBy(*by).agg(F.sum(value).alias(total or value))


def benchmark_gap(df: DataFrame, value: str, benchmark: float = K.EXPORT_BENCHMARK) -> DataFrame:
    """Global sum and its percentage gap to a benchmark."""
    return df.agg(F.sum(value).alias("total")).withColumn(
        "gap_pct", (F.col("total") - F.lit(benchmark)) / F.lit(benchmark) * 100
    )


def profile(df: DataFrame, distinct: dict[str, str], year: str = "year") -> DataFrame:
    """Row count, exact distinct counts and the year span, as one row."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.countDistinct(c).alias(name) for name, c in distinct.items()],
        F.min(year).alias("first_year"), F.max(year).alias("last_year"),
    )


def latest_year(df: DataFrame, by: Sequence[str] = (), year: str = "year") -> DataFrame:
    return df.groupBy(*by).agg(F.max(year).alias(year))


def in_latest_year(df: DataFrame, by: Sequence[str] = (), year: str = "year") -> DataFrame:
    """Rows of the latest year, of the table or of each group, without a driver round trip."""
    return df.join(latest_year(df, by, year), [*by, year])


def one_per_key(df: DataFrame, keys: Sequence[str], constants: Sequence[str]) -> DataFrame:
    """One row per key where the other columns are constant per key."""
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in constants])


def widen(df: DataFrame, keys: Sequence[str], name: str, value: str, columns: Sequence[str]) -> DataFrame:
    """Long to wide over a fixed list of names; of repeated entries the largest counts."""
    return df.groupBy(*keys).pivot(name, list(columns)).agg(F.max(value))


def merge_indicators(tables: Sequence[DataFrame], keys: Sequence[str] = ("iso3", "year")) -> DataFrame:
    """Full outer merge of one-indicator tables on the keys."""
    first, *rest = tables
    for t in rest:
        first = first.join(t, list(keys), "full_outer")
    return first


def _report_rows(df: DataFrame, item: str, label: str, value: str) -> DataFrame:
    return df.select(
        F.lit(item).alias("item"), F.col(label).cast("string").alias("label"), F.col(value).cast("double").alias("value")
    )


def validation_report(
    exports: DataFrame,
    flows: DataFrame | None = None,
    country: str = K.FOCUS_COUNTRY,
    year: int | None = None,
    benchmark: float = K.EXPORT_BENCHMARK,
    k: int = 10,
) -> DataFrame:
    """Latest year, total, gap to the benchmark, top products and top markets of one country.

    Long rows ``(item, label, value)``. A country without exports gives the single item ``error``.
    """
    own = exports.where(F.col("iso3") == country)
    at = latest_year(own) if year is None else exports.sparkSession.range(1).select(F.lit(year).alias("year"))
    now = own.join(F.broadcast(at), "year")  # one row
    totals = now.agg(F.max("year").alias("year"), F.sum("export_value").alias("total"), F.count(F.lit(1)).alias("n"))
    head = totals.select(
        F.explode(
            F.when(
                F.col("n") == 0,
                F.array(_item("error", F.lit(f"no {country} data"), F.lit(None))),
            ).otherwise(
                F.array(
                    _item("latest_year", F.lit(None), F.col("year")),
                    _item("total_exports", F.lit(None), F.col("total")),
                    _item("benchmark_gap_pct", F.lit(None), (F.col("total") - benchmark) / benchmark * 100),
                )
            )
        ).alias("r")
    ).select("r.*")
    products = total_by(now, ["hs4"], "export_value")
    rows = head.unionByName(
        _report_rows(top_k(products, [F.desc("export_value"), F.asc("hs4")], k), "top_product", "hs4", "export_value")
    )
    if flows is not None:
        sold = flows.where((F.col("reporter_iso3") == country) & (F.col("flow") == "X")).join(F.broadcast(at), "year")
        markets = total_by(sold, ["partner_iso3"], "value")
        rows = rows.unionByName(
            _report_rows(top_k(markets, [F.desc("value"), F.asc("partner_iso3")], k), "top_market", "partner_iso3", "value")
        )
    return rows


def _item(name: str, label: Column, value: Column) -> Column:
    return F.struct(
        F.lit(name).alias("item"), label.cast("string").alias("label"), value.cast("double").alias("value")
    )


def complexity_report(complexity: DataFrame, country: str = K.FOCUS_COUNTRY, k: int = 10) -> DataFrame:
    """Index, diversity, number of products with comparative advantage, and the nearest open products.

    Long rows ``(item, label, value, pci)`` of the country's latest year.
    """
    now = in_latest_year(complexity.where(F.col("iso3") == country))
    none = F.lit(None).cast("double")
    head = now.agg(
        F.max("eci").alias("eci"), F.max("diversity").alias("diversity"), F.sum("mcp").alias("products_with_rca"),
    ).select(
        F.explode(
            F.array(*[_item(c, F.lit(None), F.col(c)) for c in ("eci", "diversity", "products_with_rca")])
        ).alias("r")
    ).select("r.*", none.alias("pci"))
    nearest = top_k(now.where(F.col("mcp") == 0), [F.desc_nulls_last("density"), F.asc("hs4")], k)
    return head.unionByName(
        nearest.select(
            F.lit("nearest_product").alias("item"), F.col("hs4").alias("label"), F.col("density").alias("value"), "pci"
        )
    )
