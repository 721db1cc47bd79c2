"""File scans, processed-table sinks and read-through tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradelattice.functions import constants as K
from tradelattice.operators import cleaning as P, complexity as C


def read_csv(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """CSV with a header, every column as text, so that codes keep their zeros and no inference pass is run.

    Only the columns the plan uses are parsed.
    """
    df = spark.read.option("header", True).csv(path)
    return df if columns is None else P.keep_present(df, columns)


def read_exports(spark: SparkSession, path: str, years: tuple[int, int] = K.EXPORT_YEARS) -> DataFrame:
    """Cleaned country-product-year table out of its CSV file."""
    raw = read_csv(spark, path)
    return P.clean_exports(P.require_columns(raw, ["year", "country_iso3_code", "product_hs92_code", "export_value"]), years)


def read_gravity(spark: SparkSession, path: str, years: tuple[int, int] = K.GRAVITY_YEARS) -> DataFrame:
    """Cleaned country-pair covariates: 13 columns out of the wide CSV file."""
    return P.clean_gravity(read_csv(spark, path, K.GRAVITY_COLUMNS), years)


def save(df: DataFrame, path: str, by_year: bool = True) -> None:
    """Overwrite a Parquet table, one folder per year where the table has years."""
    if by_year and "year" in df.columns:
        # One even set of files per year instead of one file per task and year; Spark splits large years.
        df.hint("rebalance", "year").write.mode("overwrite").partitionBy("year").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def save_complexity(result: C.Complexity, folder: str, proximity: DataFrame | None = None) -> list[str]:
    """Write the complexity table, its country, product and density projections, and the proximities.

    An absent or empty proximity table is skipped. Returns the names written.
    """
    save(result.table, f"{folder}/complexity")
    table = result.table.sparkSession.read.parquet(f"{folder}/complexity")
    parts = {
        "country_complexity": C.country_complexity(table),
        "product_complexity": C.product_complexity(table),
        "density_matrix": C.density_table(table),
    }
    if proximity is not None and not proximity.isEmpty():
        parts["proximity_matrix"] = proximity
    for name, df in parts.items():
        save(df, f"{folder}/{name}")
    return ["complexity", *parts]


def save_graph(nodes: dict[str, DataFrame], edges: DataFrame, folder: str) -> None:
    """Write one table per node type and one edge table partitioned by relation."""
    for name, df in nodes.items():
        save(df, f"{folder}/nodes/{name}", by_year=False)
    edges.hint("rebalance", "rel").write.mode("overwrite").partitionBy("rel").parquet(f"{folder}/edges")


def is_complete(spark: SparkSession, path: str) -> bool:
    """True when a finished write is at ``path``."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def materialise(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the table at ``path``; build and write it first where no finished write is there."""
    if not is_complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
