"""Bilateral slices: one stored piece per (reporter, flow, year, level, partner)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Partner part in the file names of the two slice families, their columns, and the pattern of a slice name.
PARTNERS = {"totals": "0", "bilateral": "all"}
EMPTY = {
    "totals": "period int, reporterCode int, cmdCode string, fobvalue double",
    "bilateral": "period int, reporterCode int, partnerCode int, cmdCode string, flowCode string, primaryValue double, fobvalue double, cifvalue double",
}
NAME = r"([A-Za-z0-9]+)_([A-Z]+)_([0-9]{4})_hs([0-9]+)_p([A-Za-z0-9]+)\.parquet"


def slice_name(reporter: Column, flow: Column, year: Column, level: int, partner: str) -> Column:
    return F.concat(
        reporter.cast("string"), F.lit("_"), flow, F.lit("_"), year.cast("string"), F.lit(f"_hs{level}_p{partner}.parquet")
    )


def write_slices(df: DataFrame, folder: str, reporter: str, flow: str, year: str, level: int, partner: str) -> None:
    """Write every slice of ``df`` to its own folder; slices in ``df`` are replaced, others stay.

    Rows are rebalanced by slice first: small slices share tasks, a hot slice is split over several.
    """
    named = df.withColumn("slice", slice_name(F.col(reporter), F.col(flow), F.col(year), level, partner))
    (
        named.hint("rebalance", "slice")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slice").parquet(folder)
    )


def slice_paths(
    folder: str, family: str, reporters: Iterable[str | int] | None = None, flows: Iterable[str] | None = None,
    years: Iterable[int] | None = None,
) -> str:
    """One path pattern of the slices asked for; only their names are listed, and only their files opened."""
    any_of = lambda values: "*" if values is None else "{" + ",".join(sorted({str(v) for v in values})) + "}"
    chosen = ["X"] if family == "totals" and flows is None else flows
    front = "" if reporters is None else "{,slice=}"  # written by this module, or under the plain name
    return f"{folder}/{front}{any_of(reporters)}_{any_of(chosen)}_{any_of(years)}_hs*_p{PARTNERS[family]}.parquet"


def read_slices(
    spark: SparkSession, folder: str, family: str, reporters: Iterable[str | int] | None = None, flows: Iterable[str] | None = None,
    years: Iterable[int] | None = None,
) -> DataFrame:
    """The slices of a family as one table, columns merged by name; an empty table where there is none.

    ``reporters``, ``flows`` and ``years`` choose slices by name, before any file is opened.
    """
    wanted = slice_paths(folder, family, *(None if x is None else list(x) for x in (reporters, flows, years)))
    pattern = spark._jvm.org.apache.hadoop.fs.Path(wanted)
    if not pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern):
        return spark.createDataFrame([], EMPTY[family])
    return spark.read.option("mergeSchema", True).parquet(wanted)


def with_slice_keys(df: DataFrame) -> DataFrame:
    """Add reporter, flow, year, level and partner parsed from the path of each row's file."""
    path = F.col("_metadata.file_path")
    part = lambda k: F.regexp_extract(path, NAME, k)
    return df.select(
        "*", part(1).alias("slice_reporter"), part(2).alias("slice_flow"), part(3).cast("int").alias("slice_year"),
        part(4).cast("int").alias("slice_level"), part(5).alias("slice_partner"),
    )


def requested_slices(reporters: DataFrame, flows: Iterable[str], years: tuple[int, int]) -> DataFrame:
    """(reporter, flow, year) for every reporter, flow and year of the range."""
    return (
        reporters.select("reporter").distinct()
        .withColumn("flow", F.explode(F.lit(list(flows))))
        .withColumn("year", F.explode(F.sequence(F.lit(years[0]), F.lit(years[1]))))
    )


def missing_slices(requested: DataFrame, loaded: DataFrame, available: DataFrame | None = None) -> DataFrame:
    """Requested slices that are available upstream and not loaded yet.

    ``available`` holds (reporter, year); a reporter without any entry is taken to have all years.
    """
    if available is not None:
        listed = available.select("reporter").distinct().withColumn("_listed", F.lit(True))
        years = available.select("reporter", "year").distinct().withColumn("_there", F.lit(True))
        requested = (
            requested.join(listed, "reporter", "left").join(years, ["reporter", "year"], "left")
            .where(F.col("_listed").isNull() | F.col("_there")).drop("_listed", "_there")
        )
    return requested.join(loaded, ["reporter", "flow", "year"], "left_anti").select("reporter", "flow", "year")
