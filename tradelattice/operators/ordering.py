"""Top-k, ranks and running totals that never sort a whole table or a hot group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradelattice.session import stage

SLICE = "_slice"


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows; each task keeps ``k`` rows before the merge. ``order`` must be total."""
    return df.orderBy(*order).limit(k)


def top_k_ranked(df: DataFrame, order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows with their rank; only those ``k`` rows are numbered together."""
    return top_k(df, order, k).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def top_k_per(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows of every group with their rank.

    The rank filter is pushed below the exchange as a per-task group limit, so at most ``k`` rows of a
    group leave each task however large the group is.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def running_totals(
    df: DataFrame, order: Sequence[Column], totals: dict[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    """Inclusive running sums in a total order, over the table or per group, in parallel.

    Rows are range-partitioned on (group, order) and written once, so a group of any size spans as many
    slices as it needs. Each slice accumulates on its own and adds what earlier slices of its group held.
    """
    names = list(totals)
    keys = list(by)
    sliced = (
        df.withColumns(totals)
        .repartitionByRange(*[F.col(c) for c in keys], *order)
        .withColumn(SLICE, F.spark_partition_id())
    )
    sliced = stage(sliced, "slices")
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, SLICE)
        .agg(*[F.sum(n).alias(n) for n in names])
        .select(*keys, SLICE, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in names])
    )
    within = (
        Window.partitionBy(SLICE, *keys).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = sliced.withColumns({n: F.sum(n).over(within) for n in names})
    return (
        local.join(offsets, [SLICE, *keys])
        .withColumns({n: F.col(n) + F.col(f"_{n}") for n in names})
        .drop(SLICE, *[f"_{n}" for n in names])
    )


def ranked(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), rank: str = "rank") -> DataFrame:
    """Position of every row in a total order, over the table or per group."""
    return running_totals(df, order, {rank: F.lit(1).cast("bigint")}, by)
