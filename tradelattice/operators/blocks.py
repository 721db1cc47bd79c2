"""Sparse matrix products and grids in bounded blocks.

Co-occurrence, density, outlook gain and common neighbours are all products of sparse matrices held as
``(key, row, column, value)`` rows. A self join would emit every pair inside each group (a country with
1,200 products alone gives 1.4 million rows); here both factors are cut into blocks of about ``WIDTH``
rows by ``WIDTH`` columns, every block pair is one bounded group multiplied with NumPy, and only the
cells of the result leave the task. An entry is copied once per block of the opposite axis, so the
shuffle is (entries x blocks) instead of (pairs).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

WIDTH = 512


def axis_sizes(df: DataFrame, **axes: str) -> dict[str, int]:
    """Approximate number of distinct ids per axis: one aggregate, one row to the driver."""
    row = df.agg(*[F.approx_count_distinct(c).alias(a) for a, c in axes.items()]).first()
    return {a: row[a] for a in axes}


def blocks_for(size: int, width: int = WIDTH) -> int:
    return max(1, -(-size // width))


def block_of(c: str, blocks: int) -> Column:
    return F.lit(0) if blocks == 1 else F.pmod(F.hash(F.col(c)), F.lit(blocks))


def every_block(blocks: int) -> Column:
    return F.lit(0) if blocks == 1 else F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


def block_product(
    left: DataFrame,
    right: DataFrame,
    *,
    keys: Sequence[str],
    row: str,
    inner: str,
    column: str,
    value: str,
    outputs: dict[str, str],
    blocks: tuple[int, int, int],
    mask: DataFrame | None = None,
) -> DataFrame:
    """``outputs[o] = sum over inner of left.value * right.<outputs[o]>`` per (keys, row, column).

    ``blocks`` gives the number of blocks of the row, inner and column axes. Cells whose products are all
    zero are absent from the result. ``mask`` (keys, row, column) keeps the given cells only and ships
    the factors only to the blocks the mask touches.
    """
    n_row, n_inner, n_col = blocks
    keys, names = list(keys), list(outputs)
    place = [*keys, "_r", "_i", "_c"]
    empty = [F.lit(None).cast("double").alias(f"_v{k}") for k in range(1, len(names))]

    lhs = left.select(*keys, F.col(row).alias("_a"), F.col(inner).alias("_b"), F.col(value).cast("double").alias("_v0"))
    lhs = lhs.withColumns({"_r": block_of("_a", n_row), "_i": block_of("_b", n_inner)})
    rhs = right.select(
        *keys, F.col(inner).alias("_a"), F.col(column).alias("_b"),
        *[F.col(c).cast("double").alias(f"_v{k}") for k, c in enumerate(outputs.values())],
    ).withColumns({"_i": block_of("_a", n_inner), "_c": block_of("_b", n_col)})

    if mask is None:
        lhs, rhs = lhs.withColumn("_c", every_block(n_col)), rhs.withColumn("_r", every_block(n_row))
        parts = []
    else:
        cells = mask.select(*keys, F.col(row).alias("_a"), F.col(column).alias("_b")).withColumns(
            {"_r": block_of("_a", n_row), "_c": block_of("_b", n_col)}
        )
        touched = cells.select(*keys, "_r", "_c").distinct()
        lhs, rhs = lhs.join(touched, [*keys, "_r"]), rhs.join(touched, [*keys, "_c"])
        parts = [
            cells.withColumn("_i", every_block(n_inner)).select(
                *place, F.lit(2).alias("_side"), "_a", "_b",
                *[F.lit(None).cast("double").alias(f"_v{k}") for k in range(len(names))],
            )
        ]
    tagged = lhs.select(*place, F.lit(0).alias("_side"), "_a", "_b", "_v0", *empty).unionByName(
        rhs.select(*place, F.lit(1).alias("_side"), "_a", "_b", *[f"_v{k}" for k in range(len(names))])
    )
    for part in parts:
        tagged = tagged.unionByName(part)

    types = {f.name: f.dataType for f in tagged.schema.fields}
    schema = T.StructType(
        [T.StructField(c, types[c]) for c in keys]
        + [T.StructField(row, types["_a"]), T.StructField(column, types["_b"])]
        + [T.StructField(n, T.DoubleType()) for n in names]
    )
    masked = mask is not None

    def multiply(group: pd.DataFrame) -> pd.DataFrame:
        side = group["_side"].to_numpy()
        a, b = group["_a"].to_numpy(), group["_b"].to_numpy()
        is_left, is_right = side == 0, side == 1
        rows, r = np.unique(a[is_left], return_inverse=True)
        cols, c = np.unique(b[is_right], return_inverse=True)
        inners, i = np.unique(np.concatenate([b[is_left], a[is_right]]), return_inverse=True)
        n_left = int(is_left.sum())
        lm = np.zeros((len(rows), len(inners)))
        np.add.at(lm, (r, i[:n_left]), group["_v0"].to_numpy()[is_left])
        results = []
        for k in range(len(names)):
            rm = np.zeros((len(inners), len(cols)))
            np.add.at(rm, (i[n_left:], c), group[f"_v{k}"].to_numpy()[is_right])
            results.append(lm @ rm)
        keep = np.zeros((len(rows), len(cols)), dtype=bool)
        for m in results:
            keep |= m != 0
        if masked:
            wanted = np.zeros_like(keep)
            if len(rows) and len(cols):
                ma, mb = a[side == 2], b[side == 2]
                mr, mc = np.searchsorted(rows, ma), np.searchsorted(cols, mb)
                mr, mc = np.minimum(mr, len(rows) - 1), np.minimum(mc, len(cols) - 1)
                hit = (rows[mr] == ma) & (cols[mc] == mb)
                wanted[mr[hit], mc[hit]] = True
            keep &= wanted
        at_row, at_col = np.nonzero(keep)
        out = {key: [group[key].iloc[0]] * len(at_row) for key in keys}
        out[row], out[column] = rows[at_row], cols[at_col]
        for n, m in zip(names, results):
            out[n] = m[at_row, at_col]
        return pd.DataFrame(out)

    cells = tagged.groupBy(*place).applyInPandas(multiply, schema)
    if n_inner == 1:
        return cells
    return cells.groupBy(*keys, row, column).agg(*[F.sum(n).alias(n) for n in names])


def grid(rows: DataFrame, columns: DataFrame, keys: Sequence[str], row: str, column: str, packs: int = 1) -> DataFrame:
    """Complete (row, column) grid per key, or of the two lists where there is no key.

    The columns are packed into ``packs`` arrays of bounded length; each row meets every pack of its key
    by an equi join on (key, pack) and unpacks it in place, so the grid itself is never shuffled.
    """
    pack = F.pmod(F.hash(F.col(column)), F.lit(packs))
    packed = columns.select(*keys, column, pack.alias("_pack")).groupBy(*keys, "_pack").agg(
        F.collect_set(column).alias("_ids")
    )
    asked = rows.select(*keys, row).distinct().withColumn("_pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
    return asked.join(packed, [*keys, "_pack"]).select(*keys, row, F.explode("_ids").alias(column))
