"""Second eigenvector of the country similarity by Chebyshev-filtered block iteration, for any number of countries.

The similarity is a table of country pairs, written once. A block of vectors lives in rows (year, iso3). A round multiplies
the block by a Chebyshev polynomial of the similarity that is small on the eigenvalues below the block and grows fast above
them, so close leading eigenvalues cost few rounds; each degree is one join with the pairs and one grouped sum, and all years
go together. A Rayleigh-Ritz step then turns the block, from inner products of a few dozen numbers per year on the driver.
Rounds end on the true residual, summed row by row.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tradelattice.functions import scalars as S
from tradelattice.session import stage

# The known leading vector is kept out of the block by subtraction. Rounding lets about 1e-16 of it back in, which the filter
# makes larger than what is looked for; the degree stays so low that it does so by this factor at most.
MOST_LEAK = 1e12
LEAST_RANK = 1e-12
PAIRS_IN_A_TASK = 200_000
SETTLED = 1e-9


def _times(pairs: DataFrame, state: DataFrame, shown: str) -> DataFrame:
    """``shown`` of ``s``, the similarity times ``y``, and of the country's own ``scale``, ``p`` and ``y``; a row per vector ``j``.

    The pair of a country with itself brings its own row to the grouped sum.
    """
    return pairs.sparkSession.sql(f"""
        SELECT year, iso3, j, {shown} FROM (
            SELECT p.year, p.c AS iso3, v.j, max(v.scale) AS scale, sum(p.s * v.y) AS s,
                   sum(CASE WHEN p.c = p.d THEN v.p END) AS p, sum(CASE WHEN p.c = p.d THEN v.y END) AS y
            FROM {{pairs}} p JOIN {{state}} v ON p.year = v.year AND p.d = v.iso3 GROUP BY p.year, p.c, v.j)""", pairs=pairs, state=state)


def _turned(state: DataFrame, turns: DataFrame) -> DataFrame:
    """The block free of the leading vector and turned to its Ritz vectors ``x``, with the similarity times them, ``w``."""
    turned = lambda v: (
        f"transform(mix, m -> aggregate(zip_with(zip_with({v}, lead, (a, l) -> a - t * l), m, (a, b) -> a * b), 0D, (s, a) -> s + a))")
    return state.join(turns, "year").selectExpr("year", "iso3", "k", "t", "cut", "value", f"{turned('y')} AS x", f"{turned('z')} AS w")


def _filtered(pairs: DataFrame, ritz: DataFrame, degree: int) -> DataFrame:
    """The Chebyshev polynomial over (0, cut) of the similarity, times the block ``x``, as ``y``; and the similarity times that, ``z``."""
    rows = ritz.selectExpr("year", "iso3", "CASE WHEN cut > 0 THEN 2 / cut ELSE 0D END AS scale", "posexplode(arrays_zip(x, w)) AS (j, v)")
    state = rows.selectExpr("year", "iso3", "j", "scale", "v.x AS p", "scale * v.w - v.x AS y")
    for _ in range(degree - 1):
        state = _times(pairs, state, "scale, y AS p, 2 * (scale * s - y) - p AS y")
    return _with_product(pairs, state, ritz)


def _with_product(pairs: DataFrame, state: DataFrame, countries: DataFrame) -> DataFrame:
    """A row per country: ``y``, the vectors of ``state``, and ``z``, the similarity times them."""
    rows = _times(pairs, state, "y, s").groupBy("year", "iso3").agg(F.sort_array(F.collect_list(F.struct("j", "y", "s"))).alias("v"))
    return countries.select("year", "iso3", "k", "t").join(rows, ["year", "iso3"]).selectExpr("year", "iso3", "k", "t", "v.y AS y", "v.s AS z")


def _ritz(state: DataFrame, width: int) -> list[tuple]:
    """(year, mix, lead, cut, value) of every year: how the block turns into Ritz vectors, the largest first.

    ``lead`` is the block's share of the leading vector, ``value`` the largest Ritz value and ``cut`` the smallest. A year
    whose block is nothing but the leading vector has no second one, and a null value.
    """
    places = [(i, j) for i in range(width) for j in range(i, width)]
    sums = [F.expr(f"sum(y[{i}] * y[{j}])") for i, j in places] + [F.expr(f"sum(y[{i}] * z[{j}] + y[{j}] * z[{i}]) / 2") for i, j in places]
    sums += [F.expr(f"sum(t * y[{i}])") for i in range(width)]
    found = []
    for row in state.groupBy("year").agg(*sums).collect():
        gram, ritz = np.zeros((width, width)), np.zeros((width, width))
        for k, (i, j) in enumerate(places):
            gram[i, j] = gram[j, i] = row[1 + k]
            ritz[i, j] = ritz[j, i] = row[1 + len(places) + k]
        lead = np.array(row[1 + 2 * len(places):], float)
        size = np.diag(gram)
        gram, ritz = gram - np.outer(lead, lead), ritz - np.outer(lead, lead)
        here = np.diag(gram) > LEAST_RANK * size
        scale = np.where(here, 1 / np.sqrt(np.where(here, np.diag(gram), 1.0)), 0.0)
        lengths, axes = np.linalg.eigh(gram * np.outer(scale, scale))
        held = lengths > LEAST_RANK * max(lengths.max(), LEAST_RANK)
        basis = (scale[:, None] * axes[:, held]) / np.sqrt(lengths[held])
        values, turn = np.linalg.eigh(basis.T @ ritz @ basis)
        mix = np.zeros((width, width))
        mix[:len(values)] = (basis @ turn).T[::-1]
        ends = (float(max(values[0], 0.0)), float(values[-1])) if len(values) > 1 else (0.0, float(values[0]) if len(values) else None)
        found.append((int(row[0]), mix.tolist(), lead.tolist(), *ends))
    return found


def _degree(turns: list[tuple], most: int) -> int:
    """The highest degree up to ``most`` at which the leading vector leaks in no year."""
    def leak(degree: int, cut: float, value: float) -> float:
        grown = lambda x: math.acosh(max(2 * x / cut - 1, 1.0)) * degree
        return math.exp(min(grown(1.0) - grown(value), 700.0))

    years = [(cut, value) for *_, cut, value in turns if value and cut]
    return max((d for d in range(2, most + 1) if all(leak(d, *y) <= MOST_LEAK for y in years)), default=2)


def second_vectors(
    pairs: DataFrame, diversity: DataFrame, width: int = 12, degree: int = 8, tolerance: float = 1e-13, max_rounds: int = 100
) -> DataFrame:
    """(year, iso3, x, diversity): the eigenvector of (1/k_c) sum_p M_cp M_dp / k_p of the second-largest eigenvalue, sign free.

    ``pairs`` (year, c, d, a) has the sums over products, with c = d; ``diversity`` has k_c. ``x`` is null in a year of one
    country. Raises if the residual of a unit vector stays above ``tolerance`` in some year after ``max_rounds`` rounds.
    """
    spark = pairs.sparkSession
    k = diversity.select("year", "iso3", F.col("diversity").cast("double").alias("k"))
    total = k.groupBy("year").agg(F.sum("k").alias("_t"))
    # In symmetric form the leading vector is known: the square roots of the shares of the diversities.
    pairs = stage(
        pairs.join(k.select("year", F.col("iso3").alias("c"), F.col("k").alias("_c")), ["year", "c"])
        .join(k.select("year", F.col("iso3").alias("d"), F.col("k").alias("_d")), ["year", "d"])
        .select("year", "c", "d", (F.col("a") / F.sqrt(F.col("_c") * F.col("_d"))).alias("s")),
        "pairs",
    )
    one_task = (lambda df: df.coalesce(1)) if pairs.count() <= PAIRS_IN_A_TASK else (lambda df: df)  # needs no exchange
    pairs, k = one_task(pairs), one_task(k)
    countries = k.join(total, "year").select("year", "iso3", "k", F.sqrt(F.col("k") / F.col("_t")).alias("t"))
    drawn = S.hash32(["iso3", "j"], 42) / F.lit(float(2 ** 31)) - 1.0
    start = countries.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).select(
        "year", "iso3", "j", F.lit(0.0).alias("scale"), F.lit(0.0).alias("p"), drawn.alias("y"))
    state = stage(_with_product(pairs, start, countries), "vectors")
    turn_type = "year int, mix array<array<double>>, lead array<double>, cut double, value double"
    worst, before = math.inf, {}
    for _ in range(max_rounds):
        turns = _ritz(one_task(state), width)
        ritz = _turned(one_task(state), spark.createDataFrame(turns, turn_type))
        values = {year: value or 0.0 for year, *_, value in turns}
        # The value settles long before the vector does; until then the residual needs no pass over the rows.
        if all(abs(value - before.get(year, math.inf)) <= SETTLED for year, value in values.items()):
            gap = F.pow(F.col("w")[0] - F.col("value") * F.col("x")[0], 2)
            worst = math.sqrt(ritz.groupBy("year").agg(F.sum(gap).alias("gap")).agg(F.max("gap")).first()[0] or 0.0)
            if worst <= tolerance:
                x = F.when(F.col("value").isNotNull(), F.col("x")[0] / F.sqrt("k"))
                return ritz.select("year", "iso3", x.alias("x"), F.col("k").cast("bigint").alias("diversity"))
        before = values
        state = stage(_filtered(pairs, ritz, _degree(turns, degree)), "vectors")
    raise RuntimeError(f"residual {worst:.2e} after {max_rounds} rounds")
