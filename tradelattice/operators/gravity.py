"""Gravity equation of bilateral trade by Poisson pseudo-maximum likelihood."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tradelattice.session import stage

# Covariates taken in logs, and taken as they are.
LOGGED = ["dist", "gdp_o", "gdp_d", "pop_o", "pop_d"]
PLAIN = ["contig", "comlang_off", "comcol", "colony", "fta_wto"]
MOST_STEPS, TOLERANCE, LEAST_VARIANCE = 100, 1e-10, 1e-9


def pair_totals(flows: DataFrame) -> DataFrame:
    """Reported exports per origin, destination and year."""
    return flows.where(F.col("flow") == "X").groupBy(
        F.col("reporter_iso3").alias("iso3_o"), F.col("partner_iso3").alias("iso3_d"), "year"
    ).agg(F.sum("value").alias("value"))


def attach_covariates(flows: DataFrame, gravity: DataFrame) -> DataFrame:
    """Flows with the covariates of their (origin, destination, year); flows without any keep nulls."""
    keys = ["reporter_iso3", "partner_iso3", "year"]
    named = gravity.withColumnsRenamed({"iso3_o": "reporter_iso3", "iso3_d": "partner_iso3"})
    return flows.join(named, keys, "left")


def covariates(
    gravity: DataFrame, years: Sequence[int], logged: Sequence[str] = LOGGED, plain: Sequence[str] = PLAIN
) -> DataFrame:
    """Covariates of every pair and year: logs as ``ln_*``, null where a covariate is missing or has no log."""
    return gravity.where(F.col("year").isin(list(years)) & (F.col("iso3_o") != F.col("iso3_d"))).select(
        "iso3_o", "iso3_d", "year", *[F.when(F.col(c) > 0, F.log(c)).alias(f"ln_{c}") for c in logged],
        *[F.col(c).cast("double").alias(c) for c in plain],
    )


def design(
    gravity: DataFrame, years: Sequence[int], logged: Sequence[str] = LOGGED, plain: Sequence[str] = PLAIN
) -> DataFrame:
    """Rows to fit on: those with all covariates."""
    return covariates(gravity, years, logged, plain).dropna(subset=[*[f"ln_{c}" for c in logged], *plain])


def training_rows(
    flows: DataFrame, gravity: DataFrame, years: Sequence[int], logged: Sequence[str] = LOGGED, plain: Sequence[str] = PLAIN
) -> DataFrame:
    """Every pair and year with covariates, its flow or zero."""
    rows = design(gravity, years, logged, plain).join(pair_totals(flows), ["iso3_o", "iso3_d", "year"], "left")
    return rows.withColumn("value", F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0)))


def fit_gravity(
    flows: DataFrame, gravity: DataFrame, train_years: Sequence[int], logged: Sequence[str] = LOGGED,
    plain: Sequence[str] = PLAIN,
) -> dict[str, float]:
    """Coefficients by name, ``intercept`` included.

    Poisson pseudo-maximum likelihood by iteratively reweighted least squares: every step is one aggregate of the weighted
    products of the covariates, of which a few dozen sums reach the driver. Flows are fitted in units of their mean.
    A covariate that does not vary, or that those before it add up to, has coefficient 0. Raises where no finite maximum
    exists (all flows zero where a flag is on, or off) and where the score equations are not met after ``MOST_STEPS`` steps.
    """
    names = [*[f"ln_{c}" for c in logged], *plain]
    rows = stage(training_rows(flows, gravity, train_years, logged, plain), "gravity-training")
    unit = rows.agg(F.avg("value")).first()[0]
    if not unit:
        raise ValueError(f"no positive flows with covariates in {list(train_years)}")
    # Centred and scaled covariates keep the normal equations well conditioned.
    moments = rows.agg(*[f(n).alias(f"{f.__name__}_{n}") for n in names for f in (F.avg, F.stddev_pop)]).first()
    centre, spread = {n: moments[f"avg_{n}"] for n in names}, {n: moments[f"stddev_pop_{n}"] for n in names}
    varied = [n for n in names if spread[n]]
    _require_overlap(rows, [c for c in plain if c in varied])
    varied = _independent(rows, {n: (F.col(n) - centre[n]) / spread[n] for n in varied})
    columns = [F.lit(1.0), *[(F.col(n) - centre[n]) / spread[n] for n in varied]]
    ready = stage(rows.select((F.col("value") / unit).alias("y"), *[x.cast("double").alias(f"x{k}") for k, x in enumerate(columns)]), "gravity-design")
    beta = _poisson(ready, len(columns))
    slopes = {n: 0.0 for n in names} | {n: float(b / spread[n]) for n, b in zip(varied, beta[1:])}
    return {"intercept": float(beta[0] - sum(slopes[n] * centre[n] for n in varied) + math.log(unit)), **slopes}


def _independent(rows: DataFrame, columns: dict[str, Column]) -> list[str]:
    """The standardised columns that are not sums of multiples of those before them, by their correlations."""
    names = list(columns)
    places = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    found = rows.agg(*[F.avg(columns[names[i]] * columns[names[j]]) for i, j in places]).first() if places else []
    full = np.zeros((len(names), len(names)))
    for value, (i, j) in zip(found, places):
        full[i, j] = full[j, i] = value
    kept: list[int] = []
    for k in range(len(names)):
        own = full[np.ix_(kept, kept)]
        if full[k, k] - full[k, kept] @ np.linalg.solve(own, full[kept, k]) > LEAST_VARIANCE:
            kept.append(k)
    return [names[k] for k in kept]


def _require_overlap(rows: DataFrame, plain: Sequence[str]) -> None:
    """Every flag needs positive flows on both of its sides, else its coefficient runs off without end."""
    if not plain:
        return
    sold = lambda c, on: F.max(F.when((F.col(c) != 0) == F.lit(on), F.col("value")))
    found = rows.agg(*[F.struct(sold(c, True).alias("on"), sold(c, False).alias("off")).alias(c) for c in plain]).first()
    lost = [c for c in plain if found[c]["on"] == 0 or found[c]["off"] == 0]
    if lost:
        raise ValueError(f"no positive flows on one side of {lost}")


def _poisson(ready: DataFrame, width: int) -> np.ndarray:
    """Coefficients of log E(y) = sum of b_k x_k; ``x0`` is 1."""
    places = [(i, j) for i in range(width) for j in range(i, width)]
    beta, before = np.zeros(width), math.inf
    beta[0] = math.log(ready.agg(F.avg("y")).first()[0])
    for _ in range(MOST_STEPS):
        eta = " + ".join(f"({b!r}D) * x{k}" for k, b in enumerate(beta.tolist()))
        row = ready.withColumn("mu", F.expr(f"exp({eta})")).agg(
            *[F.expr(f"sum(mu * x{i} * x{j})") for i, j in places], *[F.expr(f"sum((y - mu) * x{k})") for k in range(width)],
            *[F.expr(f"sum(y * abs(x{k}))") for k in range(width)],
            F.expr("2 * sum(mu - y + CASE WHEN y > 0 THEN y * ln(y / mu) ELSE 0D END)"),
        ).first()
        *rest, deviance = row
        score, size = np.array(rest[len(places):len(places) + width]), np.array(rest[len(places) + width:])
        if (np.abs(score) <= TOLERANCE * np.maximum(size, 1e-300)).all():
            return beta
        if not deviance <= before * (1 + 1e-9):  # the step was too long
            step = step / 2
            beta = beta - step
            continue
        hessian = np.zeros((width, width))
        for k, (i, j) in enumerate(places):
            hessian[i, j] = hessian[j, i] = rest[k]
        step, before = np.linalg.solve(hessian, score), deviance
        beta = beta + step
    raise RuntimeError(f"the score equations are not met after {MOST_STEPS} steps")


def predict_pairs(
    coefficients: dict[str, float], gravity: DataFrame, years: Sequence[int], logged: Sequence[str] = LOGGED,
    plain: Sequence[str] = PLAIN,
) -> DataFrame:
    """Expected total flow per pair and year: (iso3_o, iso3_d, year, predicted_value).

    Every pair of the years comes back; the value is null where a covariate that has a coefficient is missing.
    """
    logged, plain = ([c for c in names if f"{mark}{c}" in coefficients] for names, mark in ((logged, "ln_"), (plain, "")))
    eta = F.lit(coefficients["intercept"])
    for name in [*[f"ln_{c}" for c in logged], *plain]:
        eta = eta + F.lit(coefficients[name]) * F.col(name)
    return covariates(gravity, years, logged, plain).select("iso3_o", "iso3_d", "year", F.exp(eta).alias("predicted_value"))


def product_shares(flows: DataFrame, year: int) -> DataFrame:
    """Share of every product in the exports of an origin in one year: (iso3_o, hs4, share)."""
    sold = flows.where((F.col("flow") == "X") & (F.col("year") == year))
    by_product = sold.groupBy(F.col("reporter_iso3").alias("iso3_o"), "hs4").agg(F.sum("value").alias("v"))
    total = by_product.groupBy("iso3_o").agg(F.sum("v").alias("t"))
    return by_product.join(total, "iso3_o").select("iso3_o", "hs4", F.try_divide("v", "t").alias("share"))


def predict_gravity(
    coefficients: dict[str, float], flows: DataFrame, gravity: DataFrame, test_years: Sequence[int], share_year: int,
    logged: Sequence[str] = LOGGED, plain: Sequence[str] = PLAIN,
) -> DataFrame:
    """Expected flows by product: the pair total split by the origin's product shares in the last training year.

    (reporter_iso3, partner_iso3, hs4, year, predicted_value).
    """
    pairs = predict_pairs(coefficients, gravity, test_years, logged, plain)
    return pairs.join(product_shares(flows, share_year), "iso3_o").select(
        F.col("iso3_o").alias("reporter_iso3"), F.col("iso3_d").alias("partner_iso3"), "hs4", "year",
        (F.col("predicted_value") * F.col("share")).alias("predicted_value"),
    )
