"""Economic-complexity metrics: comparative advantage, proximity, density, complexity and outlook indices.

X is the export value of a country c in a product p; every formula is per year, and ``year`` is a key
of every grouping and join, so all years run in one plan. Definitions follow the published literature
(Balassa 1965; Hidalgo et al. 2007; Hidalgo and Hausmann 2009; Hausmann et al. 2014).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradelattice.operators import blocks as B
from tradelattice.operators.profiles import one_per_key
from tradelattice.operators.spectral import second_vectors
from tradelattice.session import stage


# --- comparative advantage -----------------------------------------------------------------------


def trade_cells(trade: DataFrame, year: int | None = None) -> DataFrame:
    """One row per (year, iso3, hs4): duplicates summed, missing values zero."""
    df = trade.select("year", "iso3", "hs4", "export_value")
    if year is not None:
        df = df.where(F.col("year") == year)
    return df.groupBy("year", "iso3", "hs4").agg(
        F.sum(F.coalesce(F.col("export_value"), F.lit(0.0))).alias("export_value")
    )


def full_grid(cells: DataFrame, packs: int | None = None) -> DataFrame:
    """Every observed country with every observed product of its year; absent cells are zero."""
    if packs is None:
        packs = B.blocks_for(B.axis_sizes(cells, products="hs4")["products"])
    products = cells.select("year", "hs4").distinct()
    every = B.grid(cells, products, ["year"], "iso3", "hs4", packs)
    return every.join(cells, ["year", "iso3", "hs4"], "left").withColumn(
        "export_value", F.coalesce("export_value", F.lit(0.0))
    )


def rca(cells: DataFrame) -> DataFrame:
    """Revealed comparative advantage (X_cp / X_c) / (X_p / X); null where a total is zero.

    Totals are three grouped sums joined back. The yearly total is a window over country totals (one row
    per country), never over the cells.
    """
    by_country = cells.groupBy("year", "iso3").agg(F.sum("export_value").alias("_c"))
    by_country = by_country.withColumn("_y", F.sum("_c").over(Window.partitionBy("year")))
    by_product = cells.groupBy("year", "hs4").agg(F.sum("export_value").alias("_p"))
    share = F.try_divide(F.col("export_value"), F.col("_c"))
    world = F.try_divide(F.col("_p"), F.col("_y"))
    return (
        cells.join(by_country, ["year", "iso3"]).join(by_product, ["year", "hs4"])
        .select("year", "iso3", "hs4", "export_value", F.try_divide(share, world).alias("rca"))
    )


def mcp(rca_table: DataFrame, threshold: float = 1.0) -> DataFrame:
    """1 where the advantage reaches the threshold, 0 below, null where it is undefined."""
    return rca_table.withColumn("mcp", (F.col("rca") >= threshold).cast("int"))


def presence(mcp_table: DataFrame) -> DataFrame:
    """The (year, iso3, hs4) cells with ``mcp = 1``."""
    return mcp_table.where(F.col("mcp") == 1).select("year", "iso3", "hs4")


def diversity(m: DataFrame) -> DataFrame:
    return m.groupBy("year", "iso3").agg(F.count(F.lit(1)).alias("diversity"))


def ubiquity(m: DataFrame) -> DataFrame:
    return m.groupBy("year", "hs4").agg(F.count(F.lit(1)).alias("ubiquity"))


# --- proximity and density -----------------------------------------------------------------------


@dataclass(frozen=True)
class Axes:
    """Block counts of the country and the product axis of a presence table."""

    countries: int
    products: int
    country_blocks: int
    product_blocks: int

    @staticmethod
    def of(m: DataFrame) -> "Axes":
        n = B.axis_sizes(m, countries="iso3", products="hs4")
        return Axes(n["countries"], n["products"], B.blocks_for(n["countries"]), B.blocks_for(n["products"]))


def co_presence(m: DataFrame, axes: Axes) -> DataFrame:
    """Countries sharing two products: (year, hs4_i, hs4_j, n), both directions, i = j included."""
    one = m.withColumn("one", F.lit(1.0))
    return B.block_product(
        one.withColumnRenamed("hs4", "hs4_i"), one.withColumnRenamed("hs4", "hs4_j"),
        keys=["year"], row="hs4_i", inner="iso3", column="hs4_j", value="one", outputs={"n": "one"},
        blocks=(axes.product_blocks, axes.country_blocks, axes.product_blocks),
    )


def proximity(m: DataFrame, axes: Axes | None = None) -> DataFrame:
    """phi_ij = co-presence / max(ubiquity_i, ubiquity_j): (year, hs4_i, hs4_j, proximity), i != j, both directions."""
    n = co_presence(m, axes or Axes.of(m)).where("hs4_i <> hs4_j")
    k = ubiquity(m)
    return (
        n.join(k.select("year", F.col("hs4").alias("hs4_i"), F.col("ubiquity").alias("_i")), ["year", "hs4_i"])
        .join(k.select("year", F.col("hs4").alias("hs4_j"), F.col("ubiquity").alias("_j")), ["year", "hs4_j"])
        .select("year", "hs4_i", "hs4_j", (F.col("n") / F.greatest("_i", "_j")).alias("proximity"))
    )


def proximity_sums(phi: DataFrame) -> DataFrame:
    """Total proximity of every product to the others: (year, hs4, phi_sum)."""
    return phi.groupBy("year", F.col("hs4_j").alias("hs4")).agg(F.sum("proximity").alias("phi_sum"))


def nearness(m: DataFrame, phi: DataFrame, axes: Axes, products: DataFrame | None = None) -> DataFrame:
    """Sums over the products j a country has: ``near`` of phi_jp and ``held`` of phi_jp PCI_j / phi_sum_j.

    ``held`` needs ``products`` (year, hs4, pci, phi_sum).
    """
    weights = phi.select("year", F.col("hs4_i").alias("j"), F.col("hs4_j").alias("hs4"), "proximity")
    outputs = {"near": "proximity"}
    if products is not None:
        scale = products.select("year", F.col("hs4").alias("j"), F.try_divide("pci", "phi_sum").alias("_s"))
        weights = weights.join(scale, ["year", "j"], "left").withColumn(
            "gain", F.coalesce(F.col("proximity") * F.col("_s"), F.lit(0.0))
        )
        outputs["held"] = "gain"
    return B.block_product(
        m.select("year", "iso3", F.col("hs4").alias("j"), F.lit(1.0).alias("one")), weights,
        keys=["year"], row="iso3", inner="j", column="hs4", value="one", outputs=outputs,
        blocks=(axes.country_blocks, axes.product_blocks, axes.product_blocks),
    )


def _density(near: Column, phi_sum: Column, here: Column, include_self: bool) -> Column:
    own = F.when(here == 1, 1.0).otherwise(0.0) if include_self else F.lit(0.0)
    extra = F.lit(1.0 if include_self else 0.0)
    return F.try_divide(F.coalesce(near, F.lit(0.0)) + own, phi_sum + extra)


def density(
    table: DataFrame, phi: DataFrame, axes: Axes | None = None, include_self: bool = False
) -> DataFrame:
    """omega_cp = sum_{j != p} M_cj phi_jp / sum_{j != p} phi_jp for every cell of ``table`` (with ``mcp``).

    Null for products without any proximity.
    """
    m = presence(table)
    near = nearness(m, phi, axes or Axes.of(m))
    return (
        table.join(near, ["year", "iso3", "hs4"], "left").join(proximity_sums(phi), ["year", "hs4"], "left")
        .withColumn("density", _density(F.col("near"), F.col("phi_sum"), F.col("mcp"), include_self))
        .drop("near", "phi_sum")
    )


# --- complexity indices --------------------------------------------------------------------------


def country_similarity(m: DataFrame, axes: Axes) -> DataFrame:
    """sum_p M_cp M_dp / k_p per pair of countries: (year, c, d, a), c = d included."""
    weighted = m.join(ubiquity(m), ["year", "hs4"]).withColumn("w", 1.0 / F.col("ubiquity"))
    return B.block_product(
        m.select("year", F.col("iso3").alias("c"), "hs4", F.lit(1.0).alias("one")),
        weighted.withColumnRenamed("iso3", "d"),
        keys=["year"], row="c", inner="hs4", column="d", value="one", outputs={"a": "w"},
        blocks=(axes.country_blocks, axes.product_blocks, axes.country_blocks),
    )


def eci(m: DataFrame, axes: Axes | None = None) -> DataFrame:
    """Economic complexity index per country: (year, iso3, eci_raw, eci, diversity).

    The second eigenvector of W = (1/k_c) sum_p M_cp M_dp / k_p, oriented to correlate with diversity and standardised over
    the countries. The sums over products give one number per pair of countries; the vector is found from these pairs by
    :func:`second_vectors`, whatever their number. A year of one country has no second vector, and nulls.
    """
    return oriented(second_vectors(country_similarity(m, axes or Axes.of(m)), diversity(m)))


LEVEL = 1e-9


def oriented(vectors: DataFrame) -> DataFrame:
    """Sign and scale of vectors (year, iso3, x, diversity): (year, iso3, eci_raw, eci, diversity).

    The vector correlates with diversity. Where the correlation is nil, the first country by code of those with at least half
    the largest entry is positive.
    """
    stats = vectors.groupBy("year").agg(
        F.covar_pop("x", "diversity").alias("_lean"), F.stddev_pop("diversity").alias("_k"), F.avg("x").alias("_m"),
        F.stddev_pop("x").alias("_s"), F.max(F.abs("x")).alias("_top"),
    )
    known = vectors.join(stats, "year")
    first = known.where(F.abs("x") >= F.col("_top") / 2).groupBy("year").agg(F.min(F.struct("iso3", "x"))["x"].alias("_first"))
    leans = F.abs("_lean") > LEVEL * F.col("_k") * F.col("_s")
    sign = F.signum(F.when(leans, F.col("_lean")).otherwise(F.col("_first")))
    return known.join(first, "year", "left").select(
        "year", "iso3", (F.col("x") * sign).alias("eci_raw"), (F.try_divide(F.col("x") - F.col("_m"), F.col("_s")) * sign).alias("eci"), "diversity",
    )


def pci(m: DataFrame, country_score: DataFrame, score: str = "eci_raw") -> DataFrame:
    """Product complexity: mean score of the countries with the product, standardised over products.

    (year, hs4, pci, ubiquity).
    """
    q = (
        m.join(country_score.select("year", "iso3", score), ["year", "iso3"])
        .groupBy("year", "hs4").agg(F.avg(score).alias("q"), F.count(F.lit(1)).alias("ubiquity"))
    )
    spread = q.groupBy("year").agg(F.avg("q").alias("_m"), F.stddev_pop("q").alias("_s"))
    return q.join(spread, "year").select(
        "year", "hs4", F.try_divide(F.col("q") - F.col("_m"), F.col("_s")).alias("pci"), "ubiquity"
    )


def reflections(m: DataFrame, levels: int = 2) -> DataFrame:
    """Method of reflections: country averages after ``levels`` steps from diversity and ubiquity.

    (year, iso3, k). Even levels are averages of countries, odd ones of products.
    """
    country = diversity(m).select("year", "iso3", F.col("diversity").cast("double").alias("k"))
    product = ubiquity(m).select("year", "hs4", F.col("ubiquity").cast("double").alias("k"))
    for _ in range(levels):
        country, product = (
            m.join(product, ["year", "hs4"]).groupBy("year", "iso3").agg(F.avg("k").alias("k")),
            m.join(country, ["year", "iso3"]).groupBy("year", "hs4").agg(F.avg("k").alias("k")),
        )
    return country


# --- outlook -------------------------------------------------------------------------------------


def coi(table: DataFrame) -> DataFrame:
    """Complexity outlook per country: sum of density x PCI over the products it lacks: (year, iso3, coi)."""
    return table.groupBy("year", "iso3").agg(F.coalesce(F.sum(_open_gain()), F.lit(0.0)).alias("coi"))


def _open_gain() -> Column:
    return F.when(F.col("mcp") == 0, F.col("density") * F.col("pci"))


def outlook_gain(table: DataFrame, phi: DataFrame, axes: Axes | None = None) -> DataFrame:
    """``table`` (year, iso3, hs4, mcp, density, pci) with ``cog``.

    cog_cp = sum over open p' != p of phi_pp' / phi_sum_p' PCI_p' - density_cp PCI_p; null where the country
    has p. The sum over open products is the sum over all minus the sum over those the country has, so
    only the sparse part is multiplied.
    """
    m = presence(table)
    products = one_per_key(table, ["year", "hs4"], ["pci"]).join(proximity_sums(phi), ["year", "hs4"], "left")
    held = nearness(m, phi, axes or Axes.of(m), products).select("year", "iso3", "hs4", "held")
    return _with_cog(
        table.join(held, ["year", "iso3", "hs4"], "left").join(_reach(phi, products), ["year", "hs4"], "left")
    )


def _reach(phi: DataFrame, products: DataFrame) -> DataFrame:
    """sum over all p' of phi_pp' PCI_p' / phi_sum_p': (year, hs4, reach)."""
    scale = products.select("year", F.col("hs4").alias("hs4_j"), F.try_divide("pci", "phi_sum").alias("_s"))
    return (
        phi.join(scale, ["year", "hs4_j"], "left").groupBy("year", F.col("hs4_i").alias("hs4"))
        .agg(F.sum(F.col("proximity") * F.col("_s")).alias("reach"))
    )


def _with_cog(df: DataFrame) -> DataFrame:
    gained = F.coalesce(F.col("reach"), F.lit(0.0)) - F.coalesce(F.col("held"), F.lit(0.0))
    return df.withColumn(
        "cog", F.when(F.col("mcp") == 0, gained - F.col("density") * F.col("pci"))
    ).drop("reach", "held")


# --- the whole table -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Complexity:
    """The metrics of one trade table; ``table`` has one row per cell of the yearly grids."""

    table: DataFrame
    proximity: DataFrame
    presence: DataFrame
    axes: Axes


def compute_complexity(
    trade: DataFrame, year: int | None = None, threshold: float = 1.0, include_self: bool = False,
    country_score: Callable[[DataFrame], DataFrame] | None = None, score: str = "eci_raw",
) -> Complexity:
    """All metrics: year, iso3, hs4, export_value, rca, mcp, eci, pci, density, coi, cog, diversity, ubiquity.

    The cells, the advantage grid, the proximities and the country and product scores are written once to
    the shared folder, because several branches read them. ``table`` itself is lazy. ``country_score`` maps the presence table
    to a column ``score`` per country, which stands behind ``eci`` and ``pci`` in place of the eigenvector.
    """
    cells = stage(trade_cells(trade, year), "cells")
    axes = Axes.of(cells)
    base = stage(mcp(rca(full_grid(cells, axes.product_blocks)), threshold), "advantage")
    m = presence(base)
    phi = stage(proximity(m, axes), "proximity")
    if country_score is None:
        countries = stage(eci(m, axes), "eci")
    else:
        given = stage(country_score(m), "country-scores")
        countries = oriented(given.join(diversity(m), ["year", "iso3"]).withColumn("x", F.col(score).cast("double")))
    scored = pci(m, countries if country_score is None else given, score)
    products = stage(scored.join(proximity_sums(phi), ["year", "hs4"], "left"), "products")
    table = (
        base.join(nearness(m, phi, axes, products), ["year", "iso3", "hs4"], "left")
        .join(products, ["year", "hs4"], "left").join(_reach(phi, products), ["year", "hs4"], "left")
        .join(countries.select("year", "iso3", "eci", "diversity"), ["year", "iso3"], "left")
        .withColumn("density", _density(F.col("near"), F.col("phi_sum"), F.col("mcp"), include_self))
        .withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in ("diversity", "ubiquity")})
    )
    # A window over the products of one country and year stands in for a grouped sum joined back.
    outlook = F.sum(_open_gain()).over(Window.partitionBy("year", "iso3"))
    table = _with_cog(table).withColumn("coi", F.coalesce(outlook, F.lit(0.0))).select(
        "year", "iso3", "hs4", "export_value", "rca", "mcp", "eci", "pci", "density", "coi", "cog",
        "diversity", "ubiquity",
    )
    return Complexity(table, phi, m, axes)


def country_complexity(table: DataFrame) -> DataFrame:
    return one_per_key(table, ["year", "iso3"], ["eci", "diversity"])


def product_complexity(table: DataFrame) -> DataFrame:
    return one_per_key(table, ["year", "hs4"], ["pci", "ubiquity"])


def density_table(table: DataFrame) -> DataFrame:
    return table.select("year", "iso3", "hs4", "density")
