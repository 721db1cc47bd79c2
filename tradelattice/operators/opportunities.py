"""Baselines, candidate links, ranked opportunities and their explanations."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tradelattice.functions import constants as K
from tradelattice.operators import blocks as B
from tradelattice.operators.ordering import top_k, top_k_per, top_k_ranked


def _by_score(score: str) -> list[Column]:
    return [F.desc_nulls_last(score), F.asc("hs4")]


def open_products(complexity: DataFrame) -> DataFrame:
    """Candidate country-product links: the cells without comparative advantage."""
    return complexity.where(F.col("mcp") == 0)


def density_baseline(complexity: DataFrame, country: str | None = None, k: int = 50) -> DataFrame:
    """Open products nearest to what a country has: (year, iso3, hs4, density, rank), all countries at once."""
    return _baseline(complexity, "density", "density", country, k)


def cog_baseline(complexity: DataFrame, country: str | None = None, k: int = 50) -> DataFrame:
    """Open products with the largest outlook gain: (year, iso3, hs4, cog_score, rank)."""
    return _baseline(complexity, "cog", "cog_score", country, k)


def _baseline(complexity: DataFrame, score: str, name: str, country: str | None, k: int) -> DataFrame:
    df = open_products(complexity)
    if country is not None:
        df = df.where(F.col("iso3") == country)
    df = df.select("year", "iso3", "hs4", F.col(score).alias(name))
    return top_k_per(df, ["year", "iso3"], _by_score(name), k)


def missing_links(sources: DataFrame, targets: DataFrame, existing: DataFrame, src: str, dst: str) -> DataFrame:
    """(src, dst) pairs of two node lists that are not linked yet."""
    packs = B.blocks_for(B.axis_sizes(targets, n=dst)["n"])
    pairs = B.grid(sources, targets, [], src, dst, packs).select(F.col(src).alias("src"), F.col(dst).alias("dst"))
    return pairs.join(existing.select("src", "dst"), ["src", "dst"], "left_anti")


def rank_products(
    complexity: DataFrame, names: DataFrame, country: str = K.FOCUS_COUNTRY, year: int | None = None,
    scores: DataFrame | None = None, k: int = 50,
) -> DataFrame:
    """New products for a country: hs4, product_name, score, rank, density, pci.

    ``scores`` (hs4, score) comes from any model; density is the default score.
    """
    df = open_products(complexity).where(F.col("iso3") == country)
    if year is not None:
        df = df.where(F.col("year") == year)
    df = df.select("hs4", "density", "pci")
    df = df.withColumn("score", F.col("density")) if scores is None else df.join(scores.select("hs4", "score"), "hs4", "left")
    top = top_k_ranked(df, _by_score("score"), k)
    return top.join(names.select("hs4", "product_name"), "hs4", "left").select(
        "hs4", "product_name", "score", "rank", "density", "pci"
    )


def market_candidates(complexity: DataFrame, flows: DataFrame, partners: DataFrame, country: str, year: int) -> DataFrame:
    """(hs4, partner_iso3) pairs a country does not serve yet, for the products it exports with advantage."""
    products = complexity.where(
        (F.col("mcp") == 1) & (F.col("iso3") == country) & (F.col("year") == year)
    ).select("hs4").distinct()
    others = partners.where(F.col("iso3") != country).select(F.col("iso3").alias("partner_iso3"))
    served = flows.where(
        (F.col("flow") == "X") & (F.col("year") == year) & (F.col("reporter_iso3") == country) & (F.col("value") > 0)
    ).select(F.col("hs4").alias("src"), F.col("partner_iso3").alias("dst")).distinct()
    return missing_links(products, others, served, "hs4", "partner_iso3").select(
        F.col("src").alias("hs4"), F.col("dst").alias("partner_iso3")
    )


def demand_scores(flows: DataFrame, year: int, country: str) -> DataFrame:
    """Default market score: log of what a partner imports of a product from others: (hs4, partner_iso3, score)."""
    bought = flows.where(
        (F.col("flow") == "M") & (F.col("year") == year) & (F.col("partner_iso3") != country)
    )
    return bought.groupBy("hs4", F.col("reporter_iso3").alias("partner_iso3")).agg(F.log1p(F.sum("value")).alias("score"))


def rank_markets(
    complexity: DataFrame, flows: DataFrame, partners: DataFrame, names: DataFrame, country: str = K.FOCUS_COUNTRY,
    year: int = 0, scores: DataFrame | None = None, gravity: DataFrame | None = None, k: int = 50, gravity_year: int | None = None,
) -> DataFrame:
    """New markets for what a country exports: hs4, product_name, partner_iso3, partner_name, score, rank, gravity_pred.

    ``partners`` has iso3 and country_name; ``gravity`` has reporter_iso3, partner_iso3, hs4, year, predicted_value, of which
    those of ``gravity_year`` are shown, by default of ``year``.
    """
    candidates = market_candidates(complexity, flows, partners, country, year)
    scores = demand_scores(flows, year, country) if scores is None else scores
    df = candidates.join(scores.select("hs4", "partner_iso3", "score"), ["hs4", "partner_iso3"], "left")
    df = df.withColumn("score", F.coalesce("score", F.lit(0.0)))
    order = [F.desc("score"), F.asc("hs4"), F.asc("partner_iso3")]
    top = top_k_ranked(df, order, k)
    if gravity is None:
        top = top.withColumn("gravity_pred", F.lit(None).cast("double"))
    else:
        shown = year if gravity_year is None else gravity_year
        own = gravity.where((F.col("reporter_iso3") == country) & (F.col("year") == shown)).select(
            "hs4", "partner_iso3", F.col("predicted_value").alias("gravity_pred")
        )
        top = top.join(own, ["hs4", "partner_iso3"], "left")
    partner_names = partners.select(F.col("iso3").alias("partner_iso3"), F.col("country_name").alias("partner_name"))
    return (
        top.join(names.select("hs4", "product_name"), "hs4", "left").join(partner_names, "partner_iso3", "left")
        .select("hs4", "product_name", "partner_iso3", "partner_name", "score", "rank", "gravity_pred")
    )


def explain_density(presence: DataFrame, phi: DataFrame, links: DataFrame) -> DataFrame:
    """Exact parts of the density of given links (year, iso3, hs4): one row per product j behind it.

    (year, iso3, hs4, because_hs4, contribution); contributions of a link add up to its density.
    """
    sums = phi.groupBy("year", F.col("hs4_i").alias("hs4")).agg(F.sum("proximity").alias("_s"))
    near = phi.select("year", F.col("hs4_i").alias("hs4"), F.col("hs4_j").alias("because_hs4"), "proximity")
    held = presence.select("year", "iso3", F.col("hs4").alias("because_hs4"))
    # A link first meets what its country has, then the proximities of just those pairs.
    return (
        links.select("year", "iso3", "hs4").join(held, ["year", "iso3"])
        .join(near, ["year", "hs4", "because_hs4"]).join(sums, ["year", "hs4"])
        .select("year", "iso3", "hs4", "because_hs4", (F.col("proximity") / F.col("_s")).alias("contribution"))
    )


def explain_linear(pairs: DataFrame, features: str, coefficients: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Coefficient times feature of a linear decoder: (src, dst, feature, contribution)."""
    parts = F.zip_with(F.col(features), F.lit([float(c) for c in coefficients]), lambda x, w: x * w)
    labelled = F.arrays_zip(F.lit(list(names)).alias("feature"), parts.alias("contribution"))
    return pairs.select("src", "dst", F.inline(labelled))


def product_space(phi: DataFrame, products: DataFrame, highlight: Iterable[str] = ()) -> DataFrame:
    """Proximity edges with the section of both ends and a highlight flag."""
    end = lambda side: products.select(F.col("hs4").alias(f"hs4_{side}"), F.col("section").alias(f"section_{side}"))
    marked = list(highlight)
    return (
        phi.where("hs4_i < hs4_j").join(end("i"), "hs4_i", "left").join(end("j"), "hs4_j", "left")
        .withColumn("highlight", F.col("hs4_i").isin(marked) | F.col("hs4_j").isin(marked))
    )


def top_opportunities(opportunities: DataFrame, k: int = 20) -> DataFrame:
    """First rows of a scored opportunity list."""
    return top_k(opportunities, [F.desc_nulls_last("score"), F.asc("hs4")], k)
