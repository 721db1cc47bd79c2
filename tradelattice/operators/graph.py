"""Node and edge tables of the trade graph, integrity checks and feature assembly."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tradelattice.operators.cleaning import member_flags
from tradelattice.session import stage

EDGE = ["src_type", "src", "rel", "dst_type", "dst", "weight", "year"]
# Properties of edges; each relation fills its own, the others are null and take no room in the stored columns.
PROPERTIES = {
    "value": "double", "rca": "double", "export_value": "double", "import_value": "double", "hs_code": "string", "distance": "double",
    "contiguous": "boolean", "common_lang": "boolean", "fta": "boolean",
}


# --- nodes ---------------------------------------------------------------------------------------


def country_nodes(
    countries: DataFrame, indicators: DataFrame, complexity: DataFrame, sets: dict[str, Iterable[str]], year: int
) -> DataFrame:
    """iso3, name, region, gdp, gdp_pc, population, landlocked, eci and a flag per country set, of one year."""
    landlocked = F.col("landlocked") if "landlocked" in countries.columns else F.lit(None)
    base = countries.select(
        "iso3", F.col("country_name").alias("name"), "region", landlocked.cast("boolean").alias("landlocked")
    )
    economy = indicators.where(F.col("year") == year).select("iso3", "gdp", "gdp_pc", "population")
    scores = complexity.where(F.col("year") == year).select("iso3", "eci")
    nodes = base.join(economy, "iso3", "left").join(scores, "iso3", "left")
    return member_flags(nodes, sets).select(
        "iso3", "name", "region", "gdp", "gdp_pc", "population", "landlocked", "eci", *sets
    )


def with_section(products: DataFrame, sections: DataFrame) -> DataFrame:
    """Add the section code by the product's two-digit chapter; ``sections`` has code, name, hs2_from, hs2_to."""
    chapters = sections.select(
        F.col("code").alias("section"),
        F.explode(F.sequence(F.col("hs2_from").cast("int"), F.col("hs2_to").cast("int"))).alias("_chapter"),
    )
    return products.withColumn("_chapter", F.substring("hs4", 1, 2).cast("int")).join(
        chapters, "_chapter", "left"
    ).drop("_chapter")


def product_nodes(products: DataFrame, sections: DataFrame, complexity: DataFrame, year: int) -> DataFrame:
    """hs_code, hs_level, name, section, pci of one year; one row per product."""
    one = products.groupBy("hs4").agg(F.min("product_name").alias("name"))
    scores = complexity.where(F.col("year") == year).select("hs4", "pci")
    return with_section(one, sections).join(scores, "hs4", "left").select(
        F.col("hs4").alias("hs_code"), F.length("hs4").alias("hs_level"), "name", "section", "pci"
    )


def section_nodes(sections: DataFrame) -> DataFrame:
    return sections.groupBy("code").agg(F.min("name").alias("name"))


# --- edges ---------------------------------------------------------------------------------------


def export_edges(rca_table: DataFrame) -> DataFrame:
    return rca_table.where(F.col("export_value") > 0).select(
        F.col("iso3").alias("src"), F.col("hs4").alias("dst"), F.col("export_value").alias("value"), "rca", "year"
    )


def import_edges(trade: DataFrame | None = None, flows: DataFrame | None = None) -> DataFrame:
    """Imports of a country by product: reported with the exports where present, else summed over partners."""
    if trade is not None and "import_value" in trade.columns:
        table = trade.select("iso3", "hs4", "year", F.col("import_value").alias("v"))
    elif flows is not None:
        table = flows.where(F.col("flow") == "M").select(F.col("reporter_iso3").alias("iso3"), "hs4", "year", F.col("value").alias("v"))
    else:
        raise ValueError("no import values: give trade with import_value, or flows")
    total = table.groupBy("iso3", "hs4", "year").agg(F.sum("v").alias("value"))
    return total.where(F.col("value") > 0).select(F.col("iso3").alias("src"), F.col("hs4").alias("dst"), "value", "year")


def partner_edges(flows: DataFrame) -> DataFrame:
    """TRADES_WITH: what the source reports as exported to and imported from the partner, per year."""
    side = lambda f: F.sum(F.when(F.col("flow") == f, F.col("value")))
    return flows.groupBy(F.col("reporter_iso3").alias("src"), F.col("partner_iso3").alias("dst"), "year").agg(
        side("X").alias("export_value"), side("M").alias("import_value")
    )


def shipment_edges(flows: DataFrame) -> DataFrame:
    return flows.where(F.col("flow") == "X").groupBy(
        F.col("reporter_iso3").alias("src"), F.col("partner_iso3").alias("dst"), F.col("hs4").alias("hs_code"), "year"
    ).agg(F.sum("value").alias("value"))


def proximity_edges(phi: DataFrame, at_least: float = 0.0) -> DataFrame:
    return phi.where(F.col("proximity") >= at_least).select(
        F.col("hs4_i").alias("src"), F.col("hs4_j").alias("dst"), F.col("proximity").alias("weight"),
        *[c for c in ("year",) if c in phi.columns],
    )


def section_edges(product_node_table: DataFrame) -> DataFrame:
    return product_node_table.where(F.col("section").isNotNull()).select(
        F.col("hs_code").alias("src"), F.col("section").alias("dst")
    )


def neighbour_edges(gravity: DataFrame, year: int | None = None) -> DataFrame:
    """Country pairs with distance and flags, of one year, or of all with the year."""
    flag = lambda c: F.col(c).cast("boolean")
    rows = gravity if year is None else gravity.where(F.col("year") == year)
    return rows.select(
        F.col("iso3_o").alias("src"), F.col("iso3_d").alias("dst"), F.col("dist").alias("distance"),
        flag("contig").alias("contiguous"), flag("comlang_off").alias("common_lang"), flag("fta_wto").alias("fta"),
        *(["year"] if year is None else []),
    )


# --- integrity -----------------------------------------------------------------------------------


def duplicates(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def dangling(edges: DataFrame, end: str, nodes: DataFrame, key: str) -> DataFrame:
    """Edges whose endpoint is not a node."""
    return edges.join(nodes.select(F.col(key).alias(end)), end, "left_anti")


def require_unique(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    found = duplicates(nodes, keys).take(5)
    if found:
        raise ValueError(f"duplicate keys on {list(keys)}: {found}")
    return nodes


# --- graphs --------------------------------------------------------------------------------------


def bipartite(
    exports: DataFrame, country_attrs: DataFrame | None = None, product_attrs: DataFrame | None = None
) -> DataFrame:
    """Country-product edges (iso3, hs4, export_value, rca, year) with node attributes prefixed by their side."""
    edges = exports.where(F.col("export_value") > 0).select("iso3", "hs4", "export_value", "rca", "year")
    for attrs, key, prefix in ((country_attrs, "iso3", "country_"), (product_attrs, "hs4", "product_")):
        if attrs is not None:
            named = attrs.select(key, *[F.col(c).alias(prefix + c) for c in attrs.columns if c != key])
            edges = edges.join(named, key, "left")
    return edges


def _typed(df: DataFrame, rel: str, src_type: str, dst_type: str, weight: Column | None = None) -> DataFrame:
    none = F.lit(None)
    year = F.col("year") if "year" in df.columns else none
    return df.select(
        F.lit(src_type).alias("src_type"), F.col("src"), F.lit(rel).alias("rel"), F.lit(dst_type).alias("dst_type"),
        F.col("dst"), (none if weight is None else weight).cast("double").alias("weight"), year.cast("int").alias("year"),
        *[(F.col(c) if c in df.columns else none).cast(kind).alias(c) for c, kind in PROPERTIES.items()],
    )


def typed_edges(
    exports: DataFrame, flows: DataFrame | None = None, gravity: DataFrame | None = None, phi: DataFrame | None = None,
    products: DataFrame | None = None, trade: DataFrame | None = None, gravity_year: int | None = None,
) -> DataFrame:
    """All relations as one table: src_type, src, rel, dst_type, dst, weight, year and the ``PROPERTIES`` of the relation.

    ``exports`` has iso3, hs4, export_value, rca, year; ``products`` is the product node table. Absent inputs are left out.
    Flows are written once, as three relations read them.
    """
    parts = [_typed(export_edges(exports), "EXPORTS", "country", "product", F.col("value"))]
    if flows is not None:
        flows = stage(flows.select("reporter_iso3", "partner_iso3", "hs4", "flow", "value", "year"), "flows")
    if flows is not None or trade is not None:
        parts.append(_typed(import_edges(trade, flows), "IMPORTS", "country", "product", F.col("value")))
    if flows is not None:
        both = F.coalesce("export_value", F.lit(0.0)) + F.coalesce("import_value", F.lit(0.0))
        parts.append(_typed(partner_edges(flows), "TRADES_WITH", "country", "country", both))
        parts.append(_typed(shipment_edges(flows), "SHIPS", "country", "country", F.col("value")))
    if phi is not None:
        parts.append(_typed(proximity_edges(phi), "PROXIMITY", "product", "product", F.col("weight")))
    if products is not None:
        parts.append(_typed(section_edges(products), "IN_SECTION", "product", "section"))
    if gravity is not None:
        years = gravity if gravity_year is None else gravity.where(F.col("year") == gravity_year)
        parts.append(_typed(neighbour_edges(years), "NEIGHBOR_OF", "country", "country", F.col("distance")))
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


def node_id(kind: Column | str, key: Column | str) -> Column:
    """One id space for all node types: ``country:MKD``."""
    return F.concat_ws(":", kind, key)


def adjacency(edges: DataFrame) -> DataFrame:
    """Undirected simple graph of a typed edge table: distinct (src, dst) in both directions, no loops."""
    a = edges.select(node_id("src_type", "src").alias("src"), node_id("dst_type", "dst").alias("dst"))
    # One row per unordered pair before mirroring halves what the deduplication shuffles.
    once = a.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return once.select(
        F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")
    ).select("e.*")


def hops(adj: DataFrame, seeds: DataFrame, k: int = 2) -> DataFrame:
    """Computation subgraph: edges (src, dst, hop) whose ``src`` is reached within ``k - 1`` steps of a seed.

    ``seeds`` has ``node``; an edge carries the smallest hop that uses it.
    """
    reached = seeds.select("node").distinct().withColumn("step", F.lit(1))
    for step in range(2, k + 1):
        # Several paths lead to a node; the smallest step is kept.
        further = adj.join(reached.where(F.col("step") == step - 1), adj["src"] == reached["node"]).select(
            F.col("dst").alias("node"), F.lit(step).alias("step")
        )
        reached = reached.unionByName(further).groupBy("node").agg(F.min("step").alias("step"))
    return adj.join(reached.select(F.col("node").alias("src"), F.col("step").alias("hop")), "src").select("src", "dst", "hop")


# --- features ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Features:
    """What node features are made with, learnt from training rows: numbers with their mean, centre and spread, and categories."""

    numbers: dict[str, tuple[float, float, float]]
    sizes: frozenset[str]
    categories: dict[str, list[str]]
    flags: Sequence[str]

    @property
    def width(self) -> int:
        return len(self.numbers) + sum(len(v) + 1 for v in self.categories.values()) + len(self.flags)

    def vector(self) -> Column:
        """Scaled numbers, a column per category and one for categories not seen, and flags."""
        parts = []
        for c, (mean, centre, spread) in self.numbers.items():
            x = F.coalesce(_number(c, c in self.sizes), F.lit(mean))
            parts.append((x - centre) / spread if spread > 0 else F.lit(0.0))
        for c, known in self.categories.items():
            label = F.coalesce(F.col(c).cast("string"), F.lit(""))
            parts += [F.when(label == k, 1.0).otherwise(0.0) for k in known] + [F.when(label.isin(known), 0.0).otherwise(1.0)]
        parts += [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in self.flags]
        return F.array(*parts)


def _number(column: str, size: bool) -> Column:
    x = F.col(column).cast("double")
    x = F.log1p(x) if size else x
    return F.when(~F.isnan(x), x)


def fit_features(
    training: DataFrame, sizes: Sequence[str] = (), numbers: Sequence[str] = (), categories: Sequence[str] = (),
    flags: Sequence[str] = (),
) -> Features:
    """Imputation by the mean, scaling and one-hot encoding, learnt on training rows only.

    ``sizes`` are strictly positive magnitudes taken in logs; ``flags`` become 0 or 1 with null as 0. Two aggregates give the
    numbers; the categories of a column are what reaches the driver besides.
    """
    scaled = [*sizes, *numbers]
    known = {c: sorted(r[0] for r in training.select(F.coalesce(F.col(c).cast("string"), F.lit(""))).distinct().collect()) for c in categories}
    stats: dict[str, tuple[float, float, float]] = {}
    if scaled:
        means = training.agg(*[F.coalesce(F.avg(_number(c, c in sizes)), F.lit(0.0)).alias(c) for c in scaled]).first()
        filled = {c: F.coalesce(_number(c, c in sizes), F.lit(means[c])) for c in scaled}
        row = training.agg(*[f(x).alias(f"{f.__name__}_{c}") for c, x in filled.items() for f in (F.avg, F.stddev_samp)]).first()
        stats = {c: (means[c], row[f"avg_{c}"] or 0.0, row[f"stddev_samp_{c}"] or 0.0) for c in scaled}
    return Features(stats, frozenset(sizes), known, list(flags))


def assemble_features(nodes: DataFrame, fitted: Features, key: str, kind: str) -> DataFrame:
    """(node, vector) with the fitted transformations."""
    return nodes.select(node_id(F.lit(kind), key).alias("node"), fitted.vector().alias("vector"))


def join_features(parts: Sequence[tuple[DataFrame, int]], nodes: DataFrame) -> tuple[DataFrame, int]:
    """Features of several kinds of nodes side by side, each in a stretch of its own: (node, vector) and the width.

    ``parts`` holds (features, width) of each kind; ``nodes`` (node) without features have zeros.
    """
    width, at, rows = sum(w for _, w in parts), 0, None
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    for df, own in parts:
        part = df.select("node", F.concat(zeros(at), F.col("vector"), zeros(width - at - own)).alias("vector"))
        rows = part if rows is None else rows.unionByName(part)
        at += own
    every = nodes.select("node").distinct().join(rows, "node", "left")
    return every.select("node", F.coalesce("vector", zeros(width)).alias("vector")), width


def append_embeddings(features: DataFrame, embeddings: DataFrame, dim: int) -> DataFrame:
    """Concatenate structural embeddings to the features; nodes without one get zeros."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    extra = embeddings.select("node", F.col("vector").alias("_e"))
    return features.join(extra, "node", "left").select(
        "node", F.concat("vector", F.coalesce("_e", zeros)).alias("vector")
    )
