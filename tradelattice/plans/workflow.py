"""The whole chain as functions over folders: clean, complexity, graph, models, opportunities.

Each step reads the tables the step before wrote and writes its own, so a step can be rerun by itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from tradelattice.functions import constants as K
from tradelattice.operators import (
    cleaning as P, complexity as C, decoders as D, embeddings as E, evaluation as V, graph as G, gravity as Y,
    neighbours as N, opportunities as O, profiles as A, splits as Z,
)
from tradelattice.session import stage
from tradelattice.sources import indicators, slices, tables


@dataclass(frozen=True)
class Inputs:
    """Paths of the raw inputs; absent ones are skipped."""

    exports_csv: str
    reporters: str
    partners: str
    slices: str | None = None
    gravity_csv: str | None = None
    payloads: str | None = None


@dataclass(frozen=True)
class Settings:
    export_years: tuple[int, int] = K.EXPORT_YEARS
    gravity_years: tuple[int, int] = K.GRAVITY_YEARS
    country: str = K.FOCUS_COUNTRY
    train_end: int = K.TRAIN_END_YEAR
    val_year: int = K.VAL_YEAR
    test_years: Sequence[int] = tuple(K.TEST_YEARS)
    proximity_at_least: float = 0.5
    dim: int = K.EMBEDDING_DIM
    top_k: int = 50
    sets: dict[str, Iterable[str]] = field(default_factory=lambda: {"cefta_member": K.CEFTA})


def clean(spark: SparkSession, raw: Inputs, out: str, settings: Settings = Settings()) -> list[str]:
    """Write the cleaned tables; bilateral totals fill the gaps of the export table where slices are given."""
    codes = P.country_codes(spark.read.parquet(raw.reporters), spark.read.parquet(raw.partners))
    tables.save(codes, f"{out}/country_codes")
    codes = spark.read.parquet(f"{out}/country_codes")
    exports = tables.read_exports(spark, raw.exports_csv, settings.export_years)
    done = ["country_codes", "exports"]
    if raw.slices:
        totals = slices.read_slices(spark, raw.slices, "totals")
        exports = P.supplement(exports, P.clean_totals(totals, codes), ["year", "iso3", "hs4"])
        tables.save(P.clean_flows(slices.read_slices(spark, raw.slices, "bilateral"), codes), f"{out}/flows")
        done.append("flows")
    tables.save(exports, f"{out}/exports")
    if raw.gravity_csv:
        tables.save(tables.read_gravity(spark, raw.gravity_csv, settings.gravity_years), f"{out}/gravity")
        done.append("gravity")
    if raw.payloads:
        tables.save(indicators.indicator_table(spark.read.parquet(raw.payloads)), f"{out}/indicators")
        done.append("indicators")
    return done


def complexity(spark: SparkSession, folder: str, year: int | None = None, settings: Settings = Settings()) -> list[str]:
    """Complexity tables of one or all years, the proximities of the latest year, and those of the latest training year."""
    result = C.compute_complexity(spark.read.parquet(f"{folder}/exports"), year)
    proximity = stage(result.proximity, "proximity")
    training = A.in_latest_year(proximity.where(F.col("year") <= settings.train_end)).drop("year")
    tables.save(training, f"{folder}/proximity_training")
    return [*tables.save_complexity(result, folder, A.in_latest_year(proximity).drop("year")), "proximity_training"]


def graph(
    spark: SparkSession, folder: str, products: DataFrame, sections: DataFrame, countries: DataFrame, year: int,
    settings: Settings = Settings(),
) -> None:
    """Node and edge tables of one node year; uniqueness of the node keys is checked before writing."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    full = read("complexity")
    nodes = {
        "country": G.require_unique(
            G.country_nodes(countries, read("indicators"), read("country_complexity"), settings.sets, year), ["iso3"]
        ),
        "product": G.require_unique(G.product_nodes(products, sections, read("product_complexity"), year), ["hs_code"]),
        "section": G.require_unique(G.section_nodes(sections), ["code"]),
    }
    proximity = read("proximity_matrix")
    phi = G.proximity_edges(proximity, settings.proximity_at_least).select(
        F.col("src").alias("hs4_i"), F.col("dst").alias("hs4_j"), F.col("weight").alias("proximity")
    )
    edges = G.typed_edges(full, read("flows"), read("gravity"), phi, nodes["product"], gravity_year=year)
    tables.save_graph(nodes, edges, f"{folder}/graph")


def split_links(spark: SparkSession, folder: str, settings: Settings = Settings()) -> DataFrame:
    """Labelled country-product links of every year by split, in node ids, with as many negatives as positives."""
    full = spark.read.parquet(f"{folder}/complexity")
    ids = {"src": G.node_id(F.lit("country"), "iso3"), "dst": G.node_id(F.lit("product"), "hs4")}
    links = C.presence(full).select(*[c.alias(n) for n, c in ids.items()], "year")
    positives = stage(Z.temporal_split(links, settings.train_end, settings.val_year, settings.test_years, by_year=True), "positives")
    nodes = [full.select(c.alias(n)) for n, c in ids.items()]
    return stage(Z.labelled(positives, Z.negatives(positives, *nodes, keys=["year"])), "labelled")


def message_edges(spark: SparkSession, folder: str, labelled: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(src, rel, dst) both ways up to the training end, without the held-out pairs."""
    stored = spark.read.parquet(f"{folder}/graph/edges")
    # Sections and borders have no year; every other relation must be dated within the training years.
    edges = stored.where(F.col("rel").isin("IN_SECTION", "NEIGHBOR_OF") | (F.col("year") <= settings.train_end))
    near = G.proximity_edges(spark.read.parquet(f"{folder}/proximity_training"), settings.proximity_at_least).select(
        G.node_id(F.lit("product"), "src").alias("src"), F.lit("PROXIMITY").alias("rel"), G.node_id(F.lit("product"), "dst").alias("dst")
    )
    full = spark.read.parquet(f"{folder}/complexity").where(F.col("year") <= settings.train_end)
    exported = C.presence(full).select(
        G.node_id(F.lit("country"), "iso3").alias("src"), F.lit("EXPORTS").alias("rel"), G.node_id(F.lit("product"), "hs4").alias("dst"), "year"
    )
    exported = Z.propagation_edges(exported, labelled.where("label = 1")).drop("year")
    # Volumes stay in the stored graph; links that carry messages are comparative advantages and the other relations.
    rest = edges.where(~F.col("rel").isin("EXPORTS", "IMPORTS", "SHIPS", "PROXIMITY")).select(
        G.node_id("src_type", "src").alias("src"), "rel", G.node_id("dst_type", "dst").alias("dst")
    )
    one = exported.unionByName(rest).unionByName(near).distinct()
    return stage(one.unionByName(one.select(F.col("dst").alias("src"), "rel", F.col("src").alias("dst"))).distinct(), "messages")


def encoder_features(spark: SparkSession, folder: str, edges: DataFrame, settings: Settings) -> DataFrame:
    """Features of the stored nodes with diversity and ubiquity of the training end, brought to the encoders' width."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    at_end = lambda name: read(name).where(F.col("year") == settings.train_end).drop("year")
    countries = read("graph/nodes/country").drop("eci").join(at_end("country_complexity"), "iso3", "left")
    products = read("graph/nodes/product").drop("pci").join(at_end("product_complexity").withColumnRenamed("hs4", "hs_code"), "hs_code", "left")
    of_country = G.fit_features(
        countries, ["gdp", "gdp_pc", "population"], ["eci", "diversity"], ["region"], ["landlocked", *settings.sets])
    of_product = G.fit_features(products, numbers=["pci", "ubiquity"], categories=["section"])
    rows, width = G.join_features(
        [(G.assemble_features(countries, of_country, "iso3", "country"), of_country.width),
         (G.assemble_features(products, of_product, "hs_code", "product"), of_product.width)],
        edges.select(F.col("src").alias("node")))
    return stage(E.project(rows, width, settings.dim), "features")


def models(
    spark: SparkSession, folder: str, encoders: Sequence[str] = ("sage", "gcn", "rgcn", "fastrp"),
    decoders: Sequence[str] = ("dot_product", "distmult"), settings: Settings = Settings(),
) -> DataFrame:
    """Test metrics of the selected model and of the baselines on the same pairs: (model, metric, k, value)."""
    labelled = split_links(spark, folder, settings)
    edges = message_edges(spark, folder, labelled, settings)
    features = encoder_features(spark, folder, edges, settings)
    best, decoder, vectors, _ = D.select_model(edges, features, labelled, settings.dim, encoders, decoders, samples=K.NEIGHBOUR_SAMPLES)
    opened = O.open_products(spark.read.parquet(f"{folder}/complexity")).select(
        "year", G.node_id(F.lit("country"), "iso3").alias("src"), G.node_id(F.lit("product"), "hs4").alias("dst"))
    tables.save(decoder.score(opened, vectors), f"{folder}/link_scores")
    test = labelled.where("split = 'test'").select("src", "dst", "label")
    adj = stage(edges.select("src", "dst").distinct(), "adjacency")
    near = N.neighbour_scores(adj, test.select(F.col("src").alias("node_u"), F.col("dst").alias("node_v")))
    near = near.withColumnsRenamed({"node_u": "src", "node_v": "dst"})
    last = spark.read.parquet(f"{folder}/complexity").where(F.col("year") == settings.train_end).select(
        G.node_id(F.lit("country"), "iso3").alias("src"), G.node_id(F.lit("product"), "hs4").alias("dst"), "density", "cog"
    )
    base = test.join(near, ["src", "dst"]).join(last, ["src", "dst"], "left")
    names = ["adamic_adar", "jaccard", "cn", "density", "cog"]
    scores = F.array(*[F.struct(F.lit(n).alias("model"), F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias("score")) for n in names])
    scored = base.select("src", "dst", "label", F.inline(scores)).unionByName(
        decoder.score(test, vectors).withColumn("model", F.lit(best))
    )
    results = V.all_metrics(stage(scored, "test-scores"), by=["model"])
    tables.save(results, f"{folder}/results")
    return spark.read.parquet(f"{folder}/results")


def opportunities(
    spark: SparkSession, folder: str, products: DataFrame, countries: DataFrame, year: int, settings: Settings = Settings()
) -> list[str]:
    """Ranked new products and new markets of the focus country."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    full, flows, gravity = read("complexity"), read("flows"), read("gravity")
    scores = None
    if tables.is_complete(spark, f"{folder}/link_scores"):  # of the selected model, once there is one; else by density
        own = read("link_scores").where((F.col("year") == year) & (F.col("src") == G.node_id(F.lit("country"), F.lit(settings.country))))
        scores = own.select(F.split_part("dst", F.lit(":"), F.lit(2)).alias("hs4"), "score")
    tables.save(O.rank_products(full, products, settings.country, year, scores, settings.top_k), f"{folder}/product_opportunities")
    fitted = Y.fit_gravity(flows, gravity, [y for y in range(settings.export_years[0], settings.train_end + 1)])
    expected = Y.predict_gravity(fitted, flows, gravity, [year], settings.train_end)
    markets = O.rank_markets(full, flows, countries, products, settings.country, year, gravity=expected, k=settings.top_k)
    tables.save(markets, f"{folder}/market_opportunities")
    return ["product_opportunities", "market_opportunities"]
