"""Queries for the graph tables, neighbour scores, splits and negatives."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradelattice.operators import complexity as C, graph as G, neighbours as N, opportunities as O, splits as Z
from tradelattice.plans.complexity_queries import FOCUS, adv, metrics
from tradelattice.plans.registry import SHARED, query, r, r6, rounded
from tradelattice.session import scratch_path
from tradelattice.sources import tables
from tradelattice.sources.indicators import indicator_table
from tradelattice.plans.cleaning_queries import payloads

YEAR = 1999  # the last training year
CLOSE = 0.5  # proximity from which two products are linked
SETS = {"eu_member": ["N02", "N09"], "cefta_member": ["N01", "N02", "N03"]}
SPLIT = {"train_end": 1999, "val_year": 2000, "test_years": [2001]}

SHARED.update({
    "country_node": f"""
        SELECT c.iso3, c.country_name AS name, c.region, w.gdp, {r('w.gdp_pc')} AS gdp_pc, w.population, NULL::BOOLEAN AS landlocked,
               {r6('k.eci')} AS eci, c.iso3 IN ('N02', 'N09') AS eu_member, c.iso3 IN ('N01', 'N02', 'N03') AS cefta_member
        FROM {{countries}} c LEFT JOIN (SELECT * FROM {{indicator_wide}} WHERE year = {YEAR}) w USING (iso3)
             LEFT JOIN (SELECT year, iso3, eci FROM {{ecic}} WHERE year = {YEAR}) k USING (iso3)""",
    "product_node": f"""
        SELECT p.hs4 AS hs_code, 4::INT AS hs_level, p.product_name AS name, s.code AS section, {r6('q.pci')} AS pci
        FROM {{products}} p LEFT JOIN {{sections}} s ON substr(p.hs4, 1, 2)::INT BETWEEN s.hs2_from AND s.hs2_to
             LEFT JOIN (SELECT * FROM {{pcie}} WHERE year = {YEAR}) q USING (hs4)""",
    "trades_with": """
        SELECT reporter_iso3 AS src, partner_iso3 AS dst, year, sum(CASE WHEN flow = 'X' THEN value::DECIMAL(18,2) END)::DOUBLE
               AS export_value, sum(CASE WHEN flow = 'M' THEN value::DECIMAL(18,2) END)::DOUBLE AS import_value
        FROM {flows} GROUP BY ALL""",
    "edge": f"""
        SELECT 'country' AS src_type, iso3 AS src, 'EXPORTS' AS rel, 'product' AS dst_type, hs4 AS dst, export_value AS weight, year,
               export_value AS value, rca, NULL::DOUBLE AS export_value, NULL::DOUBLE AS import_value, NULL::VARCHAR AS hs_code,
               NULL::DOUBLE AS distance, NULL::BOOLEAN AS contiguous, NULL::BOOLEAN AS common_lang, NULL::BOOLEAN AS fta
        FROM {{adv}} WHERE export_value > 0
        UNION ALL BY NAME SELECT 'country' AS src_type, reporter_iso3 AS src, 'IMPORTS' AS rel, 'product' AS dst_type, hs4 AS dst,
                  sum(value::DECIMAL(18,2))::DOUBLE AS weight, year, sum(value::DECIMAL(18,2))::DOUBLE AS value
                  FROM {{flows}} WHERE flow = 'M' GROUP BY ALL
        UNION ALL BY NAME SELECT 'country' AS src_type, src, 'TRADES_WITH' AS rel, 'country' AS dst_type, dst,
                  coalesce(export_value, 0.0) + coalesce(import_value, 0.0) AS weight, year, export_value, import_value FROM {{trades_with}}
        UNION ALL BY NAME SELECT 'country' AS src_type, reporter_iso3 AS src, 'SHIPS' AS rel, 'country' AS dst_type, partner_iso3 AS dst,
                  value AS weight, year, value, hs4 AS hs_code FROM {{flows}} WHERE flow = 'X'
        UNION ALL BY NAME SELECT 'product' AS src_type, hs4_i AS src, 'PROXIMITY' AS rel, 'product' AS dst_type, hs4_j AS dst,
                  proximity AS weight, year FROM {{phi}}
        UNION ALL BY NAME SELECT 'product' AS src_type, hs_code AS src, 'IN_SECTION' AS rel, 'section' AS dst_type, section AS dst
                  FROM {{product_node}} WHERE section IS NOT NULL
        UNION ALL BY NAME SELECT 'country' AS src_type, iso3_o AS src, 'NEIGHBOR_OF' AS rel, 'country' AS dst_type, iso3_d AS dst,
                  dist AS weight, year, dist AS distance, contig = 1 AS contiguous, comlang_off = 1 AS common_lang, fta_wto = 1 AS fta
                  FROM {{gravity}} WHERE year = {YEAR}""",
    # The link graph of the training years: comparative advantages, close products and every other relation.
    "link_edge": f"""
        SELECT DISTINCT 'country:' || iso3 AS a, 'product:' || hs4 AS b, 'EXPORTS' AS rel FROM {{m}} WHERE year <= {YEAR}
        UNION ALL SELECT DISTINCT 'country:' || reporter_iso3, 'product:' || hs4, 'IMPORTS' FROM {{flows}} WHERE flow = 'M' AND value > 0 AND year <= {YEAR}
        UNION ALL SELECT DISTINCT 'country:' || reporter_iso3, 'country:' || partner_iso3, 'TRADES_WITH' FROM {{flows}} WHERE year <= {YEAR}
        UNION ALL SELECT DISTINCT 'country:' || reporter_iso3, 'country:' || partner_iso3, 'SHIPS' FROM {{flows}} WHERE flow = 'X' AND year <= {YEAR}
        UNION ALL SELECT DISTINCT 'product:' || hs4_i, 'product:' || hs4_j, 'PROXIMITY' FROM {{phi}} WHERE proximity >= {CLOSE} AND year <= {YEAR}
        UNION ALL SELECT 'product:' || hs_code, 'section:' || section, 'IN_SECTION' FROM {{product_node}} WHERE section IS NOT NULL
        UNION ALL SELECT DISTINCT 'country:' || iso3_o, 'country:' || iso3_d, 'NEIGHBOR_OF' FROM {{gravity}} WHERE year <= {YEAR}""",
    "adj": "SELECT DISTINCT a AS src, b AS dst FROM (SELECT a, b FROM {link_edge} UNION ALL SELECT b, a FROM {link_edge}) WHERE a <> b",
    "deg": "SELECT src AS node, count(*) AS degree FROM {adj} GROUP BY ALL",
    "cand": f"SELECT 'country:' || iso3 AS node_u, 'product:' || hs4 AS node_v FROM {{pres}} WHERE year = {YEAR} AND mcp = 0",
    "nscore": """
        SELECT c.node_u, c.node_v, coalesce(n.aa, 0.0) AS adamic_adar,
               coalesce(n.cn / nullif(coalesce(a.degree, 0) + coalesce(b.degree, 0) - n.cn, 0)::DOUBLE, 0.0) AS jaccard,
               coalesce(n.cn, 0)::BIGINT AS cn
        FROM {cand} c LEFT JOIN {deg} a ON a.node = c.node_u LEFT JOIN {deg} b ON b.node = c.node_v
             LEFT JOIN (SELECT x.src AS node_u, y.dst AS node_v, count(*) AS cn, sum(1 / ln(d.degree)) AS aa
                        FROM {adj} x JOIN {adj} y ON x.dst = y.src JOIN {deg} d ON d.node = x.dst GROUP BY ALL) n
                       USING (node_u, node_v)""",
    "pos": """
        SELECT iso3 AS src, hs4 AS dst, CASE min(CASE WHEN year <= 1999 THEN 0 WHEN year = 2000 THEN 1 ELSE 2 END)
               WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split
        FROM {m} WHERE year <= 2001 GROUP BY ALL""",
    "allpairs": "SELECT c.iso3 AS src, p.hs4 AS dst FROM (SELECT DISTINCT iso3 FROM {cells}) c, (SELECT DISTINCT hs4 FROM {cells}) p",
})
SHARED.update({
    "dated": """
        SELECT iso3 AS src, hs4 AS dst, year, CASE WHEN year <= 1999 THEN 'train' WHEN year = 2000 THEN 'val' ELSE 'test' END AS split
        FROM {m} WHERE year <= 2001""",
    "num_src": "SELECT iso3 AS src, row_number() OVER (ORDER BY iso3) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT iso3 FROM {cells})",
    "num_dst": "SELECT hs4 AS dst, row_number() OVER (ORDER BY hs4) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT hs4 FROM {cells})",
    "num_year": """SELECT split, year, row_number() OVER (PARTITION BY split ORDER BY year) - 1 AS i, count(*) OVER (PARTITION BY split) AS n
                   FROM (SELECT DISTINCT split, year FROM {dated})""",
    # Many more draws than links are wanted; the first that are left are taken.
    "draws": f"""
        SELECT split, need, n, {', '.join(f"('0x' || substr(md5(split || '|{c}|' || n || '|42'), 1, 8))::BIGINT AS {c}_h" for c in ('src', 'dst', 'year'))}
        FROM (SELECT split, need, unnest(range(40 * need)) AS n FROM (SELECT split, count(*) AS need FROM {{dated}} GROUP BY split))""",
    "drawn": """
        SELECT d.split, any_value(d.need) AS need, s.src, t.dst, y.year, min(d.n) AS n
        FROM {draws} d JOIN {num_src} s ON d.src_h % s.n = s.i JOIN {num_dst} t ON d.dst_h % t.n = t.i
             JOIN {num_year} y ON y.split = d.split AND d.year_h % y.n = y.i
        GROUP BY d.split, s.src, t.dst, y.year""",
    "neg": """
        SELECT src, dst, year, split FROM (
            SELECT *, row_number() OVER (PARTITION BY split ORDER BY n) AS place FROM {drawn} d
            WHERE NOT EXISTS (SELECT 1 FROM {dated} p WHERE p.src = d.src AND p.dst = d.dst AND p.year = d.year))
        WHERE place <= need""",
})


def complexity_table(t):
    return t.stored("complexity", lambda: metrics(t).table)


def presence_table(t):
    return t.stored("presence", lambda: C.presence(adv(t)))


def proximity_table(t):
    return t.stored("proximity", lambda: C.proximity(presence_table(t)))


def product_scores(t):
    return C.product_complexity(complexity_table(t))


def country_node_table(t):
    return G.country_nodes(t.countries, indicator_table(payloads(t)), C.country_complexity(complexity_table(t)), SETS, YEAR)


def product_node_table(t):
    return G.product_nodes(t.products, t.sections, product_scores(t), YEAR)


def link_edges(t):
    """Typed edges of the link graph of the training years, each once."""
    def build():
        m = presence_table(t).where(F.col("year") <= YEAR)
        flows, phi = t.flows.where(F.col("year") <= YEAR), proximity_table(t).where(F.col("year") <= YEAR)
        every = G.typed_edges(
            m.withColumns({"export_value": F.lit(1.0), "rca": F.lit(1.0)}), flows, t.gravity.where(F.col("year") <= YEAR),
            phi.where(F.col("proximity") >= CLOSE), product_node_table(t),
        )
        return every.select("src_type", "src", "rel", "dst_type", "dst").distinct()

    return t.stored("typed-links", build)


def link_graph(t):
    return t.stored("adjacency", lambda: G.adjacency(link_edges(t)))


def candidates(t):
    opened = O.open_products(complexity_table(t)).where(F.col("year") == YEAR)
    return opened.select(
        G.node_id(F.lit("country"), "iso3").alias("node_u"), G.node_id(F.lit("product"), "hs4").alias("node_v")
    )


def positive_pairs(t):
    m = presence_table(t).select(F.col("iso3").alias("src"), F.col("hs4").alias("dst"), "year")
    return t.stored("positives", lambda: Z.temporal_split(m, **SPLIT))


def dated_links(t):
    """The links of every year, by split."""
    m = presence_table(t).select(F.col("iso3").alias("src"), F.col("hs4").alias("dst"), "year")
    return t.stored("dated-links", lambda: Z.temporal_split(m, **SPLIT, by_year=True))


def sampled_negatives(t):
    """As many negatives as links in every split; all free ones where links fill more than half of its cells."""
    cells = C.trade_cells(t.exports)
    nodes = cells.select(F.col("iso3").alias("src")), cells.select(F.col("hs4").alias("dst"))
    return Z.negatives(dated_links(t), *nodes, keys=["year"], or_all_free=True)


# --- nodes and edges -----------------------------------------------------------------------------


@query("country_nodes", "SELECT * FROM {country_node}")
def country_nodes(t):
    return rounded(country_node_table(t))


@query("product_nodes", "SELECT * FROM {product_node}")
def product_nodes(t):
    return rounded(product_node_table(t))


@query("section_nodes", "SELECT code, name FROM {sections}")
def section_nodes(t):
    return G.section_nodes(t.sections)


@query("section_edges", "SELECT hs_code AS src, section AS dst FROM {product_node} WHERE section IS NOT NULL")
def section_edges(t):
    return G.section_edges(product_node_table(t))


@query("export_edges", f"SELECT iso3 AS src, hs4 AS dst, export_value AS value, {r('rca')} AS rca, year FROM {{adv}} WHERE export_value > 0")
def export_edges(t):
    return rounded(G.export_edges(adv(t)))


@query("import_edges", """SELECT reporter_iso3 AS src, hs4 AS dst, sum(value::DECIMAL(18,2))::DOUBLE AS value, year
       FROM {flows} WHERE flow = 'M' GROUP BY ALL""")
def import_edges(t):
    return rounded(G.import_edges(flows=t.flows), 2)


@query("reported_import_edges", "SELECT iso3 AS src, hs4 AS dst, sum(import_value::DECIMAL(18,2))::DOUBLE AS value, year FROM {c_exports} WHERE import_value > 0 GROUP BY ALL")
def reported_import_edges(t):
    from tradelattice.plans.cleaning_queries import cleaned_exports

    return rounded(G.import_edges(trade=cleaned_exports(t)), 2)


@query("partner_edges", "SELECT * FROM {trades_with}")
def partner_edges(t):
    return rounded(G.partner_edges(t.flows), 2)


@query("shipment_edges", "SELECT reporter_iso3 AS src, partner_iso3 AS dst, hs4 AS hs_code, year, value FROM {flows} WHERE flow = 'X'")
def shipment_edges(t):
    return rounded(G.shipment_edges(t.flows), 2)


@query("proximity_edges", f"SELECT hs4_i AS src, hs4_j AS dst, {r('proximity')} AS weight, year FROM {{phi}} WHERE proximity >= 0.55 - 1e-12")
def proximity_edges(t):
    return rounded(G.proximity_edges(proximity_table(t), 0.55 - 1e-12))


@query("neighbour_edges", f"""SELECT iso3_o AS src, iso3_d AS dst, dist AS distance, contig = 1 AS contiguous,
       comlang_off = 1 AS common_lang, fta_wto = 1 AS fta FROM {{gravity}} WHERE year = {YEAR}""")
def neighbour_edges(t):
    return G.neighbour_edges(t.gravity, YEAR)


@query("duplicate_nodes", "SELECT iso3, count(*)::BIGINT AS n FROM {exports} GROUP BY ALL HAVING count(*) > 1")
def duplicate_nodes(t):
    return G.duplicates(t.exports, ["iso3"])


@query("dangling_edges", f"""SELECT reporter_iso3 AS src, partner_iso3 AS dst, hs4, year FROM {{flows}}
       WHERE flow = 'X' AND partner_iso3 NOT IN (SELECT iso3 FROM {{countries}} WHERE region < 3)""")
def dangling_edges(t):
    edges = t.flows.where("flow = 'X'").select(F.col("reporter_iso3").alias("src"), F.col("partner_iso3").alias("dst"), "hs4", "year")
    return G.dangling(edges, "dst", t.countries.where("region < 3"), "iso3")


@query("bipartite_graph", f"""
    SELECT a.iso3, a.hs4, a.export_value, {r('a.rca')} AS rca, a.year, c.region AS country_region, p.section AS product_section
    FROM {{adv}} a LEFT JOIN {{countries}} c USING (iso3) LEFT JOIN {{products}} p USING (hs4) WHERE a.export_value > 0""")
def bipartite_graph(t):
    return rounded(G.bipartite(adv(t), t.countries.select("iso3", "region"), t.products.select("hs4", "section")))


def typed_edge_table(t):
    return G.typed_edges(adv(t), t.flows, t.gravity, proximity_table(t), product_node_table(t), gravity_year=YEAR)


AMOUNTS = ", ".join(f"{r(c, 4)} AS {c}" for c in ("weight", "value", "rca", "export_value", "import_value", "distance"))
EDGES = f"SELECT src_type, src, rel, dst_type, dst, {AMOUNTS}, year, hs_code, contiguous, common_lang, fta FROM {{edge}}"


@query("typed_edges", EDGES)
def typed_edges(t):
    return rounded(typed_edge_table(t), 4)


@query("typed_edges_exports_only", EDGES + " WHERE rel = 'EXPORTS'")
def typed_edges_exports_only(t):
    return rounded(G.typed_edges(adv(t)), 4)


@query("stored_graph", EDGES)
def stored_graph(t):
    path = scratch_path(t.spark, "graph")
    nodes = {"country": G.require_unique(country_node_table(t), ["iso3"]), "product": product_node_table(t),
             "section": G.section_nodes(t.sections)}
    tables.save_graph(nodes, typed_edge_table(t), path)
    edges = t.spark.read.parquet(f"{path}/edges")
    return rounded(edges.select(*G.EDGE, *G.PROPERTIES), 4)


@query("stored_complexity", f"SELECT year, iso3, hs4, {r('density')} AS density FROM {{dens}}")
def stored_complexity(t):
    path = scratch_path(t.spark, "complexity")
    result = C.compute_complexity(t.exports)
    tables.save_complexity(result, path, result.proximity.where("year = 2001").drop("year"))
    return rounded(t.spark.read.parquet(f"{path}/density_matrix").select("year", "iso3", "hs4", "density"))


# --- joins on the graph --------------------------------------------------------------------------


@query("adjacency", "SELECT src, dst FROM {adj}")
def adjacency(t):
    return G.adjacency(link_edges(t))


@query("neighbour_scores", f"SELECT node_u, node_v, {r('adamic_adar')} AS adamic_adar, {r('jaccard')} AS jaccard, cn FROM {{nscore}}")
def neighbour_scores(t):
    return rounded(N.neighbour_scores(link_graph(t), candidates(t)))


@query("computation_subgraph", f"""
    SELECT a.src, a.dst, min(k.hop)::INT AS hop FROM {{adj}} a JOIN (
        SELECT 'country:{FOCUS}' AS node, 1 AS hop
        UNION ALL SELECT 'product:1010', 1
        UNION ALL SELECT dst, 2 FROM {{adj}} WHERE src IN ('country:{FOCUS}', 'product:1010')) k ON a.src = k.node
    GROUP BY ALL""")
def computation_subgraph(t):
    seeds = t.countries.where(F.col("iso3") == FOCUS).select(G.node_id(F.lit("country"), "iso3").alias("node")).unionByName(
        t.products.where("hs4 = '1010'").select(G.node_id(F.lit("product"), "hs4").alias("node"))
    )
    return G.hops(link_graph(t), seeds, 2)


# --- splits --------------------------------------------------------------------------------------


@query("temporal_split", "SELECT src, dst, split FROM {pos}")
def temporal_split(t):
    m = presence_table(t).select(F.col("iso3").alias("src"), F.col("hs4").alias("dst"), "year")
    return Z.temporal_split(m, **SPLIT)


@query("temporal_split_all_links", """SELECT DISTINCT iso3 AS src, hs4 AS dst,
       CASE WHEN year <= 1999 THEN 'train' WHEN year = 2000 THEN 'val' ELSE 'test' END AS split FROM {m} WHERE year <= 2001""")
def temporal_split_all(t):
    m = presence_table(t).select(F.col("iso3").alias("src"), F.col("hs4").alias("dst"), "year")
    return Z.temporal_split(m, **SPLIT, new_links_only=False)


@query("random_split", """
    SELECT src, dst, CASE WHEN b < 8500 THEN 'train' WHEN b < 9000 THEN 'val' ELSE 'test' END AS split
    FROM (SELECT DISTINCT iso3 AS src, hs4 AS dst, ('0x' || substr(md5(iso3 || '|' || hs4 || '|42'), 1, 8))::BIGINT % 10000 AS b FROM {m})""")
def random_split(t):
    return Z.random_split(presence_table(t).select(F.col("iso3").alias("src"), F.col("hs4").alias("dst")))


@query("propagation_edges", """SELECT iso3 AS src, hs4 AS dst, year FROM {m}
       WHERE (iso3, hs4) NOT IN (SELECT src, dst FROM {pos} WHERE split <> 'train')""")
def propagation_edges(t):
    m = presence_table(t).select(F.col("iso3").alias("src"), F.col("hs4").alias("dst"), "year")
    return Z.propagation_edges(m, positive_pairs(t))


@query("missing_links", "SELECT a.src, a.dst FROM {allpairs} a WHERE (a.src, a.dst) NOT IN (SELECT src, dst FROM {pos})")
def missing_links(t):
    cells = C.trade_cells(t.exports)
    return O.missing_links(cells.select("iso3"), cells.select("hs4"), positive_pairs(t), "iso3", "hs4")


@query("dated_links", "SELECT src, dst, year, split FROM {dated}")
def dated_links_query(t):
    m = presence_table(t).select(F.col("iso3").alias("src"), F.col("hs4").alias("dst"), "year")
    return Z.temporal_split(m, **SPLIT, by_year=True)


@query("negative_pairs", "SELECT src, dst, year, split FROM {neg}")
def negative_pairs(t):
    return sampled_negatives(t)


def _sampled(k: int, seed: int) -> str:
    return f"""
    SELECT src, rel, dst FROM (SELECT a AS src, rel, b AS dst, row_number() OVER (PARTITION BY b, rel ORDER BY md5(a || '|' || rel || '|' || b || '|{seed}'), a) AS n
                               FROM {{link_edge}}) WHERE n <= {k}"""


def directed_links(t):
    return link_edges(t).select(G.node_id("src_type", "src").alias("src"), "rel", G.node_id("dst_type", "dst").alias("dst"))


@query("neighbour_sample", _sampled(10, 42))
def neighbour_sample(t):
    return Z.sample_neighbours(directed_links(t), 10)


@query("neighbour_sample_layers", f"SELECT 1 AS layer, * FROM ({_sampled(10, 43)}) UNION ALL SELECT 2, * FROM ({_sampled(15, 42)})")
def neighbour_sample_layers(t):
    first, second = (edges.withColumn("layer", F.lit(k + 1)) for k, edges in enumerate(Z.sample_layers(directed_links(t))))
    return first.unionByName(second)
