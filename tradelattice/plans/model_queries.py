"""Queries for embeddings, decoders, link prediction, gravity, evaluation and opportunities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tradelattice.functions import constants as K
from tradelattice.operators import (
    complexity as C, decoders as D, embeddings as E, evaluation as V, graph as G, gravity as Y, opportunities as O, splits as Z,
)
from tradelattice.plans.complexity_queries import FOCUS
from tradelattice.plans.graph_queries import (
    YEAR, complexity_table, country_node_table, dated_links, directed_links, link_graph, presence_table, product_node_table,
    proximity_table, sampled_negatives,
)
from tradelattice.plans.registry import SHARED, query, r, r6, rounded

DIM, WIDE = 8, 64  # short vectors; those of the default projection
COEFFICIENTS = {"intercept": 1.5, "ln_dist": -0.4, "ln_gdp_o": 0.5, "ln_gdp_d": 0.4, "contig": 0.3, "comlang_off": 0.2}
RELATIONS = K.RELATIONS
METRICS = ["roc_auc", "average_precision", "mrr"]


def _step(before: str) -> str:
    return f"SELECT a.dst AS node, f.i, avg(f.v) AS v FROM {{adj}} a JOIN {{{before}}} f ON a.src = f.node GROUP BY ALL"


def _unit(table: str) -> str:
    return f"""SELECT node, i, CASE WHEN n > 0 THEN v / n ELSE 0.0 END AS v
               FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY node)) AS n FROM {{{table}}})"""


def _gcn(before: str) -> str:
    return f"""
        SELECT e.dst AS node, f.i, sum(f.v / sqrt((coalesce(a.degree, 0) + 1) * (coalesce(b.degree, 0) + 1))) AS v
        FROM (SELECT src, dst FROM {{adj}} UNION ALL SELECT node, node FROM {{deg}}) e JOIN {{{before}}} f ON e.src = f.node
             JOIN {{deg}} a ON a.node = e.src JOIN {{deg}} b ON b.node = e.dst GROUP BY ALL"""


def _projection(dim: int, tail: str = "") -> dict[str, str]:
    """Random signs, their walks of one to three steps, and the normalised sum of the last two."""
    named = {
        "f0": f"""
        SELECT node, i, CASE h % 6 WHEN 0 THEN sqrt(3.0) WHEN 1 THEN -sqrt(3.0) ELSE 0.0 END AS v
        FROM (SELECT n.node, t.i, ('0x' || substr(md5(n.node || '|' || t.i || '|42'), 1, 8))::BIGINT AS h
              FROM (SELECT DISTINCT src AS node FROM {{adj}}) n, range({dim}) t(i))""",
        "f1": _step(f"f0{tail}"), "f2": _step(f"f1{tail}"), "f3": _step(f"f2{tail}"),
        "u2": _unit(f"f2{tail}"), "u3": _unit(f"f3{tail}"),
        "fsum": f"SELECT node, i, sum(v) AS v FROM (SELECT * FROM {{u2{tail}}} UNION ALL SELECT * FROM {{u3{tail}}}) GROUP BY ALL",
        "frp": _unit(f"fsum{tail}"),
    }
    return {f"{name}{tail}": sql for name, sql in named.items()}


SHARED["short_walk"] = """
    SELECT start, walk, list(node ORDER BY step) AS path FROM (
        WITH RECURSIVE near AS (SELECT a.src, row_number() OVER (PARTITION BY a.src ORDER BY a.dst) - 1 AS idx, a.dst FROM {adj} a),
        w(start, walk, step, node) AS (
            SELECT node, k, 0, node FROM {deg}, range(2) r(k)
            UNION ALL
            SELECT w.start, w.walk, w.step + 1, n.dst FROM w JOIN {deg} d ON d.node = w.node
                 JOIN near n ON n.src = w.node AND n.idx = ('0x' || substr(md5(w.start || '|' || w.walk || '|' || (w.step + 1) || '|42'), 1, 8))::BIGINT % d.degree
            WHERE w.step < 19)
        SELECT * FROM w) GROUP BY start, walk"""
SHARED.update(_projection(DIM) | _projection(WIDE, "_64") | {
    "g1": _gcn("f0"), "g2": _gcn("g1"),
    "both_edge": "SELECT DISTINCT a AS src, b AS dst, rel FROM (SELECT a, b, rel FROM {link_edge} UNION ALL SELECT b, a, rel FROM {link_edge})",
    "scored": f"""
        SELECT 'density' AS model, o.iso3 AS src, o.hs4 AS dst, {r('o.density')} AS score, n.mcp AS label
        FROM {{outlook}} o JOIN {{pres}} n ON n.year = {YEAR + 1} AND n.iso3 = o.iso3 AND n.hs4 = o.hs4
        WHERE o.year = {YEAR} AND o.mcp = 0 AND o.density IS NOT NULL
        UNION ALL
        SELECT 'ubiquity', o.iso3, o.hs4, k.k::DOUBLE, n.mcp
        FROM {{outlook}} o JOIN {{pres}} n ON n.year = {YEAR + 1} AND n.iso3 = o.iso3 AND n.hs4 = o.hs4
             JOIN {{kp}} k ON k.year = o.year AND k.hs4 = o.hs4
        WHERE o.year = {YEAR} AND o.mcp = 0 AND o.density IS NOT NULL""",
    "by_score": "SELECT model, score, sum(label) AS pos, sum(1 - label) AS neg FROM {scored} GROUP BY ALL",
    "curve": """SELECT model, score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM {by_score}
                WINDOW w AS (PARTITION BY model ORDER BY score DESC)""",
    "rank_all": "SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, src, dst) AS n FROM {scored}",
    "rank_src": "SELECT *, row_number() OVER (PARTITION BY model, src ORDER BY score DESC, src, dst) AS n FROM {scored}",
    "metric": """
        SELECT model, 'roc_auc' AS metric, NULL::INT AS k, sum(pos * (neg / 2.0 + (SELECT sum(neg) FROM {by_score} b WHERE b.model = c.model) - fp))::DOUBLE
               / (sum(pos) * sum(neg))::DOUBLE AS value FROM {curve} c GROUP BY model
        UNION ALL SELECT model, 'average_precision', NULL, sum(pos * tp::DOUBLE / (tp + fp)) / sum(pos)::DOUBLE FROM {curve} GROUP BY model
        UNION ALL SELECT model, 'mrr', NULL, avg(1.0::DOUBLE / n) FROM {rank_all} WHERE label = 1 GROUP BY model
        UNION ALL SELECT model, 'precision', k.k, sum(label) FILTER (n <= k.k)::DOUBLE / k.k FROM {rank_all}, (VALUES (10), (20), (50)) k(k) GROUP BY model, k.k
        UNION ALL SELECT model, 'recall', k.k, sum(label) FILTER (n <= k.k)::DOUBLE / sum(label)::DOUBLE FROM {rank_all}, (VALUES (10), (20), (50)) k(k) GROUP BY model, k.k
        UNION ALL SELECT model, 'hits', k.k, sum(label) FILTER (n <= k.k)::DOUBLE / sum(label)::DOUBLE FROM {rank_all}, (VALUES (10), (20), (50)) k(k) GROUP BY model, k.k""",
    "wide": """SELECT model, max(CASE WHEN metric = 'roc_auc' THEN value END) AS roc_auc,
                      max(CASE WHEN metric = 'average_precision' THEN value END) AS average_precision,
                      max(CASE WHEN metric = 'mrr' THEN value END) AS mrr FROM {metric} GROUP BY model""",
    "mu": f"""
        SELECT iso3_o, iso3_d, year, CASE WHEN dist > 0 AND gdp_o > 0 AND gdp_d > 0 THEN
               exp(1.5 - 0.4 * ln(dist) + 0.5 * ln(gdp_o) + 0.4 * ln(gdp_d) + 0.3 * contig + 0.2 * comlang_off) END AS predicted_value
        FROM {{gravity}} WHERE year = {YEAR + 1} AND iso3_o <> iso3_d""",
    "mu_hs": f"""
        SELECT m.iso3_o AS reporter_iso3, m.iso3_d AS partner_iso3, s.hs4, m.year, m.predicted_value * s.v / t.v AS predicted_value
        FROM {{mu}} m JOIN (SELECT reporter_iso3 AS o, hs4, sum(value) AS v FROM {{flows}} WHERE flow = 'X' AND year = {YEAR} GROUP BY ALL) s
             ON s.o = m.iso3_o JOIN (SELECT reporter_iso3 AS o, sum(value) AS v FROM {{flows}} WHERE flow = 'X' AND year = {YEAR} GROUP BY ALL) t
             ON t.o = m.iso3_o""",
    "demand": f"""SELECT hs4, reporter_iso3 AS partner_iso3, ln(1 + sum(value)) AS score FROM {{flows}}
                  WHERE flow = 'M' AND year = {YEAR} AND partner_iso3 <> '{FOCUS}' GROUP BY ALL""",
    "nodevec": "SELECT vec_id, embedding, label FROM {embeddings}",
})


def _long(vectors, digits=8):
    return rounded(vectors.select("node", F.posexplode("vector").alias("dim", "value")), digits)


LONG = f"SELECT node, dim::INT AS dim, {r('value')} AS value FROM "


def _hops(tables: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT node, {k * DIM} + i AS dim, v AS value FROM {{{t}}}" for k, t in enumerate(tables))


def both_ways(t):
    one = directed_links(t)
    mirrored = one.select(F.col("dst").alias("src"), "rel", F.col("src").alias("dst"))
    return t.stored("link-edges", lambda: one.unionByName(mirrored).distinct())


def signs(t):
    nodes = link_graph(t).select(F.col("src").alias("node")).distinct()
    return t.stored("signs", lambda: E.sparse_signs(nodes, DIM))


# --- embeddings ----------------------------------------------------------------------------------


@query("fastrp", LONG + "(SELECT node, i AS dim, v AS value FROM {frp})")
def fastrp(t):
    return _long(E.fastrp(link_graph(t), DIM))


@query("fastrp_64", LONG + "(SELECT node, i AS dim, v AS value FROM {frp_64})")
def fastrp_64(t):
    return _long(E.fastrp(link_graph(t)))


@query("sage_propagation", LONG + f"({_hops(['f0', 'f1', 'f2'])})")
def sage_propagation(t):
    return _long(E.propagate_hops(link_graph(t), signs(t), DIM, 2, "mean"))


@query("gcn_propagation", LONG + f"({_hops(['f0', 'g1', 'g2'])})")
def gcn_propagation(t):
    return _long(E.propagate_hops(link_graph(t), signs(t), DIM, 2, "gcn"))


def _relation_blocks(of: str) -> str:
    """Own numbers and those of the mean by relation, one row per node and number."""
    places = ", ".join(f"('{rel}', {k + 1})" for k, rel in enumerate(RELATIONS))
    return f"""
        SELECT node, i, v FROM {{{of}}}
        UNION ALL SELECT f.node, {DIM} * k.k + f.i, coalesce(p.v, 0.0) FROM {{{of}}} f
              CROSS JOIN (VALUES {places}) k(rel, k)
              LEFT JOIN (SELECT e.dst AS node, e.rel, x.i, avg(x.v) AS v FROM {{both_edge}} e JOIN {{{of}}} x ON e.src = x.node GROUP BY ALL) p
                        ON p.node = f.node AND p.i = f.i AND p.rel = k.rel"""


SHARED.update({
    "rel1": _relation_blocks("f0"),
    "relsign": f"""
        SELECT i, j, CASE h % 6 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS s
        FROM (SELECT a.i, b.j, ('0x' || substr(md5('1|' || a.i || '|' || b.j || '|42'), 1, 8))::BIGINT AS h
              FROM range({DIM * (len(RELATIONS) + 1)}) a(i), range({DIM}) b(j))""",
    "relmid": f"SELECT r.node, s.j AS i, greatest(sum(r.v * s.s) * sqrt(3.0 / {DIM}), 0.0) AS v FROM {{rel1}} r JOIN {{relsign}} s ON s.i = r.i GROUP BY r.node, s.j",
    "rel2": _relation_blocks("relmid"),
})


@query("relation_propagation", LONG + "(SELECT node, i AS dim, v AS value FROM {rel2})")
def relation_propagation(t):
    return _long(E.propagate_relations(both_ways(t), signs(t), DIM, RELATIONS))


@query("relation_propagation_one_layer", LONG + "(SELECT node, i AS dim, v AS value FROM {rel1})")
def relation_propagation_one_layer(t):
    return _long(E.propagate_relations(both_ways(t), signs(t), DIM, RELATIONS, layers=1))


def _as_text(walks):
    return walks.select("start", "walk", F.array_join("path", ">").alias("path"))


@query("random_walks", f"""
    SELECT start, walk::INT AS walk, string_agg(node, '>' ORDER BY step) AS path FROM (
        WITH RECURSIVE near AS (SELECT a.src, row_number() OVER (PARTITION BY a.src ORDER BY a.dst) - 1 AS idx, a.dst FROM {{adj}} a),
        w(start, walk, step, node) AS (
            SELECT node, k, 0, node FROM {{deg}}, range({K.WALKS_PER_NODE}) r(k)
            UNION ALL
            SELECT w.start, w.walk, w.step + 1, n.dst FROM w JOIN {{deg}} d ON d.node = w.node
                 JOIN near n ON n.src = w.node AND n.idx = ('0x' || substr(md5(w.start || '|' || w.walk || '|' || (w.step + 1) || '|42'), 1, 8))::BIGINT % d.degree
            WHERE w.step < {K.WALK_LENGTH - 1})
        SELECT * FROM w) GROUP BY start, walk""")
def random_walks(t):
    return _as_text(E.random_walks(link_graph(t)))


@query("random_walks_second_order")
def random_walks_second_order(t):
    return _as_text(E.random_walks(link_graph(t), p=0.5, q=2.0))


@query("walk_windows", f"""
    SELECT center, context, count(*)::BIGINT AS n FROM (
        SELECT w.start, w.walk, w.pos, w.node AS center, x.node AS context
        FROM (SELECT start, walk, unnest(path) AS node, unnest(range(20)) AS pos FROM {{short_walk}}) w
             JOIN (SELECT start, walk, unnest(path) AS node, unnest(range(20)) AS pos FROM {{short_walk}}) x
             ON w.start = x.start AND w.walk = x.walk AND abs(w.pos - x.pos) BETWEEN 1 AND 5)
    GROUP BY ALL""")
def walk_windows(t):
    return E.window_counts(E.random_walks(link_graph(t), length=20, per_node=2))


@query("neighbour_index", """SELECT a.src, row_number() OVER (PARTITION BY a.src ORDER BY a.dst) - 1 AS idx, a.dst, d.degree::BIGINT AS dst_degree
       FROM {adj} a JOIN {deg} d ON d.node = a.dst""")
def neighbour_index(t):
    return E.indexed_neighbours(link_graph(t))


@query("node2vec")
def node2vec(t):
    return _long(E.node2vec(link_graph(t)))


# --- decoders ------------------------------------------------------------------------------------


def vector_pairs(t):
    """Pairs of consecutive vectors of the embeddings table, with equal class as label."""
    v = t.embeddings
    nodes = v.select(F.col("vec_id").alias("node"), F.col("embedding").alias("vector"))
    nxt = v.select((F.col("vec_id") - 1).alias("src"), F.col("vec_id").alias("dst"), F.col("label").alias("_b"))
    pairs = v.select(F.col("vec_id").alias("src"), F.col("label").alias("_a")).join(nxt, "src")
    return pairs.select("src", "dst", (F.col("_a") == F.col("_b")).cast("int").alias("label")), nodes


VECTOR_PAIRS = """(SELECT a.vec_id AS src, b.vec_id AS dst, (a.label = b.label)::INT AS label, a.embedding AS zu, b.embedding AS zv
                   FROM {nodevec} a JOIN {nodevec} b ON b.vec_id = a.vec_id + 1)"""


@query("dot_decoder", f"SELECT src, dst, label, {r6('list_sum(list_transform(list_zip(zu, zv), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))')} AS score FROM {VECTOR_PAIRS}")
def dot_decoder(t):
    return rounded(D.dot_scores(*vector_pairs(t)))


@query("distmult_decoder", f"""SELECT src, dst, label,
    {r6('list_sum(list_transform(list_zip(zu, zv, range(1, len(zu) + 1)), lambda z: z[1]::DOUBLE * z[2]::DOUBLE / z[3]))')} AS score FROM {VECTOR_PAIRS}""")
def distmult_decoder(t):
    return rounded(D.distmult_scores(*vector_pairs(t), relation=[1.0 / k for k in range(1, 65)]))


def labelled_links(t):
    """Labelled country-product links by year, in the node ids of the link graph."""
    pairs = t.stored("labelled", lambda: Z.labelled(dated_links(t), sampled_negatives(t)))
    return pairs.select(
        G.node_id(F.lit("country"), "src").alias("src"), G.node_id(F.lit("product"), "dst").alias("dst"), "year", "split", "label"
    )


def short_vectors(t):
    return t.stored("fastrp", lambda: E.fastrp(link_graph(t), DIM))


def _fitted_scores(t, name):
    pairs, vectors = labelled_links(t), short_vectors(t)
    fitted = D.fit_decoder(name, pairs.where("split = 'train'"), vectors, DIM)
    return fitted.score(pairs.where("split = 'test'").select("src", "dst", "label"), vectors)


@query("distmult_fit")
def distmult_fit(t):
    return _fitted_scores(t, "distmult")


@query("mlp_fit")
def mlp_fit(t):
    return _fitted_scores(t, "mlp")


@query("embedding_baseline")
def embedding_baseline(t):
    return _fitted_scores(t, "embedding")


@query("link_predictor")
def link_predictor(t):
    """Scores of every open cell of the last training year."""
    opened = O.open_products(complexity_table(t)).where(F.col("year") == YEAR)
    candidates = opened.select(G.node_id(F.lit("country"), "iso3").alias("src"), G.node_id(F.lit("product"), "hs4").alias("dst"))
    return D.link_scores(both_ways(t), encoder_features(t), labelled_links(t), candidates, "sage", "distmult", 2 * DIM, samples=K.NEIGHBOUR_SAMPLES)


ENCODERS = ["sage", "gcn", "rgcn", "fastrp", "node2vec"]


@query("model_selection")
def model_selection(t):
    return D.select_model(both_ways(t), encoder_features(t), labelled_links(t), 2 * DIM, ENCODERS, samples=K.NEIGHBOUR_SAMPLES)[-1]


SHARED.update({
    "feature_input": f"""
        SELECT 'country' AS kind, 'country:' || c.iso3 AS node, coalesce(c.region::VARCHAR, '') AS label,
               [ln(1 + w.gdp), ln(1 + w.gdp_pc), ln(1 + w.population), k.eci, h.k::DOUBLE] AS numbers,
               [0.0::DOUBLE, (c.iso3 IN ('N02', 'N09'))::INT::DOUBLE, (c.iso3 IN ('N01', 'N02', 'N03'))::INT::DOUBLE] AS flags
        FROM {{countries}} c LEFT JOIN (SELECT * FROM {{indicator_wide}} WHERE year = {YEAR}) w USING (iso3)
             LEFT JOIN (SELECT year, iso3, eci FROM {{ecic}} WHERE year = {YEAR}) k USING (iso3)
             LEFT JOIN (SELECT * FROM {{kc}} WHERE year = {YEAR}) h USING (iso3)
        UNION ALL
        SELECT 'product', 'product:' || p.hs4, coalesce(s.code::VARCHAR, ''), [q.pci, u.k::DOUBLE], []::DOUBLE[]
        FROM {{products}} p LEFT JOIN {{sections}} s ON substr(p.hs4, 1, 2)::INT BETWEEN s.hs2_from AND s.hs2_to
             LEFT JOIN (SELECT * FROM {{pcie}} WHERE year = {YEAR}) q USING (hs4)
             LEFT JOIN (SELECT * FROM {{kp}} WHERE year = {YEAR}) u USING (hs4)""",
    "feature_mean": """
        SELECT *, avg(x) OVER (PARTITION BY kind, dim) AS mean
        FROM (SELECT kind, node, unnest(range(len(numbers))) AS dim, unnest(numbers) AS x FROM {feature_input})""",
    "feature_scaled": """
        SELECT node, dim, CASE WHEN dev > 0 THEN (coalesce(x, mean) - mean) / dev ELSE 0 END AS value
        FROM (SELECT *, stddev_samp(coalesce(x, mean)) OVER (PARTITION BY kind, dim) AS dev FROM {feature_mean})""",
    # One column a label, and one for labels not seen in training.
    "feature_label": """
        SELECT kind, label, row_number() OVER (PARTITION BY kind ORDER BY label) - 1 AS place, count(*) OVER (PARTITION BY kind) AS n
        FROM (SELECT DISTINCT kind, label FROM {feature_input})""",
})


@query("node_features", f"""SELECT node, dim::INT AS dim, {r6('value')} AS value FROM (
    SELECT node, dim, value FROM {{feature_scaled}}
    UNION ALL SELECT f.node, len(f.numbers) + l.place, (l.label = f.label)::INT FROM {{feature_input}} f JOIN {{feature_label}} l ON l.kind = f.kind
    UNION ALL SELECT f.node, len(f.numbers) + l.n, 0 FROM {{feature_input}} f JOIN {{feature_label}} l ON l.kind = f.kind AND l.label = f.label
    UNION ALL SELECT f.node, len(f.numbers) + l.n + 1 + unnest(range(len(f.flags))), unnest(f.flags)
              FROM {{feature_input}} f JOIN {{feature_label}} l ON l.kind = f.kind AND l.label = f.label)""")
def node_features(t):
    return _long(reduce(DataFrame.unionByName, [df for df, _ in feature_tables(t)]), 6)


def feature_tables(t):
    """(features, width) of countries and products in the last training year."""
    m = presence_table(t).where(F.col("year") == YEAR)
    countries = country_node_table(t).join(C.diversity(m).drop("year"), "iso3", "left")
    products = product_node_table(t).join(C.ubiquity(m).select(F.col("hs4").alias("hs_code"), "ubiquity"), "hs_code", "left")
    of_country = G.fit_features(
        countries, sizes=["gdp", "gdp_pc", "population"], numbers=["eci", "diversity"], categories=["region"],
        flags=["landlocked", "eu_member", "cefta_member"],
    )
    of_product = G.fit_features(products, numbers=["pci", "ubiquity"], categories=["section"])
    return [(G.assemble_features(countries, of_country, "iso3", "country"), of_country.width),
            (G.assemble_features(products, of_product, "hs_code", "product"), of_product.width)]


def encoder_features(t, dim=2 * DIM):
    """Node features of all nodes of the link graph, brought to ``dim`` numbers."""
    def build():
        rows, width = G.join_features(feature_tables(t), link_graph(t).select(F.col("src").alias("node")))
        return E.project(rows, width, dim)

    return t.stored(f"encoder-features-{dim}", build)


@query("features_with_embeddings", LONG + f"(SELECT node, i AS dim, v AS value FROM {{f0}} UNION ALL SELECT node, {DIM} + i, v FROM {{frp}})")
def features_with_embeddings(t):
    vectors = short_vectors(t)
    return _long(G.append_embeddings(signs(t), vectors, DIM))


# --- gravity -------------------------------------------------------------------------------------


@query("flow_covariates", """SELECT f.year, f.reporter_iso3, f.partner_iso3, f.hs4, f.flow, f.value, g.dist, g.gdp_o, g.gdp_d
       FROM {flows} f LEFT JOIN {gravity} g ON g.year = f.year AND g.iso3_o = f.reporter_iso3 AND g.iso3_d = f.partner_iso3""")
def flow_covariates(t):
    return Y.attach_covariates(t.flows, t.gravity).select(
        "year", "reporter_iso3", "partner_iso3", "hs4", "flow", "value", "dist", "gdp_o", "gdp_d"
    )


TRAINING = range(1995, YEAR + 1)
COVARIATES = {**{f"ln_{c}": f"ln({c})" for c in Y.LOGGED}, **{c: c for c in Y.PLAIN}}


def fitted_gravity(t):
    flows, gravity = t.stored("flows", lambda: t.flows), t.stored("gravity", lambda: t.gravity)
    return Y.fit_gravity(flows, gravity, TRAINING), flows, gravity


@query("gravity_fit")
def gravity_fit(t):
    fitted, flows, gravity = fitted_gravity(t)
    return rounded(Y.predict_gravity(fitted, flows, gravity, [YEAR + 1], YEAR))


SHARED["gravity_rows"] = f"""
    SELECT g.*, coalesce(f.v, 0.0) AS y FROM {{gravity}} g
    LEFT JOIN (SELECT year, reporter_iso3 AS iso3_o, partner_iso3 AS iso3_d, sum(value) AS v FROM {{flows}} WHERE flow = 'X' GROUP BY ALL) f
              USING (year, iso3_o, iso3_d)
    WHERE year <= {YEAR} AND iso3_o <> iso3_d AND {' AND '.join(f'{c} > 0' for c in Y.LOGGED)}"""


@query("gravity_score_equations", f"""
    {' UNION ALL '.join(f"SELECT '{n}' AS covariate, {r6(f'sum(y * {x}) / sum(y)')} AS weighted_mean FROM {{gravity_rows}}" for n, x in COVARIATES.items())}
    UNION ALL SELECT 'total', {r('sum(y)', 2)} FROM {{gravity_rows}}""")
def gravity_score_equations(t):
    """What the fit must reproduce: the total of the flows, and the mean of each covariate weighted by them."""
    fitted, _, gravity = fitted_gravity(t)
    rows = Y.design(gravity, TRAINING).join(Y.predict_pairs(fitted, gravity, TRAINING), ["iso3_o", "iso3_d", "year"])
    mean = lambda n: F.round(F.sum(F.col("predicted_value") * F.col(n)) / F.sum("predicted_value"), 6)
    cells = [F.struct(F.lit(n).alias("covariate"), mean(n).alias("weighted_mean")) for n in COVARIATES]
    cells.append(F.struct(F.lit("total").alias("covariate"), F.round(F.sum("predicted_value"), 2).alias("weighted_mean")))
    return rows.agg(F.array(*cells).alias("c")).select(F.inline("c"))


@query("gravity_pairs", f"SELECT iso3_o, iso3_d, year, {r('predicted_value', 2)} AS predicted_value FROM {{mu}}")
def gravity_pairs(t):
    return rounded(Y.predict_pairs(COEFFICIENTS, t.gravity, [YEAR + 1]))


@query("gravity_prediction", f"SELECT reporter_iso3, partner_iso3, hs4, year, {r('predicted_value', 2)} AS predicted_value FROM {{mu_hs}}")
def gravity_prediction(t):
    return rounded(Y.predict_gravity(COEFFICIENTS, t.flows, t.gravity, [YEAR + 1], YEAR))


# --- evaluation ----------------------------------------------------------------------------------


def scored(t):
    """Open cells of one year scored by two baselines, labelled by the year after."""
    table = complexity_table(t)
    later = table.where(F.col("year") == YEAR + 1).select("iso3", "hs4", F.col("mcp").alias("label"))
    opened = O.open_products(table).where((F.col("year") == YEAR) & F.col("density").isNotNull()).join(later, ["iso3", "hs4"])
    models = F.array(
        F.struct(F.lit("density").alias("model"), F.round("density", 8).alias("score")),
        F.struct(F.lit("ubiquity").alias("model"), F.col("ubiquity").cast("double").alias("score")),
    )
    return t.stored("scored", lambda: opened.select(
        F.inline(models), F.col("iso3").alias("src"), F.col("hs4").alias("dst"), "label"
    ))


def density_scored(t):
    return scored(t).where("model = 'density'").drop("model")


@query("score_curve", f"SELECT model, score, pos::BIGINT AS pos, neg::BIGINT AS neg, tp::BIGINT AS tp, fp::BIGINT AS fp FROM {{curve}}")
def score_curve(t):
    return V.curve(scored(t), ["model"])


@query("roc_auc", f"SELECT model, {r('value')} AS roc_auc FROM {{metric}} WHERE metric = 'roc_auc'")
def roc_auc(t):
    return rounded(V.roc_auc(scored(t), ["model"]))


@query("average_precision", f"SELECT model, {r('value')} AS average_precision FROM {{metric}} WHERE metric = 'average_precision'")
def average_precision(t):
    return rounded(V.average_precision(scored(t), ["model"]))


@query("precision_at_k", f"SELECT {r('value')} AS precision FROM {{metric}} WHERE metric = 'precision' AND k = 50 AND model = 'density'")
def precision_at_k(t):
    return rounded(V.precision_at_k(density_scored(t), 50))


@query("recall_at_k", f"SELECT model, {r('value')} AS recall FROM {{metric}} WHERE metric = 'recall' AND k = 50")
def recall_at_k(t):
    return rounded(V.recall_at_k(scored(t), 50, ["model"]))


@query("mrr", f"SELECT {r('value')} AS mrr FROM {{metric}} WHERE metric = 'mrr' AND model = 'density'")
def mrr(t):
    return rounded(V.mrr(density_scored(t)))


@query("mrr_per_source", f"SELECT model, {r('avg(1.0::DOUBLE / n)')} AS mrr FROM {{rank_src}} WHERE label = 1 GROUP BY model")
def mrr_per_source(t):
    return rounded(V.mrr(scored(t), ["model"], ["src"]))


@query("hits_at_k", f"SELECT model, {r('value')} AS hits FROM {{metric}} WHERE metric = 'hits' AND k = 10")
def hits_at_k(t):
    return rounded(V.hits_at_k(scored(t), 10, ["model"]))


@query("hits_per_source", f"SELECT model, {r('avg(CASE WHEN n <= 10 THEN 1.0::DOUBLE ELSE 0 END)')} AS hits FROM {{rank_src}} WHERE label = 1 GROUP BY model")
def hits_per_source(t):
    return rounded(V.hits_at_k(scored(t), 10, ["model"], ["src"]))


@query("all_metrics", f"SELECT model, metric, k, {r('value')} AS value FROM {{metric}}")
def all_metrics(t):
    return rounded(V.all_metrics(scored(t), (10, 20, 50), ["model"]))


def metric_table(t):
    return t.stored("metrics", lambda: V.all_metrics(scored(t), (10, 20, 50), ["model"]))


@query("model_comparison", f"SELECT model, {r('roc_auc')} AS roc_auc, {r('average_precision')} AS average_precision, {r('mrr')} AS mrr FROM {{wide}} ORDER BY average_precision DESC, model")
def model_comparison(t):
    return rounded(V.compare_models(metric_table(t).where("k IS NULL"), METRICS))


@query("ablation", f"""
    SELECT w.model, w.model = 'density' AS heterogeneous, {r('w.roc_auc')} AS roc_auc, {r('w.average_precision')} AS average_precision,
           {r('w.mrr')} AS mrr, {r('w.roc_auc - b.roc_auc')} AS delta_roc_auc,
           {r('w.average_precision - b.average_precision')} AS delta_average_precision, {r('w.mrr - b.mrr')} AS delta_mrr
    FROM {{wide}} w, (SELECT * FROM {{wide}} WHERE model = 'ubiquity') b""")
def ablation(t):
    results = metric_table(t).where("k IS NULL").withColumn("heterogeneous", F.col("model") == "density")
    return rounded(V.ablation(results, METRICS, "ubiquity", ["heterogeneous"]))


@query("hit_test", f"""SELECT s.model, s.src, s.dst, (m.hs4 IS NOT NULL)::INT AS hit FROM {{scored}} s
       LEFT JOIN (SELECT DISTINCT iso3, hs4 FROM {{m}} WHERE year > {YEAR}) m ON m.iso3 = s.src AND m.hs4 = s.dst""")
def hit_test(t):
    later = presence_table(t).where(F.col("year") > YEAR).select(F.col("iso3").alias("src"), F.col("hs4").alias("dst"))
    return V.hit_test(scored(t).select("model", "src", "dst"), later, ["src", "dst"])


@query("temporal_validation", f"""
    SELECT model, k.k::INT AS k, count(m.hs4)::BIGINT AS hits, {r('count(m.hs4)::DOUBLE / k.k')} AS hit_rate
    FROM {{rank_all}} s JOIN (VALUES (10), (50), (200)) k(k) ON s.n <= k.k
         LEFT JOIN (SELECT DISTINCT iso3, hs4 FROM {{m}} WHERE year > {YEAR}) m ON m.iso3 = s.src AND m.hs4 = s.dst GROUP BY model, k.k""")
def temporal_validation(t):
    later = presence_table(t).where(F.col("year") > YEAR).select(F.col("iso3").alias("src"), F.col("hs4").alias("dst"))
    return rounded(V.temporal_validation(V.with_rank(scored(t), ["model"]), later, ["src", "dst"], [10, 50, 200], ["model"]))


# --- opportunities -------------------------------------------------------------------------------


@query("density_baseline", f"""SELECT year, iso3, hs4, {r('density')} AS density, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY year, iso3 ORDER BY {r('density')} DESC NULLS LAST, hs4)::INT AS rank FROM {{outlook}} WHERE mcp = 0)
    WHERE rank <= 50""")
def density_baseline(t):
    return O.density_baseline(complexity_table(t).withColumn("density", F.round("density", 8)))


@query("cog_baseline", f"""SELECT year, iso3, hs4, {r6('cog')} AS cog_score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY year, iso3 ORDER BY {r6('cog')} DESC NULLS LAST, hs4)::INT AS rank FROM {{outlook}} WHERE mcp = 0)
    WHERE rank <= 50""")
def cog_baseline(t):
    return O.cog_baseline(complexity_table(t).withColumn("cog", F.round("cog", 6)))


@query("product_opportunities", f"""
    SELECT o.hs4, p.product_name, {r('o.density')} AS score, row_number() OVER (ORDER BY {r('o.density')} DESC NULLS LAST, o.hs4)::INT AS rank,
           {r('o.density')} AS density, {r6('o.pci')} AS pci
    FROM {{outlook}} o LEFT JOIN {{products}} p USING (hs4) WHERE o.iso3 = '{FOCUS}' AND o.year = {YEAR} AND o.mcp = 0
    ORDER BY rank LIMIT 50""")
def product_opportunities(t):
    table = complexity_table(t).withColumns({"density": F.round("density", 8), "pci": F.round("pci", 6)})
    return O.rank_products(table, t.products, FOCUS, YEAR)


@query("market_opportunities", f"""
    SELECT c.hs4, p.product_name, c.partner_iso3, n.country_name AS partner_name, {r6('coalesce(d.score, 0.0)')} AS score,
           row_number() OVER (ORDER BY coalesce(d.score, 0.0) DESC, c.hs4, c.partner_iso3)::INT AS rank, {r('g.predicted_value', 2)} AS gravity_pred
    FROM (SELECT m.hs4, k.iso3 AS partner_iso3 FROM {{m}} m, {{countries}} k
          WHERE m.iso3 = '{FOCUS}' AND m.year = {YEAR} AND k.iso3 <> '{FOCUS}'
            AND (m.hs4, k.iso3) NOT IN (SELECT hs4, partner_iso3 FROM {{flows}} WHERE flow = 'X' AND year = {YEAR} AND reporter_iso3 = '{FOCUS}')) c
         LEFT JOIN {{demand}} d USING (hs4, partner_iso3) LEFT JOIN {{products}} p USING (hs4)
         LEFT JOIN {{countries}} n ON n.iso3 = c.partner_iso3
         LEFT JOIN (SELECT hs4, partner_iso3, predicted_value FROM {{mu_hs}} WHERE reporter_iso3 = '{FOCUS}') g
                   ON g.hs4 = c.hs4 AND g.partner_iso3 = c.partner_iso3
    ORDER BY rank LIMIT 50""")
def market_opportunities(t):
    flows, gravity = t.stored("flows", lambda: t.flows), t.stored("gravity", lambda: t.gravity)
    predicted = Y.predict_gravity(COEFFICIENTS, flows, gravity, [YEAR + 1], YEAR)
    return rounded(O.rank_markets(complexity_table(t), flows, t.countries, t.products, FOCUS, YEAR, gravity=predicted, gravity_year=YEAR + 1))


SHARED["affinity"] = f"""
    SELECT a.node AS a, b.node AS b, {r6('sum(a.v * b.v)')} AS score FROM {{frp}} a JOIN {{frp}} b ON a.i = b.i
    WHERE a.node LIKE 'country:%' AND b.node LIKE 'product:%' GROUP BY ALL"""


def affinity(t, links):
    """Links (src, dst) scored by the decoder without weights on the projected link graph, rounded for comparison."""
    return D.dot_scores(links, short_vectors(t)).withColumn("score", F.round("score", 6))


@query("product_opportunities_by_model", f"""
    SELECT o.hs4, p.product_name, a.score, row_number() OVER (ORDER BY a.score DESC NULLS LAST, o.hs4)::INT AS rank,
           {r('o.density')} AS density, {r6('o.pci')} AS pci
    FROM {{outlook}} o LEFT JOIN {{products}} p USING (hs4) LEFT JOIN {{affinity}} a ON a.a = 'country:{FOCUS}' AND a.b = 'product:' || o.hs4
    WHERE o.iso3 = '{FOCUS}' AND o.year = {YEAR} AND o.mcp = 0
    ORDER BY rank LIMIT 50""")
def product_opportunities_by_model(t):
    table = complexity_table(t)
    opened = O.open_products(table).where((F.col("iso3") == FOCUS) & (F.col("year") == YEAR))
    links = opened.select("hs4", G.node_id(F.lit("country"), "iso3").alias("src"), G.node_id(F.lit("product"), "hs4").alias("dst"))
    return rounded(O.rank_products(table, t.products, FOCUS, YEAR, scores=affinity(t, links)))


@query("market_opportunities_by_model", f"""
    SELECT c.hs4, p.product_name, c.partner_iso3, n.country_name AS partner_name, coalesce(a.score, 0.0) AS score,
           row_number() OVER (ORDER BY coalesce(a.score, 0.0) DESC, c.hs4, c.partner_iso3)::INT AS rank, NULL::DOUBLE AS gravity_pred
    FROM (SELECT m.hs4, k.iso3 AS partner_iso3 FROM {{m}} m, {{countries}} k
          WHERE m.iso3 = '{FOCUS}' AND m.year = {YEAR} AND k.iso3 <> '{FOCUS}'
            AND (m.hs4, k.iso3) NOT IN (SELECT hs4, partner_iso3 FROM {{flows}} WHERE flow = 'X' AND year = {YEAR} AND reporter_iso3 = '{FOCUS}')) c
         LEFT JOIN {{affinity}} a ON a.a = 'country:' || c.partner_iso3 AND a.b = 'product:' || c.hs4
         LEFT JOIN {{products}} p USING (hs4) LEFT JOIN {{countries}} n ON n.iso3 = c.partner_iso3
    ORDER BY rank LIMIT 50""")
def market_opportunities_by_model(t):
    flows = t.stored("flows", lambda: t.flows)
    wanted = O.market_candidates(complexity_table(t), flows, t.countries, FOCUS, YEAR)
    links = wanted.select("hs4", "partner_iso3", G.node_id(F.lit("country"), "partner_iso3").alias("src"), G.node_id(F.lit("product"), "hs4").alias("dst"))
    return rounded(O.rank_markets(complexity_table(t), flows, t.countries, t.products, FOCUS, YEAR, scores=affinity(t, links)))


@query("density_explanation", f"""
    SELECT o.year, o.iso3, o.hs4, f.hs4_i AS because_hs4, {r('f.proximity / s.s')} AS contribution
    FROM {{outlook}} o JOIN {{phi}} f ON f.year = o.year AND f.hs4_j = o.hs4
         JOIN {{m}} m ON m.year = o.year AND m.iso3 = o.iso3 AND m.hs4 = f.hs4_i JOIN {{phisum}} s ON s.year = o.year AND s.hs4 = o.hs4
    WHERE o.iso3 = '{FOCUS}' AND o.year = {YEAR} AND o.mcp = 0""")
def density_explanation(t):
    links = O.open_products(complexity_table(t)).where((F.col("iso3") == FOCUS) & (F.col("year") == YEAR))
    return rounded(O.explain_density(presence_table(t), proximity_table(t), links))


@query("linear_explanation", f"""
    SELECT src, dst, 'd' || (z[3] - 1) AS feature, {r('z[1]::DOUBLE * z[2]::DOUBLE / z[3]')} AS contribution
    FROM (SELECT src, dst, unnest(list_zip(zu, zv, range(1, len(zu) + 1))) AS z FROM {VECTOR_PAIRS})""")
def linear_explanation(t):
    pairs = D.pair_vectors(*vector_pairs(t)).withColumn("x", D.hadamard_features())
    return rounded(O.explain_linear(pairs, "x", [1.0 / k for k in range(1, 65)], [f"d{k}" for k in range(64)]))


@query("product_space", f"""
    SELECT f.year, f.hs4_i, f.hs4_j, {r('f.proximity')} AS proximity, a.section AS section_i, b.section AS section_j,
           (f.hs4_i IN ('1010', '2002') OR f.hs4_j IN ('1010', '2002')) AS highlight
    FROM {{phi}} f LEFT JOIN {{products}} a ON a.hs4 = f.hs4_i LEFT JOIN {{products}} b ON b.hs4 = f.hs4_j WHERE f.hs4_i < f.hs4_j""")
def product_space(t):
    return rounded(O.product_space(proximity_table(t), t.products, ["1010", "2002"]))


@query("top_opportunities", f"""
    SELECT hs4, score FROM (SELECT hs4, {r('max(density)')} AS score FROM {{outlook}} WHERE mcp = 0 AND year = {YEAR} GROUP BY hs4)
    ORDER BY score DESC NULLS LAST, hs4 LIMIT 20""")
def top_opportunities(t):
    best = O.open_products(complexity_table(t)).where(F.col("year") == YEAR).groupBy("hs4").agg(
        F.round(F.max("density"), 8).alias("score")
    )
    return O.top_opportunities(best, 20)
