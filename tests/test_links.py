import datetime as dt
import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tradelattice.operators import (
    decoders as D, embeddings as E, evaluation as V, gravity as Y, neighbours as N, ordering as R, splits as Z,
)
from tradelattice.plans import graph_queries
from tradelattice.plans.views import Tables
from tradelattice.session import stage


def scored(spark, pairs):
    return spark.createDataFrame([(f"s{i:03d}", "d", float(s), y) for i, (s, y) in enumerate(pairs)], "src string, dst string, score double, label int")


# --- metrics -------------------------------------------------------------------------------------


def test_perfect_and_constant(spark):
    perfect = scored(spark, [(0.9, 1), (0.8, 1), (0.2, 0), (0.1, 0)])
    assert V.roc_auc(perfect).first().roc_auc == 1.0
    assert V.average_precision(perfect).first().average_precision == 1.0
    assert V.roc_auc(scored(spark, [(0.5, 1), (0.5, 0), (0.5, 1), (0.5, 0)])).first().roc_auc == 0.5


def test_ties(spark):
    tied = scored(spark, [(0.9, 1), (0.5, 0), (0.5, 1), (0.1, 0)])
    assert V.roc_auc(tied).first().roc_auc == pytest.approx(0.875)
    assert V.average_precision(tied).first().average_precision == pytest.approx((1 + 2 / 3) / 2)


def test_one_class_only(spark):
    assert V.roc_auc(scored(spark, [(0.9, 1), (0.5, 1)])).first().roc_auc is None


def test_cut_offs(spark):
    df = scored(spark, [(0.9, 0), (0.8, 1), (0.7, 1), (0.1, 0)])
    assert V.precision_at_k(df, 2).first().precision == 0.5
    assert V.precision_at_k(df, 50).first().precision == 2 / 50
    assert V.recall_at_k(df, 2).first().recall == 0.5
    assert V.mrr(df).first().mrr == pytest.approx((1 / 2 + 1 / 3) / 2)
    assert V.hits_at_k(df, 2).first().hits == 0.5
    for row in V.all_metrics(df, [1, 2, 50]).collect():
        assert 0 <= row.value <= 1


def test_rank_matches_sort_with_a_hot_group(spark):
    rng = np.random.default_rng(1)
    rows = [("hot" if i % 3 else f"g{i % 7}", float(rng.integers(0, 5)), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, s double, k long")
    got = {r.k: r.n for r in R.ranked(df, [F.desc("s"), F.asc("k")], by=["g"], rank="n").collect()}
    seen, want = Counter(), {}
    for g, s, k in sorted(rows, key=lambda x: (x[0], -x[1], x[2])):
        seen[g] += 1
        want[k] = seen[g]
    assert got == want
    total = {r.k: r.t for r in R.running_totals(df, [F.desc("s"), F.asc("k")], {"t": F.col("s")}).collect()}
    acc = 0.0
    for g, s, k in sorted(rows, key=lambda x: (-x[1], x[2])):
        acc += s
        assert total[k] == acc


# --- splits --------------------------------------------------------------------------------------


def test_splits_are_disjoint_and_complete(spark):
    edges = spark.createDataFrame([(f"c{i % 20}", f"p{(i * 7) % 31}", 2017 + i % 6) for i in range(400)], "src string, dst string, year int")
    pos = stage(Z.temporal_split(edges), "pos")
    assert pos.count() == edges.select("src", "dst").distinct().count() == pos.select("src", "dst").distinct().count()
    rand = Z.random_split(edges)
    assert rand.count() == pos.count() and {r.split for r in rand.select("split").distinct().collect()} <= set(Z.SPLITS)
    left = Z.propagation_edges(edges, pos).select("src", "dst").distinct()
    assert left.join(pos.where("split <> 'train'"), ["src", "dst"]).count() == 0


def dated(spark, share, seed=3):
    """Links of 30 sources and 40 targets in six years, each present with the given probability."""
    rng = np.random.default_rng(seed)
    rows = [(f"c{i:02d}", f"p{j:02d}", 2017 + y) for y in range(6) for i in range(30) for j in range(40) if rng.random() < share]
    return stage(Z.temporal_split(spark.createDataFrame(rows, "src string, dst string, year int"), by_year=True), "dated")


@pytest.mark.parametrize("share", [0.02, 0.3, 0.47])
def test_negatives_are_as_many_in_every_split(spark, share):
    pos = dated(spark, share)
    nodes = pos.select("src"), pos.select("dst")
    neg = stage(Z.negatives(pos, *nodes, keys=["year"]), "neg")
    count = lambda df: {r.split: r["count"] for r in df.groupBy("split").count().collect()}
    assert count(neg) == count(pos) and neg.distinct().count() == neg.count()
    assert neg.join(pos, ["src", "dst", "year"]).count() == 0
    years = lambda df: {(r.split, r.year) for r in df.select("split", "year").distinct().collect()}
    assert years(neg) <= years(pos)
    again = Z.negatives(pos.repartition(13), nodes[0].repartition(5), nodes[1], keys=["year"])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, neg.collect()))
    if share < 0.3:
        assert Z.negatives(pos, *nodes, ratio=3, keys=["year"]).count() == 3 * pos.count()


def test_negatives_without_keys_differ_between_splits(spark):
    edges = dated(spark, 0.05)
    pos = stage(Z.temporal_split(edges), "pos")
    neg = stage(Z.negatives(pos, pos.select("src"), pos.select("dst")), "neg")
    assert neg.select("src", "dst").distinct().count() == neg.count() == pos.count()
    assert neg.join(pos, ["src", "dst"]).count() == 0


def test_impossible_negatives_raise(spark):
    pos = dated(spark, 0.6)
    with pytest.raises(ValueError, match="negative links wanted"):
        Z.negatives(pos, pos.select("src"), pos.select("dst"), keys=["year"])
    full = spark.createDataFrame([("a", "x", 2017)], "src string, dst string, year int")
    pos = Z.temporal_split(full, by_year=True)
    with pytest.raises(ValueError, match="0 free"):
        Z.negatives(pos, pos.select("src"), pos.select("dst"), keys=["year"])
    assert Z.negatives(pos.limit(0), pos.select("src"), pos.select("dst"), keys=["year"]).count() == 0


@pytest.mark.parametrize("share", [0.499, 0.6, 1.0])
def test_all_free_negatives_where_links_fill_half_of_the_cells(spark, share):
    """A split that asks for more than are free gets each free link once, the others as many as they have links."""
    pos = dated(spark, share)
    every = {(s.src, d.dst) for s in pos.select("src").distinct().collect() for d in pos.select("dst").distinct().collect()}
    links = {(r.src, r.dst, r.year): r.split for r in pos.collect()}
    neg = Z.negatives(pos, pos.select("src"), pos.select("dst"), keys=["year"], or_all_free=True).collect()
    got = {(r.src, r.dst, r.year): r.split for r in neg}
    assert len(got) == len(neg) and not got.keys() & links.keys()
    for split in Z.SPLITS:
        years = {y for (_, _, y), s in links.items() if s == split}
        free = {(s, d, y) for s, d in every for y in years} - links.keys()
        mine = {link for link, s in got.items() if s == split}
        assert mine <= free and len(mine) == min(len(free), sum(s == split for s in links.values()))


def test_negatives_query_on_dense_trade(spark, tmp_path):
    """Equal exports everywhere: every cell is an advantage, no link is free, and decoders still have their positives."""
    for name, rows, schema in [
        ("nation", [(k, f"NATION_{k}", 0) for k in range(3)], "n_nationkey long, n_name string, n_regionkey long"),
        ("supplier", [(k, k) for k in range(3)], "s_suppkey long, s_nationkey long"),
        ("part", [(k, "LARGE", f"Brand#{k}") for k in range(1, 5)], "p_partkey long, p_type string, p_brand string"),
    ]:
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    lines = [(s, p, dt.date(y, 5, 1), 100.0 + (y == 2001 and s == p)) for s in range(3) for p in range(1, 5) for y in range(1999, 2002)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_shipdate date, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    count = Counter(r.split for r in graph_queries.sampled_negatives(Tables(spark, str(tmp_path))).collect())
    assert count["train"] == count["val"] == 0 < count["test"]


def test_layers_are_sampled_from_the_last_inwards(spark):
    edges = spark.createDataFrame([(f"s{i}", "r" if i % 2 else "q", f"d{j}") for i in range(60) for j in range(3)], "src string, rel string, dst string")
    first, last = Z.sample_layers(edges, [15, 10])
    most = lambda df: {r["count"] for r in df.groupBy("dst", "rel").count().collect()}
    assert (most(first), most(last)) == ({10}, {15})
    features = spark.createDataFrame([(f"s{i}", [float(i)]) for i in range(60)] + [(f"d{j}", [0.0]) for j in range(3)], "node string, vector array<double>")
    got = {r.node: r.vector for r in E.propagate_hops([first, last], features, 1).collect()}
    sampled = {d: [float(r.src[1:]) for r in first.where(F.col("dst") == d).collect()] for d in ("d0", "d1", "d2")}
    assert all(got[d][1] == pytest.approx(np.mean(sampled[d])) for d in sampled)


# --- neighbours and walks ------------------------------------------------------------------------


def graph(spark, pairs):
    both = [(a, b) for a, b in pairs] + [(b, a) for a, b in pairs]
    return spark.createDataFrame(sorted(set(both)), "src string, dst string")


def test_neighbour_scores_by_hand(spark):
    adj = graph(spark, [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y"), ("b", "z"), ("c", "x")])
    cand = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "lonely")], "node_u string, node_v string")
    got = {(r.node_u, r.node_v): r for r in N.neighbour_scores(adj, cand).collect()}
    ab = got[("a", "b")]
    assert ab.cn == 2 and ab.jaccard == pytest.approx(2 / 3)
    assert ab.adamic_adar == pytest.approx(1 / math.log(3) + 1 / math.log(2))
    assert got[("a", "c")].cn == 1 and got[("a", "lonely")].cn == 0 and got[("a", "lonely")].jaccard == 0


def test_neighbour_scores_of_hubs(spark, monkeypatch):
    """Two hubs and many leaves, lists in several parts, against sets."""
    monkeypatch.setattr(N, "EDGES_IN_PART", 7)
    rng = np.random.default_rng(2)
    pairs = [(hub, f"x{i:03d}") for hub in ("h1", "h2") for i in range(90) if rng.random() < 0.7]
    pairs += [(f"x{i:03d}", f"x{j:03d}") for i in range(90) for j in range(i) if rng.random() < 0.03]
    adj = stage(graph(spark, pairs), "adj")
    near: dict = {}
    for r in adj.collect():
        near.setdefault(r.src, set()).add(r.dst)
    names = sorted(near)
    asked = [("h1", "h2")] + [(a, b) for a in names for b in names if a < b and rng.random() < 0.2] + [("x001", "none"), ("none", "gone")]
    got = {(r.node_u, r.node_v): r for r in N.neighbour_scores(adj, spark.createDataFrame(asked, "node_u string, node_v string")).collect()}
    assert got.keys() == set(asked)
    for (a, b), r in got.items():
        shared, either = near.get(a, set()) & near.get(b, set()), near.get(a, set()) | near.get(b, set())
        assert r.cn == len(shared) and r.jaccard == pytest.approx(len(shared) / len(either) if either else 0)
        assert r.adamic_adar == pytest.approx(sum(1 / math.log(len(near[w])) for w in shared))


def test_long_walks_are_put_together(spark):
    adj = stage(graph(spark, [(f"n{i}", f"n{(i * 3 + 1) % 11}") for i in range(11)]), "adj")
    whole = {(r.start, r.walk): r.path for r in E.random_walks(adj, length=23, per_node=3, write_every=100).collect()}
    assert {(r.start, r.walk): r.path for r in E.random_walks(adj, length=23, per_node=3, write_every=4).collect()} == whole
    assert all(len(p) == 23 for p in whole.values())
    second = E.random_walks(adj, length=9, per_node=2, p=0.3, q=3.0, write_every=2).collect()
    assert {(r.start, r.walk): r.path for r in E.random_walks(adj, length=9, per_node=2, p=0.3, q=3.0).collect()} == {(r.start, r.walk): r.path for r in second}


@pytest.mark.parametrize("p, q", [(1.0, 1.0), (0.25, 4.0)])
def test_walks_follow_edges(spark, p, q):
    ring = [(f"n{i}", f"n{(i + 1) % 8}") for i in range(8)] + [("n0", "n4")]
    adj = graph(spark, ring)
    edges = {(r.src, r.dst) for r in adj.collect()}
    walks = E.random_walks(adj, length=6, per_node=5, p=p, q=q).collect()
    assert len(walks) == 40
    for w in walks:
        assert len(w.path) == 6 and w.path[0] == w.start and all(e in edges for e in zip(w.path, w.path[1:]))


def test_second_order_walk_weights(spark):
    """From b after a, with c next to a and d not: weights 1/p, 1, 1/q."""
    adj = stage(graph(spark, [("a", "b"), ("b", "c"), ("b", "d"), ("a", "c")]), "adj")
    p, q = 0.5, 4.0
    index = stage(E.indexed_neighbours(adj), "index")
    walkers = spark.range(4000).select(
        F.lit("a").alias("start"), F.col("id").cast("int").alias("walk"), F.array(F.lit("a"), F.lit("b")).alias("path"),
        F.lit("a").alias("before"), F.lit("b").alias("at"), F.lit(3).cast("bigint").alias("at_degree"),
    )
    for tries in (8, 1):
        moved = E._move_second_order(walkers, index, 2, p, q, 42, tries=tries)
        share = {r["at"]: r["count"] / 4000 for r in moved.groupBy("at").count().collect()}
        total = 1 / p + 1 + 1 / q
        assert share["a"] == pytest.approx(1 / p / total, abs=0.04)
        assert share["c"] == pytest.approx(1 / total, abs=0.04)
        assert share["d"] == pytest.approx(1 / q / total, abs=0.04)


def test_node2vec_covers_every_node(spark):
    adj = graph(spark, [(f"n{i}", f"n{(i * 5 + 1) % 12}") for i in range(12)])
    vectors = E.node2vec(adj, dim=6, length=8, per_node=3).collect()
    nodes = {r.src for r in adj.collect()}
    assert {r.node for r in vectors} == nodes and all(len(r.vector) == 6 for r in vectors)


def test_window_counts_by_hand(spark):
    walks = spark.createDataFrame([("a", 0, ["a", "b", "a", "c"]), ("b", 0, ["b"]), ("c", 0, [])], "start string, walk int, path array<string>")
    want: Counter = Counter()
    for path in (["a", "b", "a", "c"], ["b"], []):
        for i, x in enumerate(path):
            for j, y in enumerate(path):
                if 0 < abs(i - j) <= 2:
                    want[x, y] += 1
    assert {(r.center, r.context): r.n for r in E.window_counts(walks, 2).collect()} == want


@pytest.mark.parametrize("blocks", [1, 3])
def test_skip_gram_finds_planted_groups(spark, blocks):
    """Three cliques joined by single edges: a node's nearest vectors are those of its own clique, however rows are dealt."""
    pairs = [(f"{g}{i:02d}", f"{g}{j:02d}") for g in "abc" for i in range(14) for j in range(i)] + [("a00", "b00"), ("b01", "c01"), ("c02", "a02")]
    walks = stage(E.random_walks(graph(spark, pairs), length=20, per_node=10), "walks")
    counts = stage(E.window_counts(walks), "counts")
    rows = E.skip_gram(counts, 8, blocks=blocks).collect()
    assert len(rows) == 42
    names, v = [r.node for r in rows], np.array([r.vector for r in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = np.argsort(-(v @ v.T), axis=1)[:, 1:14]
    own = np.mean([[names[j][0] == names[i][0] for j in near[i]] for i in range(42)])
    assert own > (0.95 if blocks == 1 else 0.85)
    again = {r.node: r.vector for r in E.skip_gram(counts.repartition(11), 8, blocks=blocks).collect()}
    assert all(again[r.node] == r.vector for r in rows)


def test_gradients_of_lists_and_matrices_agree():
    rng = np.random.default_rng(1)
    u, v = rng.normal(size=(7, 3)), rng.normal(size=(5, 3))
    cells = np.arange(35)
    with_, without = rng.random(35), rng.random(35)
    dense = E._gradient(cells // 5, cells % 5, with_, without, (7, 5))(u, v)
    sparse = E._gradient(cells // 5, cells % 5, with_, without, (700, 5))(np.vstack([u, np.zeros((693, 3))]), v)
    assert np.allclose(dense[0], sparse[0][:7]) and np.allclose(dense[1], sparse[1])


def test_skip_gram_settles_or_raises(spark):
    counts = spark.createDataFrame([("a", "b", 5), ("b", "a", 5), ("a", "c", 1), ("c", "a", 1)], "center string, context string, n long")
    with pytest.raises(RuntimeError, match="did not settle"):
        E.skip_gram(counts, 4, tolerance=-1.0, max_epochs=2, steps=1)
    assert E.skip_gram(counts.limit(0), 4).count() == 0


def test_relation_layers_by_hand(spark):
    nodes = {"a": [1.0, -2.0], "b": [0.5, 3.0], "c": [-1.0, 1.0]}
    edges = [("a", "r", "b"), ("c", "r", "b"), ("b", "q", "a"), ("b", "r", "c")]
    features = spark.createDataFrame(list(nodes.items()), "node string, vector array<double>")
    table = spark.createDataFrame(edges, "src string, rel string, dst string")

    def layer(x):
        mean = lambda n, rel: np.mean([x[s] for s, r, d in edges if d == n and r == rel] or [np.zeros(2)], axis=0)
        return {n: np.concatenate([x[n], mean(n, "r"), mean(n, "q")]) for n in x}

    first = layer({n: np.array(v) for n, v in nodes.items()})
    one = {r.node: r.vector for r in E.propagate_relations(table, features, 2, ["r", "q"], layers=1).collect()}
    assert all(np.allclose(one[n], first[n]) for n in nodes)
    sign = lambda i, j: {0: 1, 1: -1}.get(int(hashlib.md5(f"1|{i}|{j}|42".encode()).hexdigest()[:8], 16) % 6, 0)
    matrix = np.array([[sign(i, j) for j in range(2)] for i in range(6)])
    middle = {n: np.maximum(v @ matrix * math.sqrt(1.5), 0) for n, v in first.items()}
    two = {r.node: r.vector for r in E.propagate_relations(table, features, 2, ["r", "q"]).collect()}
    assert all(np.allclose(two[n], v) for n, v in layer(middle).items())


# --- decoders and gravity ------------------------------------------------------------------------


def test_decoders_learn_a_rule(spark):
    rng = np.random.default_rng(5)
    nodes = [(f"n{i}", [float(x) for x in rng.normal(size=4)]) for i in range(60)]
    vec = dict(nodes)
    pairs = [(f"n{i}", f"n{j}", int(vec[f"n{i}"][0] * vec[f"n{j}"][0] > 0)) for i in range(60) for j in range(60) if i != j and (i + j) % 3 == 0]
    vectors = spark.createDataFrame(nodes, "node string, vector array<double>")
    train = spark.createDataFrame(pairs, "src string, dst string, label int")
    for name, least in (("distmult", 0.95), ("embedding", 0.95), ("mlp", 0.9)):
        fitted = D.fit_decoder(name, train, vectors, 4)
        assert V.roc_auc(fitted.score(train, vectors)).first().roc_auc > least
    fitted = D.fit_decoder("distmult", train, vectors, 4)
    relation = fitted.relation()
    assert abs(relation[0]) > max(abs(x) for x in relation[1:])
    exact = D.distmult_scores(train, vectors, relation)
    assert V.roc_auc(exact).first().roc_auc == pytest.approx(V.roc_auc(fitted.score(train, vectors)).first().roc_auc)


@pytest.mark.parametrize("name", ["distmult", "embedding", "mlp"])
def test_scores_are_those_of_the_fitted_model(spark, name):
    """The column expressions give the probabilities of the Spark ML model they were read from."""
    rng = np.random.default_rng(7)
    vectors = stage(spark.createDataFrame([(f"n{i}", [float(x) for x in rng.normal(size=3)]) for i in range(40)], "node string, vector array<double>"), "v")
    pairs = stage(spark.createDataFrame([(f"n{i}", f"n{j}", int(rng.random() < 0.5)) for i in range(40) for j in range(0, 40, 3) if i != j], "src string, dst string, label int"), "p")
    model = D.fit_model(name, pairs, vectors, 3)
    decoder = D.decoder_of(name, model, 3)
    ml = model.transform(D.model_inputs(name, pairs, vectors)).select("src", "dst", vector_to_array("probability")[1].alias("p"))
    both = decoder.score(pairs, vectors).join(ml, ["src", "dst"]).collect()
    assert len(both) == pairs.count() and max(abs(r.score - r.p) for r in both) < 1e-9
    plan = decoder.score(pairs, vectors)._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan and "Python" not in plan


def test_models_that_share_vectors_share_a_join(spark):
    vectors = stage(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.5, -1.0])], "node string, vector array<double>"), "v")
    pairs = spark.createDataFrame([("a", "b", 1), ("a", "lost", 0)], "src string, dst string, label int")
    one = D.Decoder("distmult", (D.Layer([[1.0, 0.5]], [0.25]),))
    scored = D.score_models({"x+dot_product": (D.Decoder("dot_product"), vectors), "x+distmult": (one, vectors)}, pairs).collect()
    got = {(r.model, r.dst): r.score for r in scored}
    assert got == {("x+dot_product", "b"): -1.5, ("x+dot_product", "lost"): 0.0,
                   ("x+distmult", "b"): pytest.approx(1 / (1 + math.exp(0.25))), ("x+distmult", "lost"): pytest.approx(1 / (1 + math.exp(-0.25)))}


def test_gravity_score_equations(spark):
    rng = np.random.default_rng(9)
    countries = [f"K{i:02d}" for i in range(14)]
    gdp = {c: float(np.exp(rng.normal(3, 1))) for c in countries}
    cov, flows = [], []
    for o in countries:
        for d in countries:
            if o != d:
                dist, contig = float(rng.uniform(1, 20)), float(rng.random() < 0.2)
                cov.append((2019, o, d, dist, contig, 0.0 if rng.random() < 0.5 else 1.0, gdp[o], gdp[d]))
                if rng.random() < 0.9:
                    mu = math.exp(1 - 0.7 * math.log(dist) + 0.8 * math.log(gdp[o]) + 0.5 * math.log(gdp[d]) + 0.4 * contig)
                    flows.append((2019, o, d, "0101", "X", mu * float(rng.gamma(2, 0.5))))
    gravity = spark.createDataFrame(cov, "year int, iso3_o string, iso3_d string, dist double, contig double, comlang_off double, gdp_o double, gdp_d double")
    table = spark.createDataFrame(flows, "year int, reporter_iso3 string, partner_iso3 string, hs4 string, flow string, value double")
    logged, plain = ["dist", "gdp_o", "gdp_d"], ["contig", "comlang_off"]
    beta = Y.fit_gravity(table, gravity, [2019], logged, plain)
    rows = Y.training_rows(table, gravity, [2019], logged, plain)
    assert rows.count() == len(cov)
    both = rows.join(Y.predict_pairs(beta, gravity, [2019], logged, plain), ["iso3_o", "iso3_d", "year"])
    gap = F.col("value") - F.col("predicted_value")
    names = ["ln_dist", "ln_gdp_o", "ln_gdp_d", "contig", "comlang_off"]
    sums = both.agg(F.sum(gap), *[F.sum(gap * F.col(n)) for n in names], F.sum("value")).first()
    assert all(abs(s) / sums[-1] < 1e-9 for s in sums[:-1])
    assert beta["ln_dist"] < 0 < beta["ln_gdp_o"]
    split = Y.predict_gravity(beta, table, gravity, [2019], 2019).agg(F.sum("predicted_value")).first()[0]
    whole = Y.predict_pairs(beta, gravity, [2019]).agg(F.sum("predicted_value")).first()[0]
    assert split == pytest.approx(whole)


def test_gravity_predicts_every_pair(spark):
    schema = "year int, iso3_o string, iso3_d string, dist double, contig double, comlang_off double, gdp_o double, gdp_d double"
    cov = [(2020, "AAA", "BBB", 4.0, 0.0, 1.0, 9.0, 5.0), (2020, "AAA", "CCC", None, 0.0, 0.0, 9.0, 5.0),
           (2020, "BBB", "CCC", 3.0, 0.0, 0.0, 0.0, 5.0), (2020, "CCC", "AAA", 3.0, None, 0.0, 2.0, 5.0),
           (2020, "AAA", "AAA", 1.0, 0.0, 0.0, 9.0, 9.0), (2019, "AAA", "BBB", 4.0, 0.0, 1.0, 9.0, 5.0)]
    beta = {"intercept": 1.0, "ln_dist": -1.0, "ln_gdp_o": 1.0, "ln_gdp_d": 0.0, "contig": 0.0, "comlang_off": 0.0}
    got = {(r.iso3_o, r.iso3_d): r.predicted_value for r in Y.predict_pairs(beta, spark.createDataFrame(cov, schema), [2020]).collect()}
    assert got.keys() == {("AAA", "BBB"), ("AAA", "CCC"), ("BBB", "CCC"), ("CCC", "AAA")}
    assert abs(got.pop(("AAA", "BBB")) - math.e * 9 / 4) < 1e-9 and set(got.values()) == {None}


def gravity_rows(spark, change=lambda row: row):
    rng = np.random.default_rng(4)
    size = {f"K{i}": (float(np.exp(rng.normal(3, 1))), float(np.exp(rng.normal(1, 1)))) for i in range(12)}
    cov, flows = [], []
    for o in size:
        for d in size:
            if o != d:
                flags = [float(rng.random() < share) for share in (0.2, 0.4, 0.3, 0.2, 0.5)]
                dist = float(rng.uniform(1, 20))
                row = change({"o": o, "d": d, "dist": dist, "flags": flags})
                cov.append((2019, o, d, row["dist"], *row["flags"], size[o][0], size[d][0], size[o][1], size[d][1]))
                mu = math.exp(2 - 0.7 * math.log(dist) + 0.4 * math.log(size[o][0]) + 0.5 * row["flags"][0]) * (row.get("flow", 1.0))
                flows.append((2019, o, d, "0101", "X", mu * float(rng.gamma(2, 0.5))))
    names = ["contig", "comlang_off", "comcol", "colony", "fta_wto", "gdp_o", "gdp_d", "pop_o", "pop_d"]
    gravity = spark.createDataFrame(cov, "year int, iso3_o string, iso3_d string, dist double, " + ", ".join(f"{n} double" for n in names))
    return spark.createDataFrame(flows, "year int, reporter_iso3 string, partner_iso3 string, hs4 string, flow string, value double"), gravity


def test_gravity_with_all_covariates(spark):
    table, gravity = gravity_rows(spark)
    beta = Y.fit_gravity(table, gravity, [2019])
    assert set(beta) == {"intercept", *[f"ln_{c}" for c in Y.LOGGED], *Y.PLAIN}
    rows = Y.training_rows(table, gravity, [2019]).join(Y.predict_pairs(beta, gravity, [2019]), ["iso3_o", "iso3_d", "year"])
    gap = F.col("value") - F.col("predicted_value")
    sums = rows.agg(F.sum(gap), *[F.sum(gap * F.col(n)) for n in beta if n != "intercept"], F.sum("value")).first()
    assert all(abs(s) / sums[-1] < 1e-8 for s in sums[:-1])


def test_gravity_says_what_it_cannot_fit(spark):
    with pytest.raises(ValueError, match="one side of .'contig'"):
        Y.fit_gravity(*gravity_rows(spark, lambda r: r | {"flow": 0.0 if r["flags"][0] else 1.0}), [2019])
    twice = Y.fit_gravity(*gravity_rows(spark, lambda r: r | {"flags": [r["flags"][0]] * 2 + r["flags"][2:]}), [2019])
    assert twice["comlang_off"] == 0.0 != twice["contig"]
    with pytest.raises(ValueError, match="no positive flows"):
        Y.fit_gravity(*gravity_rows(spark, lambda r: r | {"flow": 0.0}), [2019])
    flat = Y.fit_gravity(*gravity_rows(spark, lambda r: r | {"flags": [*r["flags"][:4], 1.0]}), [2019])
    assert flat["fta_wto"] == 0.0


def test_gravity_that_does_not_settle_raises(spark, monkeypatch):
    monkeypatch.setattr(Y, "MOST_STEPS", 2)
    with pytest.raises(RuntimeError, match="score equations"):
        Y.fit_gravity(*gravity_rows(spark), [2019])
