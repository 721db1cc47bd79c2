import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradelattice.operators import blocks as B, complexity as C


def matrix_rows():
    """Four countries by five products with every third cell empty, and one key twice."""
    rows = [(2020, f"K{c}", f"{10 * p + 7:04d}", float(1 + (c * 7 + p * 5) % 11) * 10 ** p) for c in range(4) for p in range(5) if (c + 2 * p) % 3]
    return [*rows, (2020, "K1", "0007", 250.0)]


@pytest.fixture(scope="module")
def trade(spark):
    return spark.createDataFrame(matrix_rows(), "year int, iso3 string, hs4 string, export_value double")


@pytest.fixture(scope="module")
def presence(spark):
    rng = np.random.default_rng(7)
    rows = [(y, f"C{c:02d}", f"{p:04d}") for y in (2000, 2001) for c in range(17) for p in range(40) if rng.random() < 0.15 + 0.04 * (c % 9)]
    return spark.createDataFrame(rows, "year int, iso3 string, hs4 string").cache()


def dense(presence, year):
    rows = presence.where(F.col("year") == year).collect()
    cs, ps = sorted({r.iso3 for r in rows}), sorted({r.hs4 for r in rows})
    m = np.zeros((len(cs), len(ps)))
    for r in rows:
        m[cs.index(r.iso3), ps.index(r.hs4)] = 1
    return cs, ps, m


def test_fixture(trade):
    rows = C.compute_complexity(trade, year=2020).table.collect()
    assert len(rows) == 20
    assert all(r.rca is None or r.rca >= 0 for r in rows)
    assert {r.mcp for r in rows} <= {0, 1, None}
    duplicate = [r for r in rows if (r.iso3, r.hs4) == ("K1", "0007")]
    assert len(duplicate) == 1 and duplicate[0].export_value == 258.0


def test_zero_totals_are_null(spark):
    df = spark.createDataFrame([(2020, "AAA", "0101", 0.0), (2020, "BBB", "0101", 5.0)], "year int, iso3 string, hs4 string, export_value double")
    got = {r.iso3: (r.rca, r.mcp) for r in C.mcp(C.rca(C.trade_cells(df))).collect()}
    assert got == {"AAA": (None, None), "BBB": (1.0, 1)}


@pytest.mark.parametrize("blocks", [(1, 1), (3, 2), (2, 5)])
def test_proximity_in_blocks(presence, blocks):
    axes = C.Axes(17, 40, *blocks)
    got = {(r.year, r.hs4_i, r.hs4_j): r.proximity for r in C.proximity(presence, axes).collect()}
    want = {}
    for year in (2000, 2001):
        _, ps, m = dense(presence, year)
        n, k = m.T @ m, m.sum(0)
        for i, j in itertools.permutations(range(len(ps)), 2):
            if n[i, j] > 0:
                want[(year, ps[i], ps[j])] = n[i, j] / max(k[i], k[j])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert all(0 < v <= 1 and abs(got[(y, j, i)] - v) < 1e-12 for (y, i, j), v in got.items())


def test_masked_product(spark):
    rng = np.random.default_rng(3)
    a, b = (rng.random((30, 20)) < 0.3) * rng.random((30, 20)), (rng.random((20, 25)) < 0.3) * rng.random((20, 25))
    rows = lambda m: [(f"x{i}", f"y{j}", float(m[i, j])) for i, j in zip(*np.nonzero(m))]
    left = spark.createDataFrame(rows(a), "r string, w string, v double")
    right = spark.createDataFrame([(x.replace("x", "y"), y.replace("y", "z"), v) for x, y, v in rows(b)], "w string, c string, v double")
    mask = spark.createDataFrame([(f"x{i}", f"z{j}") for i in range(0, 30, 2) for j in range(0, 25, 3)], "r string, c string")
    out = B.block_product(left, right, keys=[], row="r", inner="w", column="c", value="v", outputs={"s": "v"}, blocks=(3, 2, 4), mask=mask)
    got = {(r.r, r.c): r.s for r in out.collect()}
    product = a @ b
    want = {(f"x{i}", f"z{j}"): product[i, j] for i in range(0, 30, 2) for j in range(0, 25, 3) if product[i, j] != 0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_grid_is_complete(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "k int, r string")
    cols = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "z")], "k int, c string")
    got = sorted(tuple(r) for r in B.grid(rows, cols, ["k"], "r", "c", 3).collect())
    assert got == [(1, "a", "x"), (1, "a", "y"), (1, "b", "x"), (1, "b", "y"), (2, "a", "x"), (2, "a", "z")]


def test_eci_is_the_second_eigenvector(presence):
    got = {(r.year, r.iso3): (r.eci_raw, r.eci) for r in C.eci(presence).collect()}
    for year in (2000, 2001):
        cs, _, m = dense(presence, year)
        kc, kp = m.sum(1), m.sum(0)
        w = (m / kp) @ m.T / kc[:, None]
        x = np.array([got[(year, c)][0] for c in cs])
        values = np.sort(np.linalg.eigvals(w).real)[::-1]
        assert np.abs(w @ x - values[1] * x).max() < 1e-9
        z = np.array([got[(year, c)][1] for c in cs])
        assert abs(z.mean()) < 1e-9 and abs(z.std() - 1) < 1e-9
        assert np.corrcoef(z, kc)[0, 1] >= 0


@pytest.fixture(scope="module")
def solved(spark, presence):
    rows = [(r.year, r.iso3, r.hs4, 1.0) for r in presence.collect()]
    return C.compute_complexity(spark.createDataFrame(rows, "year int, iso3 string, hs4 string, export_value double"), threshold=0.9)


def test_density_and_indices(solved):
    rows = solved.table.collect()
    assert all(r.density is None or -1e-12 <= r.density <= 1 + 1e-12 for r in rows)
    assert all((r.cog is None) == (r.mcp != 0) or r.pci is None for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.year, r.iso3), 0)
        by[(r.year, r.iso3)] += r.mcp or 0
    assert all(by[(r.year, r.iso3)] == r.diversity for r in rows)


def test_gain_is_the_outlook_difference(solved):
    """cog_cp is what the outlook index of c rises by when p is added, complexity held fixed."""
    rows = [r for r in solved.table.where("year = 2000").collect()]
    phi = {(r.hs4_i, r.hs4_j): r.proximity for r in solved.proximity.where("year = 2000").collect()}
    ps = sorted({r.hs4 for r in rows})
    f = np.array([[phi.get((i, j), 0.0) for j in ps] for i in ps])
    pci = np.array([next(r.pci for r in rows if r.hs4 == p) or 0.0 for p in ps])
    sums = f.sum(0)

    def outlook(m):
        with np.errstate(invalid="ignore", divide="ignore"):
            density = np.nan_to_num((m @ f) / sums)
        return ((1 - m) * density * pci).sum()

    country = sorted({r.iso3 for r in rows})[4]
    own = {r.hs4: r for r in rows if r.iso3 == country}
    m = np.array([own[p].mcp for p in ps], dtype=float)
    assert abs(outlook(m) - own[ps[0]].coi) < 1e-9
    for k, p in enumerate(ps):
        if m[k] == 0 and own[p].cog is not None:
            more = m.copy()
            more[k] = 1
            assert abs(outlook(more) - outlook(m) - own[p].cog) < 1e-9


def test_product_scores_follow_the_product_side(presence):
    got = {(r.year, r.hs4): r.pci for r in C.pci(presence, C.eci(presence)).collect()}
    cs, ps, m = dense(presence, 2000)
    kc, kp = m.sum(1), m.sum(0)
    values, vectors = np.linalg.eig((m.T / kc) @ m / kp[:, None])
    v = vectors[:, np.argsort(values.real)[::-1][1]].real
    z = np.array([got[(2000, p)] for p in ps])
    assert abs(abs(np.corrcoef(v, z)[0, 1]) - 1) < 1e-9


def by_eigh(m):
    kc, kp = m.sum(1), m.sum(0)
    x = np.linalg.eigh((m / kp) @ m.T / np.sqrt(np.outer(kc, kc)))[1][:, -2] / np.sqrt(kc)
    x = x * np.sign(np.cov(x, kc)[0, 1])
    return (x - x.mean()) / x.std()


def test_long_country_axis(spark):
    """More countries than a block of vectors, close leading eigenvalues, several blocks of pairs."""
    rng = np.random.default_rng(11)
    m = (rng.random((180, 90)) < 0.04 + 0.3 * rng.random((180, 1))).astype(float)
    m[np.arange(180), np.arange(180) % 90] = 1
    rows = spark.createDataFrame([(2000, f"C{c:03d}", f"{p:04d}") for c, p in zip(*np.nonzero(m))], "year int, iso3 string, hs4 string")
    got = {r.iso3: r.eci for r in C.eci(rows, C.Axes(180, 90, 3, 2)).collect()}
    assert max(abs(got[f"C{c:03d}"] - x) for c, x in enumerate(by_eigh(m))) < 1e-8


def test_years_of_one_and_two_countries(spark):
    rows = [(1, "A", "x"), (1, "A", "y"), (2, "A", "x"), (2, "A", "y"), (2, "B", "y"), (3, "A", "x"), (3, "B", "x")]
    rows += [(4, c, p) for c, ps in {"A": "xy", "B": "xz", "C": "yz", "D": "xyz"}.items() for p in ps]
    got = {(r.year, r.iso3): r for r in C.eci(spark.createDataFrame(rows, "year int, iso3 string, hs4 string")).collect()}
    assert (got[1, "A"].eci_raw, got[1, "A"].eci, got[1, "A"].diversity) == (None, None, 2)
    assert abs(got[2, "A"].eci - 1) < 1e-9 and abs(got[2, "B"].eci + 1) < 1e-9
    # Equal diversities leave no correlation: the first country by code is positive.
    assert abs(got[3, "A"].eci - 1) < 1e-9 and abs(got[3, "B"].eci + 1) < 1e-9
    assert {k for k in got if k[0] == 4} == {(4, c) for c in "ABCD"}


def test_unsettled_vectors_raise(presence):
    pairs = C.country_similarity(presence, C.Axes.of(presence))
    with pytest.raises(RuntimeError, match="residual"):
        C.second_vectors(pairs, C.diversity(presence), width=2, degree=2, max_rounds=1)


def test_no_rows_have_no_index(spark):
    assert C.eci(spark.createDataFrame([], "year int, iso3 string, hs4 string"), C.Axes(0, 0, 1, 1)).count() == 0
