import datetime as dt

from pyspark.sql import functions as F

from tradelattice.operators import complexity as C, graph as G
from tradelattice.plans.views import Tables
from tradelattice.sources import indicators, slices, tables


def test_slices_by_name(spark, tmp_path):
    folder = str(tmp_path)
    rows = spark.createDataFrame([(807, "X", 2020, "0101", 1.0), (807, "X", 2021, "0101", 2.0)], "r int, f string, y int, cmdCode string, v double")
    rows.where("y = 2020").coalesce(1).write.parquet(f"{folder}/807_X_2020_hs4_p0.parquet")
    rows.where("y = 2021").withColumn("extra", F.lit("e")).coalesce(1).write.parquet(f"{folder}/807_X_2021_hs4_p0.parquet")
    rows.coalesce(1).write.parquet(f"{folder}/807_X_2020_hs4_pall.parquet")
    got = slices.read_slices(spark, folder, "totals")
    assert got.count() == 2 and "extra" in got.columns
    keys = slices.with_slice_keys(slices.read_slices(spark, folder, "bilateral")).select("slice_reporter", "slice_flow", "slice_year", "slice_level", "slice_partner").distinct()
    assert [tuple(r) for r in keys.collect()] == [("807", "X", 2020, 4, "all")]
    for family in slices.PARTNERS:
        none = slices.read_slices(spark, str(tmp_path / "none"), family)
        assert none.count() == 0 and "cmdCode" in none.columns


def test_slices_chosen_by_name_open_only_their_files(spark, tmp_path):
    folder = str(tmp_path)
    rows = [(r, f, y, r * 10.0) for r in (8, 80, 807) for f in "XM" for y in (2019, 2020)]
    slices.write_slices(spark.createDataFrame(rows, "r int, f string, y int, v double"), folder, "r", "f", "y", 4, "all")
    got = slices.read_slices(spark, folder, "bilateral", reporters=[8, 807], flows=["M"], years=[2020])
    assert sorted(r.v for r in got.collect()) == [80.0, 8070.0]
    assert {p.rsplit("/", 2)[1] for p in got.inputFiles()} == {"slice=8_M_2020_hs4_pall.parquet", "slice=807_M_2020_hs4_pall.parquet"}
    assert slices.read_slices(spark, folder, "bilateral", reporters=["80"]).count() == 4
    assert slices.read_slices(spark, folder, "bilateral", years=[1999]).count() == 0


def test_rewriting_a_slice_keeps_the_others(spark, tmp_path):
    folder = str(tmp_path / "s")
    df = spark.createDataFrame([(807, "X", 2020, 1.0), (807, "X", 2021, 2.0)], "r int, f string, y int, v double")
    slices.write_slices(df, folder, "r", "f", "y", 4, "all")
    slices.write_slices(df.where("y = 2021").withColumn("v", F.lit(9.0)), folder, "r", "f", "y", 4, "all")
    assert sorted(r.v for r in slices.read_slices(spark, folder, "bilateral").collect()) == [1.0, 9.0]


def test_unlisted_reporters_count_as_available(spark):
    want = slices.requested_slices(spark.createDataFrame([("A",), ("B",)], "reporter string"), ["X"], (2020, 2021))
    available = spark.createDataFrame([("A", 2020)], "reporter string, year int")
    loaded = spark.createDataFrame([("B", "X", 2021)], "reporter string, flow string, year int")
    got = sorted(tuple(r) for r in slices.missing_slices(want, loaded, available).collect())
    assert got == [("A", "X", 2020), ("B", "X", 2020)]
    assert slices.missing_slices(want, loaded).count() == 3


def test_payloads(spark):
    good = '[{"page":1},[{"countryiso3code":"MKD","date":"2020","value":1.5},{"countryiso3code":"","date":"2020","value":2},' \
           '{"countryiso3code":"ALB","date":"x","value":2},{"countryiso3code":"ALB","date":"2020","value":null}]]'
    df = spark.createDataFrame([("gdp", good), ("gdp", '[{"message":"none"}]'), ("gdp", "[{},null]"), ("gdp", "junk")], "indicator string, payload string")
    assert [tuple(r) for r in indicators.parse_payloads(df).collect()] == [("MKD", 2020, "gdp", 1.5)]


def test_saving(spark, tmp_path):
    rows = [(2020, c, p, 1.0 + i * j) for i, c in enumerate(["AAA", "BBB", "CCC"]) for j, p in enumerate(["0101", "0201", "0301"])]
    result = C.compute_complexity(spark.createDataFrame(rows, "year int, iso3 string, hs4 string, export_value double"))
    assert tables.save_complexity(result, str(tmp_path), result.proximity.limit(0)) == ["complexity", "country_complexity", "product_complexity", "density_matrix"]
    assert "proximity_matrix" in tables.save_complexity(result, str(tmp_path), result.proximity)
    assert spark.read.parquet(str(tmp_path / "complexity")).count() == 9


def test_materialise_builds_once(spark, tmp_path):
    path, calls = str(tmp_path / "m"), []

    def build():
        calls.append(1)
        return spark.range(3)

    assert tables.materialise(spark, path, build).count() == tables.materialise(spark, path, build).count() == 3
    assert calls == [1]


def test_unique_nodes(spark):
    import pytest

    nodes = spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    assert [tuple(r) for r in G.duplicates(nodes, ["k"]).collect()] == [("a", 2)]
    with pytest.raises(ValueError, match="duplicate keys"):
        G.require_unique(nodes, ["k"])
    edges = spark.createDataFrame([("a", "b"), ("a", "z")], "src string, dst string")
    assert [r.dst for r in G.dangling(edges, "dst", nodes, "k").collect()] == ["z"]


def test_stored_tables_follow_their_inputs(spark, tmp_path):
    folder = str(tmp_path / "tables")
    spark.createDataFrame([(1, "a")], "n_nationkey long, n_name string").write.parquet(f"{folder}/nation.parquet")
    count = lambda: Tables(spark, folder).stored("names", lambda: Tables(spark, folder).nation.select("n_name")).count()
    assert count() == 1 == count()
    spark.createDataFrame([(1, "a"), (2, "b")], "n_nationkey long, n_name string").write.mode("overwrite").parquet(f"{folder}/nation.parquet")
    assert count() == 2


def test_views_of_lines_are_read_from_their_written_form(spark, tmp_path):
    """Lines, orders and customers are read once for each view, however often it is used; keys may repeat or be null."""
    folder = str(tmp_path)
    for name, rows, schema in [
        ("supplier", [(1, 0), (2, 1), (2, 1), (None, 2)], "s_suppkey long, s_nationkey long"),
        ("part", [(1, "LARGE", "Brand#11"), (2, "PROMO", "Brand#12")], "p_partkey long, p_type string, p_brand string"),
        ("customer", [(1, 1), (2, 0), (2, 2)], "c_custkey long, c_nationkey long"),
        ("orders", [(1, 1, dt.date(1999, 1, 1), 5.0), (2, 2, dt.date(1999, 1, 1), 7.0), (3, None, None, None)],
         "o_orderkey long, o_custkey long, o_orderdate date, o_totalprice double"),
        ("lineitem", [(o, p, s, dt.date(1999, 3, 1), 10.25) for o in (1, 2, 3, None) for p in (1, 2) for s in (1, 2, None)],
         "l_orderkey long, l_partkey long, l_suppkey long, l_shipdate date, l_extendedprice double"),
    ]:
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    t = Tables(spark, folder)
    for name, raw in [("exports", "lineitem"), ("shipments", "lineitem"), ("economy", "orders"), ("flows", "lineitem")]:
        assert not any(raw in path for path in getattr(t, name).inputFiles())
    exports = {(r.iso3, r.hs4): r.export_value for r in t.exports.collect()}
    assert exports == {("N00", "2011"): 41.0, ("N01", "2011"): 82.0, ("N00", "4012"): 41.0, ("N01", "4012"): 82.0}
    assert t.exports.columns == ["year", "iso3", "hs4", "export_value"]
    shipped = {(r.o, r.d, r.hs4): r.value for r in t.shipments.collect()}
    assert shipped == {(o, d, p): v for p in ("2011", "4012") for o, d, v in [(0, 1, 10.25), (0, 2, 10.25), (1, 0, 20.5), (1, 2, 20.5)]}
    assert {(r.iso3, r.gdp, r.population) for r in t.economy.collect()} == {("N01", 5.0, 1.0), ("N00", 7.0, 1.0), ("N02", 7.0, 1.0)}
