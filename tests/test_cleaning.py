import pytest
from pyspark.sql import functions as F

from tradelattice.functions import scalars as S
from tradelattice.operators import cleaning as P, profiles as A

CODES = [(807, "North Macedonia", "MKD", "MK"), (8, "Albania", "ALB", "AL"), (688, "Serbia", "SRB", "RS"), (276, "Germany", "DEU", "DE")]


@pytest.fixture(scope="module")
def codes(spark):
    return spark.createDataFrame(CODES, "m49 int, country_name string, iso3 string, iso2 string")


def raw(spark, rows):
    return spark.createDataFrame(
        rows, "year string, country_iso3_code string, product_hs92_code string, export_value string, export_rca double"
    )


def test_export_fixture(spark):
    rows = [("2011", "ALB", "2716", "41.5e6", 6.1), ("2012", "SRB", "1005", "620000", 4.0), ("2012", "SRB", "401", "17", 0.2),
            ("2012", "EUN", "1005", "8e8", 1.1), ("2011", "ALB", "27-16", "3", 0.4), ("1987", "ALB", "2716", "9", 0.3)]
    out = P.clean_exports(raw(spark, rows))
    assert out.columns[:4] == ["year", "iso3", "hs4", "export_value"]
    got = {(r.iso3, r.hs4): r.export_value for r in out.collect()}
    assert got == {("ALB", "2716"): 41.5e6, ("SRB", "1005"): 620000.0, ("SRB", "0401"): 17.0}


@pytest.mark.parametrize("row, expected", [
    (("2020", None, "0101", "1", 0.0), None),
    (("2020", "WLD", "0101", "1", 0.0), None),
    (("2020", "MK", "0101", "1", 0.0), None),
    (("2020", "MKD", "101", "1", 0.0), ("0101", 1.0)),
    (("2020", "MKD", "12345", "1", 0.0), None),
    (("2020", "MKD", "XXXX", "1", 0.0), None),
    (("2020", "MKD", "0101\n", "1", 0.0), None),
    (("2020", "MKD", "١٢٣٤", "1", 0.0), None),
    (("2020", "MKD", "0101", "abc", 0.0), ("0101", 0.0)),
    (("2020", "MKD", "0101", "1d", 0.0), ("0101", 0.0)),
    (("2020", "MKD", "0101", " 12.5 ", 0.0), ("0101", 12.5)),
    (("2020", "MKD", "0101", None, 0.0), ("0101", 0.0)),
    (("1999", "MKD", "0101", "1", 0.0), None),
    (("2023", "MKD", "0101", "1", 0.0), None),
    (("x", "MKD", "0101", "1", 0.0), None),
])
def test_edge_rows(spark, row, expected):
    out = [(r.hs4, r.export_value) for r in P.clean_exports(raw(spark, [row])).collect()]
    assert out == ([] if expected is None else [expected])


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "v double")
    assert sorted(r.v is None for r in S.to_numeric(df, ["v"]).collect()) == [False, True]


def test_year_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).select(F.col("id").cast("int").alias("year"), F.lit("MKD").alias("iso3"), F.lit("0101").alias("hs4"),
                           F.lit(1.0).alias("export_value")).write.parquet(str(tmp_path / "t"))
    plan = P.clean_exports(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(year,2000)" in plan


def flows(spark, rows):
    return spark.createDataFrame(
        rows, "Period int, reporterCODE int, partnercode string, cmdCode string, flowCode string, fobvalue double, cifvalue double"
    )


def test_flows(spark, codes):
    rows = [(2020, 807, "276", "8703", "X", 5.0, 6.0), (2020, 807, "276", "8703", "M", 5.0, 6.0), (2020, 807, "0", "8703", "X", 1.0, 1.0),
            (2020, 999999, "276", "8703", "X", 1.0, 1.0), (2020, 807, "x", "8703", "X", 1.0, 1.0), (2020, 807, "8", "TOTAL", "X", 1.0, 1.0),
            (2020, 807, "8", "101", "X", None, 1.0)]
    got = sorted(tuple(r) for r in P.clean_flows(flows(spark, rows), codes).collect())
    assert got == [(2020, "MKD", "ALB", "0101", "X", 0.0), (2020, "MKD", "DEU", "8703", "M", 6.0), (2020, "MKD", "DEU", "8703", "X", 5.0)]
    missing = P.unmatched(P.map_flows(flows(spark, rows), codes), "reporter_iso3", "partner_iso3").first()
    assert (missing.unmatched_reporter_iso3, missing.unmatched_partner_iso3) == (1, 0)


def test_missing_columns_raise(spark, codes):
    with pytest.raises(ValueError, match="missing columns"):
        P.clean_flows(spark.createDataFrame([(1,)], "period int"), codes)
    with pytest.raises(ValueError, match="missing columns"):
        P.clean_totals(spark.createDataFrame([(1, 807)], "cmdCode int, reporterCode int"), codes)


def test_value_by_another_name(spark, codes):
    df = spark.createDataFrame([(2020, "MKD", "101", "7")], "period int, reporterISO string, cmdCode string, tradeValue string")
    assert [tuple(r) for r in P.clean_totals(df, codes).collect()] == [(2020, "MKD", "0101", 7.0)]


def test_lookups(spark, codes):
    df = spark.createDataFrame([("mkd",), ("ALB",), ("SRB",), ("DEU",)], "iso3 string")
    got = {r.iso3: r.m49 for r in P.lookup_codes(df, codes, "iso3", "m49").collect()}
    assert got == {"mkd": 807, "ALB": 8, "SRB": 688, "DEU": 276}
    back = P.lookup_codes(spark.createDataFrame([(807,)], "m49 int"), codes, "m49", "iso3")
    assert back.first().iso3 == "MKD"
    for bad in (P.lookup_codes(spark.createDataFrame([("ZZZ",)], "iso3 string"), codes, "iso3", "m49"),
                P.lookup_codes(spark.createDataFrame([(999999,)], "m49 int"), codes, "m49", "iso3")):
        with pytest.raises(Exception, match="no (m49|iso3) for"):
            bad.collect()
    assert P.lookup_codes(spark.createDataFrame([("ZZZ",)], "iso3 string"), codes, "iso3", "m49", strict=False).first().m49 is None


def test_code_table(spark):
    schema = "isGroup boolean, {0}Code int, {0}Desc string, {0}CodeIsoAlpha3 string, {0}CodeIsoAlpha2 string"
    reporters = spark.createDataFrame([(False, 280, "Fed. Rep. of Germany (...1990)", "DEU", "DE"), (False, 276, "Germany", "DEU", "DE"),
                                       (True, 97, "EU", "EUR", "EU")], schema.format("reporter"))
    partners = spark.createDataFrame([(False, 276, "Germany (partner)", "DEU", "DE"), (False, 899, "Areas, nes", None, None),
                                      (False, 290, "Other", "", "")], schema.format("partner"))
    assert [tuple(r) for r in P.country_codes(reporters, partners).collect()] == [(276, "Germany", "DEU", "DE")]


def test_report_for_missing_country(spark):
    empty = spark.createDataFrame([(2020, "DEU", "0101", 1.0)], "year int, iso3 string, hs4 string, export_value double")
    rows = A.validation_report(empty).collect()
    assert [(r["item"], r["label"]) for r in rows] == [("error", "no MKD data")]
