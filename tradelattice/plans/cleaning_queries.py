"""Queries for sources, cleaning, joins, aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradelattice.functions import constants as K, scalars as S
from tradelattice.operators import cleaning as P, profiles as A
from tradelattice.operators.ordering import top_k, top_k_per
from tradelattice.plans.registry import SHARED, query, r, rounded
from tradelattice.session import scratch_path
from tradelattice.sources import indicators, slices, tables

YEARS = (1996, 2000)
FOCUS = "N03"


def _in(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


def _pad(c: str) -> str:
    return f"CASE WHEN length({c}) < 4 THEN lpad({c}, 4, '0') ELSE {c} END"


SHARED.update({
    "c_exports": f"""
        SELECT year::INT AS year, country_iso3_code AS iso3, {_pad('product_hs92_code')} AS hs4,
               coalesce(try_cast(export_value AS DOUBLE), 0.0) AS export_value,
               try_cast(import_value AS DOUBLE) AS import_value, try_cast(distance AS DOUBLE) AS density
        FROM {{raw_exports}}
        WHERE year::INT BETWEEN {YEARS[0]} AND {YEARS[1]} AND length(country_iso3_code) = 3
              AND country_iso3_code NOT IN ({_in(K.EXPORT_AGGREGATES)})
              AND regexp_full_match({_pad('product_hs92_code')}, '[0-9]{{{{4}}}}')""",
    "codes": """
        SELECT m49, country_name, iso3, iso2 FROM (
            SELECT *, row_number() OVER (PARTITION BY iso3 ORDER BY contains(country_name, '...'), m49) AS n
            FROM (SELECT *, row_number() OVER (PARTITION BY m49 ORDER BY src, iso3, country_name) AS k FROM (
                SELECT 0 AS src, reporterCode AS m49, reporterDesc AS country_name, reporterCodeIsoAlpha3 AS iso3,
                       reporterCodeIsoAlpha2 AS iso2 FROM {raw_reporters} WHERE NOT isGroup
                UNION ALL SELECT 1, partnerCode, partnerDesc, partnerCodeIsoAlpha3, partnerCodeIsoAlpha2
                FROM {raw_partners} WHERE NOT isGroup))
            WHERE k = 1 AND iso3 <> '') WHERE n = 1""",
    "mapped": f"""
        SELECT f.period::INT AS year, r.iso3 AS reporter_iso3, p.iso3 AS partner_iso3, f.cmdCode AS hs_code,
               f.flowCode AS flow,
               coalesce(f.primaryValue, CASE WHEN f.flowCode = 'X' THEN f.fobvalue ELSE f.cifvalue END) AS value
        FROM {{raw_flows}} f LEFT JOIN {{codes}} r ON f.reporterCode = r.m49 LEFT JOIN {{codes}} p ON f.partnerCode = p.m49
        WHERE f.reporterCode NOT IN ({_in(K.AGGREGATE_M49)}) AND f.partnerCode NOT IN ({_in(K.AGGREGATE_M49)})""",
    "c_flows": f"""
        SELECT year, reporter_iso3, partner_iso3, {_pad('hs_code')} AS hs4, flow, coalesce(value, 0.0) AS value
        FROM {{mapped}} WHERE reporter_iso3 IS NOT NULL AND partner_iso3 IS NOT NULL
             AND regexp_full_match({_pad('hs_code')}, '[0-9]{{{{4}}}}')""",
    "c_totals": f"""
        SELECT t.Period::INT AS year, c.iso3, {_pad('t.cmdCode')} AS hs4, coalesce(t.fobvalue, 0.0) AS export_value
        FROM {{raw_totals}} t JOIN {{codes}} c ON t.reporterCode = c.m49
        WHERE regexp_full_match({_pad('t.cmdCode')}, '[0-9]{{{{4}}}}')""",
    "indicators": """SELECT * FROM {wdi_long} WHERE iso3 <> 'N06' AND iso3 <> 'N05'""",
    "indicator_wide": """
        SELECT iso3, year, max(CASE WHEN indicator = 'gdp' THEN value END) AS gdp,
               max(CASE WHEN indicator = 'gdp_pc' THEN value END) AS gdp_pc,
               max(CASE WHEN indicator = 'population' THEN value END) AS population
        FROM {indicators} GROUP BY ALL""",
})


def codes(t):
    return P.country_codes(t.raw_reporters, t.raw_partners)


def cleaned_exports(t):
    return P.clean_exports(t.raw_exports, YEARS)


def payloads(t):
    """Indicator payloads as an API returns them: one per indicator and year, with gaps, and one without records."""
    rows = t.wdi_long.select(
        "indicator", "year",
        F.struct(
            F.when(F.col("iso3") == "N06", "").otherwise(F.col("iso3")).alias("countryiso3code"),
            F.col("year").cast("string").alias("date"),
            F.when(F.col("iso3") != "N05", F.col("value")).alias("value"),
        ).alias("record"),
    )
    full = rows.groupBy("indicator", "year").agg(F.collect_list("record").alias("records")).select(
        "indicator", F.concat(F.lit('[{"page":1},'), F.to_json("records"), F.lit("]")).alias("payload")
    )
    bare = t.wdi_long.select("indicator").distinct().withColumn("payload", F.lit('[{"message":"no data"}]'))
    return full.unionByName(bare)


# --- sources and sinks ---------------------------------------------------------------------------


REQUIRED = ["Period", "reporterCode", "cmdCode", "primaryValue", "reporterISO", "fobvalue"]


@query("required_columns", f"""
    SELECT name, name IN (SELECT column_name FROM (DESCRIBE SELECT * FROM {{raw_totals}})) AS present
    FROM (SELECT unnest({REQUIRED}) AS name)""")
def required_columns(t):
    lost = P.missing_columns(t.raw_totals, REQUIRED)
    return t.spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(c not in lost).alias("present")) for c in REQUIRED])))


@query("csv_exports", f"SELECT * FROM {{c_exports}}")
def csv_exports(t):
    path = scratch_path(t.spark, "exports-csv")
    t.raw_exports.write.option("header", True).csv(path)
    return tables.read_exports(t.spark, path, YEARS)


@query("csv_gravity", f"""
    SELECT year, iso3_o, iso3_d, dist, contig, comlang_off, comcol, fta_wto, gdp_o, gdp_d, pop_o, pop_d, contig AS colony
    FROM {{gravity}} WHERE year BETWEEN {YEARS[0]} AND {YEARS[1]}""")
def csv_gravity(t):
    path = scratch_path(t.spark, "gravity-csv")
    wide = t.gravity.withColumn("col45", F.col("contig")).withColumns(
        {f"unused_{k}": F.col("dist") * k for k in range(5)}
    )
    wide.write.option("header", True).csv(path)
    return tables.read_gravity(t.spark, path, YEARS)


@query("slice_scan", "SELECT Period AS \"Period\", reporterCode AS \"reporterCode\", cmdCode AS \"cmdCode\", fobvalue FROM {raw_totals}")
def slice_scan(t):
    folder = scratch_path(t.spark, "slices")
    slices.write_slices(t.raw_totals.withColumn("flow", F.lit("X")), folder, "reporterCode", "flow", "Period", 4, "0")
    return slices.read_slices(t.spark, folder, "totals").select("Period", "reporterCode", "cmdCode", "fobvalue")


@query("slice_keys", """
    SELECT reporterCode::STRING AS slice_reporter, flowCode AS slice_flow, period::INT AS slice_year,
           4::INT AS slice_level, 'all' AS slice_partner, count(*)::BIGINT AS n
    FROM {raw_flows} GROUP BY ALL""")
def slice_keys(t):
    folder = scratch_path(t.spark, "slices")
    slices.write_slices(t.raw_flows, folder, "reporterCode", "flowCode", "period", 4, "all")
    df = slices.with_slice_keys(slices.read_slices(t.spark, folder, "bilateral"))
    return df.groupBy("slice_reporter", "slice_flow", "slice_year", "slice_level", "slice_partner").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("slice_coverage", """
    SELECT c.iso3 AS reporter, f.flow, y.year::INT AS year
    FROM {countries} c, (VALUES ('X'), ('M')) f(flow), range(1994, 2003) y(year)
    WHERE (c.iso3 NOT IN (SELECT iso3 FROM {exports}) OR (c.iso3, y.year) IN (SELECT iso3, year FROM {exports}))
      AND (c.iso3, f.flow, y.year) NOT IN (SELECT reporter_iso3, flow, year FROM {flows} WHERE year < 1998)""")
def slice_coverage(t):
    wanted = slices.requested_slices(t.countries.withColumnRenamed("iso3", "reporter"), ["X", "M"], (1994, 2002))
    available = t.exports.select(F.col("iso3").alias("reporter"), "year").distinct()
    loaded = t.flows.where("year < 1998").select(F.col("reporter_iso3").alias("reporter"), "flow", "year").distinct()
    return slices.missing_slices(wanted, loaded, available)


@query("indicator_payloads", "SELECT * FROM {indicators}")
def indicator_payloads(t):
    return indicators.parse_payloads(payloads(t))


@query("saved_table", "SELECT year, iso3, hs4, export_value FROM {exports}")
def saved_table(t):
    path = scratch_path(t.spark, "saved")
    tables.save(t.exports, path)
    return t.spark.read.parquet(path).select("year", "iso3", "hs4", "export_value")


@query("materialised", "SELECT * FROM {countries}")
def materialised(t):
    path = scratch_path(t.spark, "materialised")
    tables.materialise(t.spark, path, lambda: t.countries)
    return tables.materialise(t.spark, path, lambda: t.countries.where("iso3 IS NULL"))


# --- projections and filters ---------------------------------------------------------------------


@query("rename_present", "SELECT iso3 AS country, hs4, year, export_value FROM {exports}")
def rename_present(t):
    return P.rename_present(t.exports, {"iso3": "country", "absent": "other"})


@query("rename_any_case", """SELECT period AS year, reporterCode AS reporter_m49, partnerCode AS partner_m49,
       cmdCode AS hs_code, flowCode AS flow, primaryValue AS value, fobvalue AS fob_value, cifvalue AS cif_value
       FROM {raw_flows}""")
def rename_any_case(t):
    return P.rename_any_case(t.raw_flows, K.FLOW_RENAMES)


@query("year_range", f"SELECT * FROM {{exports}} WHERE year BETWEEN {YEARS[0]} AND {YEARS[1]}")
def year_range(t):
    return P.in_years(t.exports, *YEARS)


@query("focus_flows", f"SELECT * FROM {{flows}} WHERE reporter_iso3 = '{FOCUS}' AND flow = 'X' AND year = 1999")
def focus_flows(t):
    return P.focus(t.flows, reporter_iso3=FOCUS, flow="X", year=1999)


@query("valid_countries", f"""SELECT * FROM {{raw_exports}} WHERE length(country_iso3_code) = 3
       AND country_iso3_code NOT IN ({_in(K.EXPORT_AGGREGATES)})""")
def valid_countries(t):
    return P.valid_countries(t.raw_exports, K.EXPORT_AGGREGATES, "country_iso3_code")


@query("drop_aggregate_codes", f"""SELECT * FROM {{raw_flows}} WHERE reporterCode NOT IN ({_in(K.AGGREGATE_M49)})
       AND partnerCode NOT IN ({_in(K.AGGREGATE_M49)})""")
def drop_aggregate_codes(t):
    return P.drop_aggregate_m49(t.raw_flows, "reporterCode", "partnerCode")


@query("hs_codes", f"""SELECT year, {_pad('product_hs92_code')} AS hs4, count(*)::BIGINT AS n FROM {{raw_exports}}
       WHERE regexp_full_match({_pad('product_hs92_code')}, '[0-9]{{{{4}}}}') GROUP BY ALL""")
def hs_codes(t):
    return P.normalise_hs(t.raw_exports, "product_hs92_code").groupBy("year", "hs4").agg(F.count(F.lit(1)).alias("n"))


@query("numeric_values", """SELECT product_id, year::INT AS year, country_iso3_code,
       try_cast(export_value AS DOUBLE) AS export_value FROM {raw_exports}""")
def numeric_values(t):
    df = S.to_whole(S.to_numeric(t.raw_exports, ["export_value", "absent"]), ["year"])
    return df.select("product_id", "year", "country_iso3_code", "export_value")


@query("fill_zero", "SELECT period, reporterCode AS \"reporterCode\", coalesce(primaryValue, 0.0) AS \"primaryValue\" FROM {raw_flows}")
def fill_zero(t):
    return P.fill_zero(t.raw_flows, "primaryValue").select("period", "reporterCode", "primaryValue")


@query("drop_incomplete", """SELECT year, country_iso3_code, export_value FROM {raw_exports}
       WHERE country_iso3_code IS NOT NULL AND export_value IS NOT NULL""")
def drop_incomplete(t):
    return P.drop_incomplete(t.raw_exports.select("year", "country_iso3_code", "export_value"))


@query("trade_value", """SELECT period AS year, flowCode AS flow, cmdCode AS hs_code,
       coalesce(primaryValue, CASE WHEN flowCode = 'X' THEN fobvalue ELSE cifvalue END) AS value FROM {raw_flows}""")
def trade_value(t):
    return P.trade_value(P.rename_any_case(t.raw_flows, K.FLOW_RENAMES)).select("year", "flow", "hs_code", "value")


@query("country_codes", "SELECT m49, country_name, iso3, iso2 FROM {codes}")
def country_codes(t):
    return codes(t)


@query("member_flags", """SELECT iso3, iso3 IN ('N01', 'N02', 'N03') AS cefta_member, iso3 IN ('N02', 'N09') AS eu_member
       FROM {countries}""")
def member_flags(t):
    sets = {"cefta_member": ["N01", "N02", "N03"], "eu_member": ["N02", "N09"]}
    return P.member_flags(t.countries, sets).select("iso3", *sets)


@query("keep_present", "SELECT year, iso3, hs4 FROM {exports}")
def keep_present(t):
    return P.keep_present(t.exports, ["year", "iso3", "hs4", "absent"])


@query("clean_exports", "SELECT * FROM {c_exports}")
def clean_exports(t):
    return cleaned_exports(t)


@query("clean_flows", "SELECT * FROM {c_flows}")
def clean_flows(t):
    return P.clean_flows(t.raw_flows, codes(t))


@query("clean_totals", "SELECT * FROM {c_totals}")
def clean_totals(t):
    return P.clean_totals(t.raw_totals, codes(t))


@query("hs_rollup", """SELECT year, iso3, substr(hs4, 1, 2) AS hs4, sum(export_value::DECIMAL(18,2))::DOUBLE AS export_value
       FROM {exports} GROUP BY ALL""")
def hs_rollup(t):
    return rounded(P.hs_rollup(t.exports, 2, ["year", "iso3"], "export_value"), 2)


# --- joins ---------------------------------------------------------------------------------------


@query("code_join", "SELECT * FROM {mapped}")
def code_join(t):
    return P.map_flows(t.raw_flows, codes(t)).select(
        "year", "reporter_iso3", "partner_iso3", "hs_code", "flow", "value"
    )


@query("unmatched_codes", """SELECT count(*) FILTER (reporter_iso3 IS NULL)::BIGINT AS unmatched_reporter_iso3,
       count(*) FILTER (partner_iso3 IS NULL)::BIGINT AS unmatched_partner_iso3 FROM {mapped}""")
def unmatched_codes(t):
    return P.unmatched(P.map_flows(t.raw_flows, codes(t)), "reporter_iso3", "partner_iso3")


@query("strict_lookup", """SELECT e.year, e.hs4, c.m49, c.country_name FROM {exports} e JOIN {codes} c USING (iso3)""")
def strict_lookup(t):
    table = codes(t)
    df = t.exports.withColumn("iso3", F.lower("iso3"))
    df = P.lookup_codes(P.lookup_codes(df, table, "iso3", "m49"), table, "iso3", "country_name")
    return df.select("year", "hs4", "m49", "country_name")


@query("lookup_iso3", "SELECT f.period, f.flowCode AS \"flowCode\", c.iso3 FROM {raw_flows} f LEFT JOIN {codes} c ON f.reporterCode = c.m49")
def lookup_iso3(t):
    df = P.lookup_codes(t.raw_flows, codes(t), "m49", "iso3", source="reporterCode", strict=False)
    return df.select("period", "flowCode", "iso3")


@query("merge_indicators", """
    SELECT iso3, year, max(CASE WHEN indicator = 'gdp' AND iso3 <> 'N01' THEN value END) AS gdp,
           max(CASE WHEN indicator = 'population' AND year > 1996 THEN value END) AS population
    FROM {wdi_long} WHERE (indicator = 'gdp' AND iso3 <> 'N01') OR (indicator = 'population' AND year > 1996)
    GROUP BY ALL""")
def merge_indicators(t):
    gdp = t.wdi_long.where("indicator = 'gdp' AND iso3 <> 'N01'").select("iso3", "year", F.col("value").alias("gdp"))
    people = t.wdi_long.where("indicator = 'population' AND year > 1996").select(
        "iso3", "year", F.col("value").alias("population")
    )
    return A.merge_indicators([gdp, people])


# --- aggregates ----------------------------------------------------------------------------------


@query("total_by_product", "SELECT year, hs4, sum(export_value::DECIMAL(18,2))::DOUBLE AS export_value FROM {exports} GROUP BY ALL")
def total_by_product(t):
    return rounded(A.total_by(t.exports, ["year", "hs4"], "export_value"), 2)


@query("total_by_partner", "SELECT partner_iso3, sum(value::DECIMAL(18,2))::DOUBLE AS value FROM {flows} WHERE flow = 'X' GROUP BY ALL")
def total_by_partner(t):
    return rounded(A.total_by(t.flows.where("flow = 'X'"), ["partner_iso3"], "value"), 2)


@query("benchmark_gap", f"""SELECT sum(export_value::DECIMAL(18,2))::DOUBLE AS total,
       {r('(sum(export_value::DECIMAL(18,2))::DOUBLE - 8e9) / 8e9 * 100', 6)} AS gap_pct FROM {{exports}}""")
def benchmark_gap(t):
    df = A.benchmark_gap(t.exports, "export_value")
    return df.select(F.round("total", 2).alias("total"), F.round("gap_pct", 6).alias("gap_pct"))


@query("table_profile", """SELECT count(*)::BIGINT AS n_rows, count(DISTINCT reporter_iso3)::BIGINT AS countries,
       count(DISTINCT hs4)::BIGINT AS products, count(DISTINCT partner_iso3)::BIGINT AS partners,
       min(year) AS first_year, max(year) AS last_year FROM {flows}""")
def table_profile(t):
    return A.profile(t.flows, {"countries": "reporter_iso3", "products": "hs4", "partners": "partner_iso3"})


@query("latest_year", "SELECT iso3, max(year) AS year FROM {exports} GROUP BY ALL")
def latest_year(t):
    return A.latest_year(t.exports, ["iso3"])


@query("latest_rows", "SELECT e.* FROM {exports} e JOIN (SELECT iso3, max(year) AS year FROM {exports} GROUP BY ALL) USING (iso3, year)")
def latest_rows(t):
    return A.in_latest_year(t.exports, ["iso3"])


@query("one_per_key", "SELECT DISTINCT hs4, section FROM {products}")
def one_per_key(t):
    labelled = t.exports.join(t.products.select("hs4", "section"), "hs4")
    return A.one_per_key(labelled, ["hs4"], ["section"]).unionByName(
        t.products.join(t.exports, "hs4", "left_anti").select("hs4", "section")
    )


@query("indicator_table", "SELECT * FROM {indicator_wide}")
def indicator_table(t):
    return indicators.indicator_table(payloads(t))


SHARED["own_now"] = f"""SELECT * FROM {{exports}} WHERE iso3 = '{FOCUS}'
    AND year = (SELECT max(year) FROM {{exports}} WHERE iso3 = '{FOCUS}')"""


@query("validation_report", f"""
    SELECT 'latest_year' AS item, NULL AS label, max(year)::DOUBLE AS value FROM {{exports}} WHERE iso3 = '{FOCUS}'
    UNION ALL SELECT 'total_exports', NULL, sum(export_value::DECIMAL(18,2))::DOUBLE FROM {{own_now}}
    UNION ALL SELECT 'benchmark_gap_pct', NULL, {r('(sum(export_value::DECIMAL(18,2))::DOUBLE - 8e9) / 8e9 * 100', 2)} FROM {{own_now}}
    UNION ALL SELECT * FROM (SELECT 'top_product', hs4, sum(export_value::DECIMAL(18,2))::DOUBLE AS v FROM {{own_now}}
                             GROUP BY hs4 ORDER BY v DESC, hs4 LIMIT 10)
    UNION ALL SELECT * FROM (SELECT 'top_market', partner_iso3, sum(value::DECIMAL(18,2))::DOUBLE AS v FROM {{flows}}
                             WHERE reporter_iso3 = '{FOCUS}' AND flow = 'X' AND year = (SELECT max(year) FROM {{own_now}})
                             GROUP BY partner_iso3 ORDER BY v DESC, partner_iso3 LIMIT 10)""")
def validation_report(t):
    return rounded(A.validation_report(t.exports, t.flows, FOCUS), 2)


@query("validation_report_missing", "SELECT 'error' AS item, 'no QQQ data' AS label, NULL::DOUBLE AS value")
def validation_report_missing(t):
    return A.validation_report(t.exports, t.flows, "QQQ")


# --- order and sets ------------------------------------------------------------------------------


@query("top_products", f"""SELECT hs4, sum(export_value::DECIMAL(18,2))::DOUBLE AS export_value FROM {{exports}}
       GROUP BY hs4 ORDER BY 2 DESC, hs4 LIMIT 10""")
def top_products(t):
    totals = A.total_by(t.exports, ["hs4"], "export_value")
    return rounded(top_k(totals, [F.desc("export_value"), F.asc("hs4")], 10), 2)


@query("top_products_per_country", """
    SELECT * FROM (SELECT year, iso3, hs4, export_value,
                          row_number() OVER (PARTITION BY year, iso3 ORDER BY export_value DESC, hs4)::INT AS rank
                   FROM {exports}) WHERE rank <= 5""")
def top_products_per_country(t):
    return top_k_per(t.exports, ["year", "iso3"], [F.desc("export_value"), F.asc("hs4")], 5)


@query("union_slices", """SELECT year, iso3, hs4, export_value, NULL AS flow FROM {exports}
       UNION ALL SELECT year, reporter_iso3, hs4, NULL, flow FROM {flows}""")
def union_slices(t):
    early, late = t.exports.where("year < 1998"), t.exports.where("year >= 1998")
    other = t.flows.select("year", F.col("reporter_iso3").alias("iso3"), "hs4", "flow")
    return P.union_slices(early, late, other)


@query("supplement", f"""
    SELECT year, iso3, hs4, export_value FROM {{c_exports}}
    UNION ALL SELECT t.year, t.iso3, t.hs4, t.export_value FROM {{c_totals}} t
              WHERE NOT EXISTS (SELECT 1 FROM {{c_exports}} e WHERE e.year = t.year AND e.iso3 = t.iso3 AND e.hs4 = t.hs4)""")
def supplement(t):
    primary = cleaned_exports(t).select("year", "iso3", "hs4", "export_value")
    return P.supplement(primary, P.clean_totals(t.raw_totals, codes(t)), ["year", "iso3", "hs4"])
