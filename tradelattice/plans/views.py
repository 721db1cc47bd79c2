"""The trade domain derived from the test tables, as SQL text both Spark and the checking engine accept.

Country = nation, exporter = the supplier's nation, importer = the customer's nation, product = (type,
brand), year = year of shipment. ``{name}`` stands for another table or view.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tradelattice.session import scratch_path
from tradelattice.sources.tables import materialise

TABLES = ["nation", "region", "supplier", "customer", "part", "orders", "lineitem", "embeddings"]

_HS = """CASE p.p_type WHEN 'ECONOMY' THEN '1' WHEN 'LARGE' THEN '2' WHEN 'MEDIUM' THEN '3' WHEN 'PROMO' THEN '4'
    WHEN 'SMALL' THEN '5' ELSE '6' END || lpad(substr(p.p_brand, 7), 3, '0')"""


def _iso(key: str) -> str:
    return f"'N' || lpad(CAST({key} AS STRING), 2, '0')"


VIEWS = {
    "countries": f"""
        SELECT {_iso('n.n_nationkey')} AS iso3, CAST(n.n_nationkey + 1 AS INT) AS m49, n.n_name AS country_name,
               n.n_regionkey AS region
        FROM {{nation}} n""",
    "products": f"""
        SELECT {_HS} AS hs4, max(p.p_type || ' ' || p.p_brand) AS product_name, max(p.p_type) AS section
        FROM {{part}} p GROUP BY 1""",
    "sections": """
        SELECT substr(hs4, 1, 1) AS code, max(section) AS name, CAST(substr(hs4, 1, 1) || '0' AS INT) AS hs2_from,
               CAST(substr(hs4, 1, 1) || '2' AS INT) AS hs2_to
        FROM {products} GROUP BY 1""",
    # Codes are made on the supplier, part and customer rows, before they meet the lines; money is summed in
    # whole cents, so that the sums are exact in any order.
    "exports": f"""
        SELECT CAST(year(l.l_shipdate) AS INT) AS year, s.iso3, p.hs4,
               CAST(sum(CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS export_value
        FROM {{lineitem}} l
             JOIN (SELECT s_suppkey, {_iso('s_nationkey')} AS iso3 FROM {{supplier}}) s ON l.l_suppkey = s.s_suppkey
             JOIN (SELECT p.p_partkey, {_HS} AS hs4 FROM {{part}} p) p ON l.l_partkey = p.p_partkey
        GROUP BY 1, 2, 3""",
    "shipments": f"""
        SELECT CAST(year(l.l_shipdate) AS INT) AS year, s.s_nationkey AS o, c.c_nationkey AS d, p.hs4,
               CAST(sum(CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS value
        FROM {{lineitem}} l JOIN {{supplier}} s ON l.l_suppkey = s.s_suppkey
             JOIN (SELECT p.p_partkey, {_HS} AS hs4 FROM {{part}} p) p ON l.l_partkey = p.p_partkey
             JOIN {{orders}} r ON l.l_orderkey = r.o_orderkey JOIN {{customer}} c ON r.o_custkey = c.c_custkey
        WHERE s.s_nationkey <> c.c_nationkey
        GROUP BY 1, 2, 3, 4""",
    "flows": f"""
        SELECT year, {_iso('o')} AS reporter_iso3, {_iso('d')} AS partner_iso3, hs4, 'X' AS flow, value FROM {{shipments}}
        UNION ALL
        SELECT year, {_iso('d')} AS reporter_iso3, {_iso('o')} AS partner_iso3, hs4, 'M' AS flow, value FROM {{shipments}}""",
    "economy": f"""
        SELECT c.iso3, CAST(year(r.o_orderdate) AS INT) AS year,
               CAST(sum(CAST(round(r.o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS gdp,
               CAST(count(DISTINCT r.o_custkey) AS DOUBLE) AS population
        FROM {{orders}} r
             JOIN (SELECT c_custkey, {_iso('c_nationkey')} AS iso3 FROM {{customer}}) c ON r.o_custkey = c.c_custkey
        GROUP BY 1, 2""",
    "gravity": """
        SELECT f.year, f.reporter_iso3 AS iso3_o, f.partner_iso3 AS iso3_d,
               CAST(100 * abs(f.ko - f.kd) AS DOUBLE) AS dist,
               CAST(CASE WHEN abs(f.ko - f.kd) = 1 THEN 1 ELSE 0 END AS DOUBLE) AS contig,
               CAST(CASE WHEN a.region = b.region THEN 1 ELSE 0 END AS DOUBLE) AS comlang_off,
               CAST(CASE WHEN f.ko + f.kd IN (7, 16, 31) THEN 1 ELSE 0 END AS DOUBLE) AS comcol,
               CAST(CASE WHEN f.ko * f.kd IN (6, 12, 48, 90) THEN 1 ELSE 0 END AS DOUBLE) AS colony,
               CAST(CASE WHEN a.region + b.region = 4 THEN 1 ELSE 0 END AS DOUBLE) AS fta_wto,
               e.gdp AS gdp_o, g.gdp AS gdp_d, e.population AS pop_o, g.population AS pop_d
        FROM (SELECT DISTINCT year, reporter_iso3, partner_iso3, CAST(substr(reporter_iso3, 2) AS INT) AS ko,
                     CAST(substr(partner_iso3, 2) AS INT) AS kd FROM {flows}) f
             JOIN {countries} a ON f.reporter_iso3 = a.iso3 JOIN {countries} b ON f.partner_iso3 = b.iso3
             LEFT JOIN {economy} e ON f.reporter_iso3 = e.iso3 AND f.year = e.year
             LEFT JOIN {economy} g ON f.partner_iso3 = g.iso3 AND f.year = g.year""",
    "wdi_long": """
        SELECT iso3, year, 'gdp' AS indicator, gdp AS value FROM {economy}
        UNION ALL SELECT iso3, year, 'gdp_pc', gdp / population FROM {economy}
        UNION ALL SELECT iso3, year, 'population', population FROM {economy}""",
    # Raw inputs with every kind of dirt the cleaners handle, placed by rule so that it grows with the data.
    "raw_exports": """
        SELECT CAST(year AS STRING) AS year,
               CASE WHEN iso3 = 'N07' THEN 'WLD' WHEN iso3 = 'N08' THEN NULL WHEN iso3 = 'N09' THEN 'N9' ELSE iso3 END
                   AS country_iso3_code,
               CASE WHEN substr(hs4, 1, 1) = '6' THEN substr(hs4, 2) WHEN hs4 LIKE '101%' THEN hs4 || '5'
                    WHEN hs4 LIKE '302%' THEN 'XXXX' ELSE hs4 END AS product_hs92_code,
               CASE WHEN hs4 LIKE '400%' THEN 'abc' WHEN hs4 LIKE '401%' THEN NULL WHEN hs4 LIKE '402%' THEN '1d'
                    ELSE CAST(CAST(export_value AS DECIMAL(18,2)) AS STRING) END AS export_value,
               CAST(CAST(export_value * 2 AS DECIMAL(18,2)) AS STRING) AS import_value,
               hs4 AS product_id, '0.25' AS distance
        FROM {exports}""",
    "raw_flows": """
        SELECT year AS period, CASE WHEN o = 7 THEN 899 WHEN o = 8 THEN 999999 ELSE o + 1 END AS reporterCode,
               CASE WHEN d = 9 THEN 0 WHEN d = 8 THEN 999999 ELSE d + 1 END AS partnerCode,
               CASE WHEN substr(hs4, 1, 1) = '6' THEN substr(hs4, 2) WHEN hs4 LIKE '302%' THEN 'TOTAL' ELSE hs4 END
                   AS cmdCode, 'X' AS flowCode,
               CASE WHEN hs4 LIKE '400%' THEN NULL ELSE value END AS primaryValue, value AS fobvalue,
               value * 2 AS cifvalue
        FROM {shipments}
        UNION ALL
        SELECT year AS period, d + 1 AS reporterCode, o + 1 AS partnerCode, hs4 AS cmdCode, 'M' AS flowCode,
               CASE WHEN hs4 LIKE '400%' THEN NULL ELSE value END AS primaryValue, value AS fobvalue,
               value * 2 AS cifvalue
        FROM {shipments}""",
    "raw_totals": """
        SELECT year AS Period, CASE WHEN iso3 = 'N08' THEN 999999 ELSE CAST(substr(iso3, 2) AS INT) + 1 END
                   AS reporterCode,
               CASE WHEN hs4 LIKE '302%' THEN 'TOTAL' ELSE hs4 END AS cmdCode,
               CASE WHEN hs4 LIKE '401%' THEN NULL ELSE export_value END AS fobvalue
        FROM {exports}""",
    "raw_reporters": f"""
        SELECT false AS isGroup, CAST(n_nationkey + 1 AS INT) AS reporterCode, n_name AS reporterDesc,
               {_iso('n_nationkey')} AS reporterCodeIsoAlpha3, substr(n_name, 8) AS reporterCodeIsoAlpha2
        FROM {{nation}}
        UNION ALL
        SELECT false, CAST(500 + n_nationkey AS INT), n_name || ' (...1990)', {_iso('n_nationkey')}, substr(n_name, 8)
        FROM {{nation}} WHERE n_nationkey < 12
        UNION ALL
        SELECT true, CAST(900 + r_regionkey AS INT), r_name, '', '' FROM {{region}}""",
    "raw_partners": f"""
        SELECT false AS isGroup, CAST(n_nationkey + 1 AS INT) AS partnerCode, 'Partner ' || n_name AS partnerDesc,
               {_iso('n_nationkey')} AS partnerCodeIsoAlpha3, substr(n_name, 8) AS partnerCodeIsoAlpha2
        FROM {{nation}}
        UNION ALL
        SELECT false, CAST(800 + r_regionkey AS INT), r_name || ', nes', CASE WHEN r_regionkey < 2 THEN '' END, ''
        FROM {{region}}
        UNION ALL
        SELECT false, CAST(700 + n_nationkey AS INT), 'Zone ' || n_name, 'Z' || lpad(CAST(n_nationkey AS STRING), 2, '0'),
               'Z' FROM {{nation}} WHERE n_nationkey < 5""",
}

#: Small views of large tables that many queries read several times: written once, so that the lines are read once for each.
KEPT = {"exports", "shipments", "economy"}

FORMATTER = string.Formatter()
_STORED: dict[tuple, str] = {}


def state_of(spark: SparkSession, folder: str) -> tuple:
    """Name, length and time of the tables of a folder: what changes when one of them is written anew."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


def references(sql: str) -> list[str]:
    return sorted({name for _, name, _, _ in FORMATTER.parse(sql) if name})


class Tables:
    """Lazy access to the test tables and views of one folder: ``t.exports``, ``t.lineitem``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self._made, self._state = spark, folder, {}, None

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A derived table written once per session and state of the folder, then read by every query that needs it."""
        self._state = self._state or state_of(self.spark, self.folder)
        place = (self.spark.sparkContext.applicationId, self.folder, self._state, name)
        if place not in _STORED:
            _STORED[place] = scratch_path(self.spark, name)
        return materialise(self.spark, _STORED[place], build)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in VIEWS:
                inputs = {r: getattr(self, r) for r in references(VIEWS[name])}
                view = lambda: self.spark.sql(VIEWS[name], **inputs)
                self._made[name] = self.stored(f"view-{name}", view) if name in KEPT else view()
            elif name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._made[name]


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Plain SQL: ``body`` preceded by the views (and extra named queries) it reaches, in dependency order."""
    known = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in references(sql):
            if name in known and name not in order:
                visit(known[name])
                order.append(name)

    visit(body)
    plain = lambda sql: sql.format(**{r: r for r in references(sql)})
    ctes = ",\n".join(f"{name} AS ({plain(known[name])})" for name in order)
    return (f"WITH {ctes}\n" if ctes else "") + plain(body)
