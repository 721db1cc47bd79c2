"""Queries for the complexity metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradelattice.operators import complexity as C, profiles as A
from tradelattice.operators.ordering import top_k
from tradelattice.plans.registry import SHARED, query, r, r6, rounded
from tradelattice.session import stage

FOCUS = "N03"
SQUARED = 13

SHARED.update({
    "cells": "SELECT year, iso3, hs4, sum(export_value) AS export_value FROM {exports} GROUP BY ALL",
    "grid_cells": """
        SELECT c.year, c.iso3, p.hs4, coalesce(x.export_value, 0.0) AS export_value
        FROM (SELECT DISTINCT year, iso3 FROM {cells}) c JOIN (SELECT DISTINCT year, hs4 FROM {cells}) p USING (year)
             LEFT JOIN {cells} x ON x.year = c.year AND x.iso3 = c.iso3 AND x.hs4 = p.hs4""",
    "adv": """
        SELECT g.year, g.iso3, g.hs4, g.export_value,
               (g.export_value / nullif(c.v, 0)) / nullif(p.v / nullif(y.v, 0), 0) AS rca
        FROM {grid_cells} g
             JOIN (SELECT year, iso3, sum(export_value) AS v FROM {cells} GROUP BY ALL) c USING (year, iso3)
             JOIN (SELECT year, hs4, sum(export_value) AS v FROM {cells} GROUP BY ALL) p USING (year, hs4)
             JOIN (SELECT year, sum(export_value) AS v FROM {cells} GROUP BY ALL) y USING (year)""",
    "pres": "SELECT *, CASE WHEN rca >= 1 THEN 1 WHEN rca < 1 THEN 0 END AS mcp FROM {adv}",
    "m": "SELECT year, iso3, hs4 FROM {pres} WHERE mcp = 1",
    "kc": "SELECT year, iso3, count(*) AS k FROM {m} GROUP BY ALL",
    "kp": "SELECT year, hs4, count(*) AS k FROM {m} GROUP BY ALL",
    "phi": """
        SELECT n.year, n.hs4_i, n.hs4_j, n.n / greatest(a.k, b.k)::DOUBLE AS proximity
        FROM (SELECT a.year, a.hs4 AS hs4_i, b.hs4 AS hs4_j, count(*) AS n
              FROM {m} a JOIN {m} b ON a.year = b.year AND a.iso3 = b.iso3 AND a.hs4 <> b.hs4 GROUP BY ALL) n
             JOIN {kp} a ON a.year = n.year AND a.hs4 = n.hs4_i JOIN {kp} b ON b.year = n.year AND b.hs4 = n.hs4_j""",
    "phisum": "SELECT year, hs4_j AS hs4, sum(proximity) AS s FROM {phi} GROUP BY ALL",
    "dens": """
        SELECT t.*, coalesce(n.v, 0.0) / s.s AS density
        FROM {pres} t LEFT JOIN {phisum} s USING (year, hs4)
             LEFT JOIN (SELECT m.year, m.iso3, f.hs4_j AS hs4, sum(f.proximity) AS v
                        FROM {m} m JOIN {phi} f ON m.year = f.year AND m.hs4 = f.hs4_i GROUP BY ALL) n
                       USING (year, iso3, hs4)""",
    "refl_p1": """SELECT m.year, m.hs4, avg(c.k) AS k FROM {m} m JOIN {kc} c ON m.year = c.year AND m.iso3 = c.iso3
                  GROUP BY ALL""",
    "refl_c2": """SELECT m.year, m.iso3, avg(p.k) AS k FROM {m} m JOIN {refl_p1} p ON m.year = p.year AND m.hs4 = p.hs4
                  GROUP BY ALL""",
    # The country similarity in symmetric form without its known leading vector, squared again and again until one vector is left.
    "pw0": """
        SELECT c.year, c.iso3 AS c, d.iso3 AS d,
               coalesce(a.v, 0.0) / sqrt(c.k * d.k) - sqrt(c.k * d.k) / sum(d.k) OVER (PARTITION BY c.year, c.iso3) AS s
        FROM {kc} c JOIN {kc} d ON c.year = d.year
             LEFT JOIN (SELECT x.year, x.iso3 AS c, y.iso3 AS d, sum(1.0 / p.k) AS v FROM {m} x JOIN {m} y ON x.year = y.year AND x.hs4 = y.hs4
                        JOIN {kp} p ON p.year = x.year AND p.hs4 = x.hs4 GROUP BY ALL) a
                       ON a.year = c.year AND a.c = c.iso3 AND a.d = d.iso3""",
    **{f"pw{n + 1}": f"""
        SELECT x.year, x.c, y.d, sum(x.s * y.s) / t.t AS s
        FROM {{pw{n}}} x JOIN {{pw{n}}} y ON x.year = y.year AND x.d = y.c
             JOIN (SELECT year, sum(s * s) AS t FROM {{pw{n}}} GROUP BY ALL) t ON t.year = x.year
        GROUP BY x.year, x.c, y.d, t.t""" for n in range(SQUARED)},
    "vec": f"""
        SELECT w.year, w.c AS iso3, k.k, w.s / sqrt(k.k) AS x
        FROM {{pw{SQUARED}}} w JOIN {{kc}} k ON k.year = w.year AND k.iso3 = w.c
             JOIN (SELECT year, max_by(c, s) AS d FROM {{pw{SQUARED}}} WHERE c = d GROUP BY year) best ON best.year = w.year AND best.d = w.d""",
    "ecic": """
        SELECT v.year, v.iso3, v.x * sign(c.lean) AS k, (v.x - c.m) / c.s * sign(c.lean) AS eci
        FROM {vec} v JOIN (SELECT year, covar_pop(x, k) AS lean, avg(x) AS m, stddev_pop(x) AS s FROM {vec} GROUP BY ALL) c USING (year)""",
    "pcie": """
        SELECT year, hs4, (q - avg(q) OVER (PARTITION BY year)) / nullif(stddev_pop(q) OVER (PARTITION BY year), 0) AS pci
        FROM (SELECT m.year, m.hs4, avg(c.k) AS q FROM {m} m JOIN {ecic} c ON m.year = c.year AND m.iso3 = c.iso3
              GROUP BY ALL)""",
    "outlook": """
        SELECT d.year, d.iso3, d.hs4, d.export_value, d.rca, d.mcp, d.density, q.pci,
               CASE WHEN d.mcp = 0 THEN coalesce(g.v, 0.0) - d.density * q.pci END AS cog
        FROM {dens} d LEFT JOIN {pcie} q USING (year, hs4)
             LEFT JOIN (SELECT o.year, o.iso3, f.hs4_i AS hs4, sum(f.proximity / s.s * w.pci) AS v
                        FROM {pres} o JOIN {phi} f ON o.year = f.year AND o.hs4 = f.hs4_j
                             JOIN {phisum} s ON s.year = f.year AND s.hs4 = f.hs4_j
                             JOIN {pcie} w ON w.year = f.year AND w.hs4 = f.hs4_j
                        WHERE o.mcp = 0 GROUP BY ALL) g USING (year, iso3, hs4)""",
    "coir": """SELECT year, iso3, coalesce(sum(CASE WHEN mcp = 0 THEN density * pci END), 0.0) AS coi
               FROM {outlook} GROUP BY ALL""",
    "focus_now": f"""SELECT * FROM {{outlook}} WHERE iso3 = '{FOCUS}'
                     AND year = (SELECT max(year) FROM {{cells}} WHERE iso3 = '{FOCUS}')""",
})


def adv(t):
    """Advantage and presence over the observed cells."""
    return C.mcp(C.rca(stage(C.trade_cells(t.exports), "cells")))


def grid_adv(t):
    """Advantage and presence over the full yearly grids."""
    return C.mcp(C.rca(C.full_grid(stage(C.trade_cells(t.exports), "cells"))))


def present(t):
    """The presence table, written once because several branches read it."""
    return stage(C.presence(adv(t)), "presence")


def metrics(t):
    """All metrics of all years."""
    return C.compute_complexity(t.exports)


@query("trade_grid", f"SELECT year, iso3, hs4, {r('export_value')} AS export_value FROM {{grid_cells}}")
def trade_grid(t):
    return rounded(C.full_grid(C.trade_cells(t.exports)))


@query("rca", f"SELECT year, iso3, hs4, {r('rca')} AS rca FROM {{adv}} WHERE export_value > 0")
def rca_query(t):
    return rounded(C.rca(stage(C.trade_cells(t.exports), "cells")).select("year", "iso3", "hs4", "rca"))


@query("mcp", "SELECT year, iso3, hs4, CAST(mcp AS INT) AS mcp FROM {pres}")
def mcp_query(t):
    return grid_adv(t).select("year", "iso3", "hs4", "mcp")


@query("diversity", "SELECT year, iso3, CAST(k AS BIGINT) AS diversity FROM {kc}")
def diversity_query(t):
    return C.diversity(C.presence(adv(t)))


@query("ubiquity", "SELECT year, hs4, CAST(k AS BIGINT) AS ubiquity FROM {kp}")
def ubiquity_query(t):
    return C.ubiquity(C.presence(adv(t)))


@query("co_export", """
    SELECT a.year, a.hs4 AS hs4_i, b.hs4 AS hs4_j, CAST(count(*) AS BIGINT) AS n
    FROM {m} a JOIN {m} b ON a.year = b.year AND a.iso3 = b.iso3 AND a.hs4 < b.hs4 GROUP BY ALL""")
def co_export(t):
    m = present(t)
    return C.co_presence(m, C.Axes.of(m)).where("hs4_i < hs4_j").withColumn("n", F.col("n").cast("bigint"))


@query("proximity", f"SELECT year, hs4_i, hs4_j, {r('proximity')} AS proximity FROM {{phi}}")
def proximity_query(t):
    return rounded(C.proximity(present(t)))


@query("proximity_latest_year", f"""SELECT hs4_i, hs4_j, {r('proximity')} AS proximity FROM {{phi}}
       WHERE year = (SELECT max(year) FROM {{exports}})""")
def proximity_latest(t):
    now = A.in_latest_year(stage(C.trade_cells(t.exports), "cells"))
    m = stage(C.presence(C.mcp(C.rca(now))), "presence")
    return rounded(C.proximity(m).drop("year"))


@query("density", f"SELECT year, iso3, hs4, mcp::INT AS mcp, {r('density')} AS density FROM {{dens}}")
def density_query(t):
    full = metrics(t)
    return rounded(full.table.select("year", "iso3", "hs4", "mcp", "density"))


@query("density_with_self", f"""
    SELECT d.year, d.iso3, d.hs4,
           {r('(d.density * s.s + CASE WHEN d.mcp = 1 THEN 1 ELSE 0 END) / (s.s + 1)')} AS density
    FROM {{dens}} d LEFT JOIN {{phisum}} s USING (year, hs4)""")
def density_with_self(t):
    table = stage(grid_adv(t), "advantage")
    m = C.presence(table)
    axes = C.Axes.of(m)
    return rounded(
        C.density(table, C.proximity(m, axes), axes, include_self=True).select("year", "iso3", "hs4", "density")
    )


@query("eci", f"SELECT year, iso3, {r6('eci')} AS eci FROM {{ecic}}")
def eci_query(t):
    return rounded(C.eci(present(t)).select("year", "iso3", "eci"))


@query("reflections", f"SELECT year, iso3, {r('k')} AS k FROM {{refl_c2}}")
def reflections_query(t):
    return rounded(C.reflections(C.presence(adv(t)), 2))


@query("pci", f"SELECT year, hs4, {r6('pci')} AS pci FROM {{pcie}}")
def pci_query(t):
    m = present(t)
    return rounded(C.pci(m, C.eci(m)).drop("ubiquity"))


@query("pci_of_reflections", f"""
    SELECT year, hs4, {r6('(q - avg(q) OVER (PARTITION BY year)) / nullif(stddev_pop(q) OVER (PARTITION BY year), 0)')} AS pci
    FROM (SELECT m.year, m.hs4, avg(c.k) AS q FROM {{m}} m JOIN {{refl_c2}} c ON m.year = c.year AND m.iso3 = c.iso3 GROUP BY ALL)""")
def pci_of_reflections(t):
    m = present(t)
    return rounded(C.pci(m, C.reflections(m, 2), "k").drop("ubiquity"))


@query("coi", f"SELECT year, iso3, {r6('coi')} AS coi FROM {{coir}}")
def coi_query(t):
    return rounded(metrics(t).table.groupBy("year", "iso3").agg(F.max("coi").alias("coi")))


@query("cog", f"SELECT year, iso3, hs4, {r6('cog')} AS cog FROM {{outlook}} WHERE mcp = 0")
def cog_query(t):
    table = stage(grid_adv(t), "advantage")
    m = C.presence(table)
    axes = C.Axes.of(m)
    phi = stage(C.proximity(m, axes), "proximity")
    table = C.density(table, phi, axes).join(
        C.pci(m, C.eci(m, axes)).drop("ubiquity"), ["year", "hs4"], "left"
    )
    return rounded(C.outlook_gain(table, phi, axes).where("mcp = 0").select("year", "iso3", "hs4", "cog"))


@query("complexity", f"""
    SELECT o.year, o.iso3, o.hs4, {r('o.export_value')} AS export_value, {r('o.rca')} AS rca, o.mcp::INT AS mcp,
           {r6('o.pci')} AS pci, {r('o.density')} AS density, {r6('c.coi')} AS coi, {r6('o.cog')} AS cog,
           coalesce(a.k, 0)::BIGINT AS diversity, coalesce(b.k, 0)::BIGINT AS ubiquity
    FROM {{outlook}} o JOIN {{coir}} c USING (year, iso3) LEFT JOIN {{kc}} a USING (year, iso3)
         LEFT JOIN {{kp}} b USING (year, hs4)""")
def complexity_query(t):
    return rounded(metrics(t).table.drop("eci"))


@query("complexity_with_eci", f"""
    SELECT o.year, o.iso3, o.hs4, {r('o.export_value')} AS export_value, {r('o.rca')} AS rca, o.mcp::INT AS mcp, {r6('e.eci')} AS eci,
           {r6('o.pci')} AS pci, {r('o.density')} AS density, {r6('c.coi')} AS coi, {r6('o.cog')} AS cog,
           coalesce(a.k, 0)::BIGINT AS diversity, coalesce(b.k, 0)::BIGINT AS ubiquity
    FROM {{outlook}} o JOIN {{coir}} c USING (year, iso3) LEFT JOIN {{kc}} a USING (year, iso3)
         LEFT JOIN {{kp}} b USING (year, hs4) LEFT JOIN {{ecic}} e ON e.year = o.year AND e.iso3 = o.iso3""")
def complexity_with_eci(t):
    return rounded(metrics(t).table)


@query("complexity_one_year", f"""
    SELECT iso3, hs4, {r('rca')} AS rca, mcp::INT AS mcp, {r('density')} AS density FROM {{dens}} WHERE year = 1998""")
def complexity_one_year(t):
    full = C.compute_complexity(t.exports, year=1998)
    return rounded(full.table.select("iso3", "hs4", "rca", "mcp", "density"))


@query("country_complexity", f"""
    SELECT k.year, k.iso3, {r6('e.eci')} AS eci, k.k::BIGINT AS diversity FROM {{kc}} k JOIN {{ecic}} e ON e.year = k.year AND e.iso3 = k.iso3""")
def country_complexity_query(t):
    return rounded(C.country_complexity(metrics(t).table).where("diversity > 0"))


@query("product_complexity", f"""
    SELECT p.year, p.hs4, {r6('q.pci')} AS pci, p.k::BIGINT AS ubiquity FROM {{kp}} p JOIN {{pcie}} q USING (year, hs4)""")
def product_complexity_query(t):
    return rounded(C.product_complexity(metrics(t).table).where("ubiquity > 0"))


@query("density_matrix", f"SELECT year, iso3, hs4, {r('density')} AS density FROM {{dens}}")
def density_matrix(t):
    return rounded(C.density_table(metrics(t).table))


@query("complexity_report", f"""
    SELECT 'diversity' AS item, NULL AS label, sum(mcp)::DOUBLE AS value, NULL::DOUBLE AS pci FROM {{focus_now}}
    UNION ALL SELECT 'eci', NULL, {r6('eci')}, NULL FROM {{ecic}} WHERE iso3 = '{FOCUS}' AND year = (SELECT max(year) FROM {{focus_now}})
    UNION ALL SELECT 'products_with_rca', NULL, sum(mcp)::DOUBLE, NULL FROM {{focus_now}}
    UNION ALL SELECT 'nearest_product', hs4, {r('density')}, {r6('pci')}
              FROM (SELECT * FROM {{focus_now}} WHERE mcp = 0 ORDER BY density DESC NULLS LAST, hs4 LIMIT 10)""")
def complexity_report_query(t):
    report = A.complexity_report(metrics(t).table, FOCUS)
    return rounded(report.withColumn("value", F.when(F.col("item") == "eci", F.round("value", 6)).otherwise(F.col("value"))))


@query("top_products_by_rca", f"""
    SELECT year, iso3, hs4, {r('rca')} AS rca FROM {{adv}} WHERE iso3 = '{FOCUS}' AND year = 2000
    ORDER BY rca DESC, hs4 LIMIT 10""")
def top_products_by_rca(t):
    table = C.rca(C.trade_cells(t.exports, 2000)).where(F.col("iso3") == FOCUS)
    return rounded(top_k(table, [F.desc("rca"), F.asc("hs4")], 10).select("year", "iso3", "hs4", "rca"))
