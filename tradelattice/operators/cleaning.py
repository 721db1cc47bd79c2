"""Cleaning and harmonising: renames, filters, code lookups and the three cleaned tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tradelattice.functions import constants as K, scalars as S


# --- projections and filters ---------------------------------------------------------------------


def rename_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename the columns that exist; absent names are ignored."""
    return df.withColumnsRenamed(names)


def rename_any_case(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename columns whose lower-cased name is a key of ``names``."""
    return df.toDF(*[names.get(c.lower(), c) for c in df.columns])


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: Iterable[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing columns {missing}; available: {df.columns}")
    return df


def keep_present(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def in_years(df: DataFrame, first: int, last: int, year: str = "year") -> DataFrame:
    """Inclusive year range; reaches the scan as a pushed filter or a partition filter."""
    return df.where(F.col(year).between(first, last))


def focus(df: DataFrame, **equals: object) -> DataFrame:
    """Rows equal to the given values, e.g. ``focus(flows, year=2020, reporter_iso3="MKD", flow="X")``."""
    for name, value in equals.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def valid_countries(df: DataFrame, aggregates: Iterable[str], *columns: str) -> DataFrame:
    for c in columns or ("iso3",):
        df = df.where(S.is_country(c, aggregates))
    return df


def not_aggregates(df: DataFrame, aggregates: Iterable[str], *columns: str) -> DataFrame:
    for c in columns:
        df = df.where(~F.col(c).isin(list(aggregates)))
    return df


def drop_aggregate_m49(df: DataFrame, *columns: str) -> DataFrame:
    """Drop aggregate and missing numeric codes."""
    for c in columns:
        df = df.where(~F.col(c).isin(K.AGGREGATE_M49))
    return df


def normalise_hs(df: DataFrame, source: str = "hs4", target: str = "hs4", level: int = 4) -> DataFrame:
    return df.withColumn(target, S.hs_code(source, level)).where(S.is_hs_code(target, level))


def fill_zero(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in columns})


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(columns) if columns else None)


def trade_value(df: DataFrame, target: str = "value") -> DataFrame:
    """Primary value, else the free-on-board value of exports and the cost-insurance-freight value otherwise."""
    have = {c: F.col(c) for c in ("value", "fob_value", "cif_value") if c in df.columns}
    if not have:
        return df
    df = S.to_numeric(df, list(have))  # text that is no number, and NaN, fall back too
    fob, cif = have.get("fob_value"), have.get("cif_value")
    if fob is not None and cif is not None:
        fallback: Column | None = F.when(F.col("flow") == "X", fob).otherwise(cif)
    else:
        fallback = fob if fob is not None else cif
    choices = [c for c in (have.get("value"), fallback) if c is not None]
    return df.withColumn(target, F.coalesce(*choices))


def hs_rollup(df: DataFrame, level: int | None, by: Sequence[str], value: str, code: str = "hs4") -> DataFrame:
    """Sum to a coarser classification level (2, 4 or 6 digits; anything else means 4)."""
    digits = level if level in (2, 4, 6) else 4
    return df.groupBy(*by, F.substring(code, 1, digits).alias(code)).agg(F.sum(value).alias(value))


# --- country codes -------------------------------------------------------------------------------


def _code_list(df: DataFrame, side: str, source_order: int) -> DataFrame:
    lower = df.toDF(*[c.lower() for c in df.columns])
    return S.to_whole(lower, [f"{side}code"]).where(~F.col("isgroup")).select(
        F.col(f"{side}code").alias("m49"),
        F.col(f"{side}desc").alias("country_name"),
        F.col(f"{side}codeisoalpha3").alias("iso3"),
        F.col(f"{side}codeisoalpha2").alias("iso2"),
        F.lit(source_order).alias("source_order"),
    )


def country_codes(reporters: DataFrame, partners: DataFrame) -> DataFrame:
    """One row per ISO3 and per M49 code out of the reporter and partner reference lists.

    Reporters win over partners for the same M49 code; a current entry wins over a historical one (name
    with ``...``) for the same ISO3 code; the smaller M49 code breaks what is left.
    """
    both = _code_list(reporters, "reporter", 0).unionByName(_code_list(partners, "partner", 1))
    per_code = keep_first(both, ["m49"], [F.col("source_order"), F.col("iso3"), F.col("country_name")])
    current = per_code.where(F.col("iso3") != "").withColumn(
        "historical", F.coalesce(F.col("country_name").contains("..."), F.lit(False))
    )
    best = keep_first(current, ["iso3"], [F.col("historical"), F.col("m49")])
    return best.select("m49", "country_name", "iso3", "iso2")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in a total order; each task keeps one row per key before the exchange."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def attach_iso3(df: DataFrame, codes: DataFrame, m49: str, iso3: str) -> DataFrame:
    """Left join of the code table; unmatched codes get a null ``iso3``."""
    return df.join(codes.select(F.col("m49").alias(m49), F.col("iso3").alias(iso3)), m49, "left")


def unmatched(df: DataFrame, *columns: str) -> DataFrame:
    """Number of rows with a null in each column, as one row."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"unmatched_{c}") for c in columns])


def lookup_codes(
    df: DataFrame, codes: DataFrame, key: str, wanted: str, source: str | None = None, strict: bool = True
) -> DataFrame:
    """Add ``wanted`` (iso3, m49 or country_name) looked up by ``key`` (iso3, any case, or m49).

    In strict mode an unknown key fails the query when it runs; otherwise it gives null.
    """
    source = source or key
    probe = F.upper(source) if key == "iso3" else F.col(source)
    table = codes.select(F.col(key).alias("_key"), F.col(wanted).alias("_found"))
    joined = df.withColumn("_key", probe).join(table, "_key", "left")
    value = F.col("_found")
    if strict:
        message = F.concat(F.lit(f"no {wanted} for {key}="), F.coalesce(F.col(source).cast("string"), F.lit("null")))
        value = F.when(value.isNull(), F.raise_error(message).cast(codes.schema[wanted].dataType)).otherwise(value)
    return joined.withColumn(wanted, value).drop("_key", "_found")


def member_flags(df: DataFrame, sets: dict[str, Iterable[str]], iso3: str = "iso3") -> DataFrame:
    """Boolean column per named country set."""
    return df.withColumns({name: F.col(iso3).isin(list(codes)) for name, codes in sets.items()})


# --- cleaned tables ------------------------------------------------------------------------------


def clean_exports(
    raw: DataFrame, years: tuple[int, int] = K.EXPORT_YEARS, aggregates: Iterable[str] = K.EXPORT_AGGREGATES
) -> DataFrame:
    """Country-product-year table: year, iso3, hs4 and the numeric columns present in the input."""
    df = S.to_whole(rename_present(raw, K.EXPORT_RENAMES), ["year"])
    df = valid_countries(in_years(df, *years), aggregates)
    df = S.to_numeric(normalise_hs(df), K.EXPORT_NUMERIC)
    return keep_present(fill_zero(df, "export_value"), ["year", "iso3", "hs4", *K.EXPORT_NUMERIC])


def map_flows(raw: DataFrame, codes: DataFrame) -> DataFrame:
    """Bilateral rows with ISO3 codes attached; codes without a match are null."""
    df = trade_value(rename_any_case(raw, K.FLOW_RENAMES))
    df = require_columns(df, ["year", "reporter_m49", "partner_m49", "hs_code", "flow", "value"])
    df = S.to_whole(df, ["year", "reporter_m49", "partner_m49"])
    df = drop_aggregate_m49(df, "reporter_m49", "partner_m49")
    df = attach_iso3(df, codes, "reporter_m49", "reporter_iso3")
    return attach_iso3(df, codes, "partner_m49", "partner_iso3")


def clean_flows(
    raw: DataFrame, codes: DataFrame, aggregates: Iterable[str] = K.FLOW_AGGREGATES
) -> DataFrame:
    """Bilateral table: year, reporter_iso3, partner_iso3, hs4, flow, value."""
    df = drop_incomplete(map_flows(raw, codes), ["reporter_iso3", "partner_iso3"])
    df = not_aggregates(df, aggregates, "reporter_iso3", "partner_iso3")
    df = fill_zero(S.to_numeric(normalise_hs(df, "hs_code"), ["value"]), "value")
    return df.select("year", "reporter_iso3", "partner_iso3", "hs4", "flow", "value")


def clean_totals(raw: DataFrame, codes: DataFrame) -> DataFrame:
    """Exports to the world as reported: year, iso3, hs4, export_value; rows with any null are dropped."""
    lower = {c.lower() for c in raw.columns}
    names = {k: v for k, v in K.TOTAL_RENAMES.items() if k != "fobvalue" or "primaryvalue" not in lower}
    df = rename_any_case(raw, names)
    if "reporter_m49" in df.columns:
        df = attach_iso3(S.to_whole(df, ["reporter_m49"]), codes, "reporter_m49", "iso3")
    else:
        df = rename_any_case(df, {"reporteriso": "iso3"})
    if "export_value" not in df.columns:
        named = [c for c in df.columns if "value" in c.lower()]
        df = df.withColumnRenamed(named[0], "export_value") if named else df
    df = require_columns(df, ["year", "iso3", "hs_code", "export_value"])
    df = S.to_whole(df, ["year"])
    df = fill_zero(S.to_numeric(normalise_hs(df, "hs_code"), ["export_value"]), "export_value")
    return drop_incomplete(df.select("year", "iso3", "hs4", "export_value"))


def supplement(primary: DataFrame, secondary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Primary rows plus the secondary rows whose key the primary table lacks."""
    extra = secondary.join(primary.select(*keys).distinct(), list(keys), "left_anti")
    return primary.unionByName(extra, allowMissingColumns=True)


def clean_gravity(raw: DataFrame, years: tuple[int, int] = K.GRAVITY_YEARS) -> DataFrame:
    """Country-pair covariates of the year range, numeric columns coerced, ``col45`` named ``colony``."""
    df = rename_present(keep_present(raw, K.GRAVITY_COLUMNS), {"col45": "colony"})
    df = S.to_whole(df, ["year"])
    return S.to_numeric(in_years(df, *years), [c for c in df.columns if c not in ("year", "iso3_o", "iso3_d")])


def union_slices(*slices: DataFrame) -> DataFrame:
    """Union all by name; a column absent from a slice is null there."""
    first, *rest = slices
    for s in rest:
        first = first.unionByName(s, allowMissingColumns=True)
    return first
