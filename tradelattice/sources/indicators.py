"""Country indicators out of JSON payloads ``[meta, [{countryiso3code, date, value}, ...]]``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from tradelattice.functions import constants as K
from tradelattice.operators.profiles import widen

RECORDS = "array<struct<countryiso3code:string,date:string,value:double>>"


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """(indicator, payload) to (iso3, year, indicator, value).

    A payload without records is skipped, and so are records without country, year or value.
    """
    records = F.from_json(F.get_json_object("payload", "$[1]"), RECORDS)
    return (
        payloads.select("indicator", F.inline(records))
        .select(
            F.col("countryiso3code").alias("iso3"), F.col("date").try_cast("int").alias("year"), "indicator", "value"
        )
        .where("iso3 <> '' AND year IS NOT NULL AND value IS NOT NULL")
    )


def indicator_table(payloads: DataFrame, indicators: Sequence[str] = K.WDI_INDICATORS) -> DataFrame:
    """Payloads to one row per (iso3, year) with a column per indicator."""
    return widen(parse_payloads(payloads), ["iso3", "year"], "indicator", "value", indicators)
