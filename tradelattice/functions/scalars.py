"""Column expressions shared by the operators. All of them stay inside JVM code generation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

NUMERIC_TEXT = r"\A\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*\z"

WHOLE_TEXT = r"\A\s*[+-]?[0-9]+(\.0*)?\s*\z"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hs_code(code: Column | str, level: int = 4) -> Column:
    """Left-pad a product code with zeros; longer codes are kept, never truncated."""
    text = _col(code).cast("string")
    return F.when(F.length(text) < level, F.lpad(text, level, "0")).otherwise(text)


def is_hs_code(code: Column | str, level: int = 4) -> Column:
    """True for exactly ``level`` ASCII digits."""
    return _col(code).rlike(rf"\A[0-9]{{{level}}}\z")


def is_country(code: Column | str, aggregates: Iterable[str]) -> Column:
    """Three-character code that is not an aggregate; null codes fail."""
    c = _col(code)
    return (F.length(c) == 3) & ~c.isin(list(aggregates))


def parse_number(text: Column | str) -> Column:
    """Text to double; anything that is not plain numeric text becomes null."""
    c = _col(text)
    return F.when(c.rlike(NUMERIC_TEXT), F.trim(c).try_cast("double"))


def to_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Coerce the columns that exist to double: unparsable text and NaN become null."""
    types = {f.name: f.dataType for f in df.schema.fields}
    changed = {}
    for name in columns:
        kind = types.get(name)
        if kind is None:
            continue
        if isinstance(kind, T.StringType):
            changed[name] = parse_number(name)
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            changed[name] = F.when(~F.isnan(name), F.col(name).cast("double"))
        else:
            changed[name] = F.col(name).cast("double")
    return df.withColumns(changed) if changed else df


def to_whole(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Coerce code and year columns to int; fractions and text become null.

    Columns that are whole numbers already pass through, so filters on them still reach the scan.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    changed = {}
    for name in columns:
        kind = types[name]
        if isinstance(kind, T.IntegerType):
            continue
        if isinstance(kind, T.IntegralType):
            changed[name] = F.col(name).try_cast("int")
        elif isinstance(kind, T.StringType):
            changed[name] = F.when(F.col(name).rlike(WHOLE_TEXT), F.trim(name).try_cast("double").try_cast("int"))
        else:
            changed[name] = F.when(F.col(name) == F.floor(name), F.col(name).try_cast("int"))
    return df.withColumns(changed) if changed else df


def hash_bucket(parts: Iterable[Column | str], seed: int, buckets: int) -> Column:
    """Stable bucket of a key: first 32 bits of the md5 of the parts and the seed, modulo ``buckets``."""
    return F.pmod(hash32(parts, seed), F.lit(buckets))


def hash32(parts: Iterable[Column | str], seed: int) -> Column:
    """First 32 bits of the md5 of the ``|``-joined parts and the seed, as bigint."""
    key = F.concat_ws("|", *[_col(p).cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(hadamard(a, b), F.lit(0.0), lambda s, x: s + x)


def hadamard(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))


def l2_norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalised(a: Column | str) -> Column:
    """Vector divided by its length; a zero vector stays zero."""
    n = l2_norm(a)
    return F.transform(_col(a), lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))
