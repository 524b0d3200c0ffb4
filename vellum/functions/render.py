"""The text under which values of any type are indexed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _number(value: Column) -> Column:
    digits, size = value.cast("string"), F.abs(value)
    plain = F.regexp_replace(F.regexp_replace(digits.try_cast("decimal(38,22)").cast("string"), "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")
    power = F.regexp_replace(F.regexp_replace(digits, "\\.0E", "E"), "E(-?)", "e+$1")
    return (
        F.when(value == 0, "0")
        .when(F.isnan(value) | (size == float("inf")), digits)
        .when((size >= 1e21) | (size < 1e-6), F.replace(power, F.lit("e+-"), F.lit("e-")))
        .when((value == F.floor(value)) & (size < 2.0**53), value.try_cast("bigint").cast("string"))
        .when(size >= 2.0**53, digits.try_cast("decimal(38,0)").cast("string"))
        .otherwise(plain)
    )


def render(value: Column, kind: T.DataType) -> Column:
    """Strings as they are, numbers in the fewest digits (with an exponent from 1e21 on and below 1e-6), times in ISO 8601 with milliseconds, nested values as JSON."""
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return _number(value)
    if isinstance(kind, T.TimestampType):
        return F.date_format(F.to_utc_timestamp(value, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(kind, T.TimestampNTZType):
        return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    if isinstance(kind, T.DateType):
        return F.concat(value.cast("string"), F.lit("T00:00:00.000Z"))
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    return value.cast("string")
