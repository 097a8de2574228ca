"""Text of values and records."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def escape(text: Column) -> Column:
    """Backslash, quote, line feed, carriage return and tab escaped."""
    pairs = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]
    return functools.reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def is_printable(text: Column) -> Column:
    """1 to 4096 characters, all printable ASCII."""
    return F.length(text).between(1, 4096) & ~text.rlike(r"[^\x20-\x7e]")


def time_ns_date(ns: Column) -> Column:
    """UTC date of nanoseconds, rounded to milliseconds first. Under a UTC session."""
    return F.to_date(F.timestamp_millis(F.round(ns / 1_000_000).cast("long")))


def time_ns(ts: Column) -> Column:
    """Nanoseconds since the epoch of a timestamp."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def number(value: Column) -> Column:
    """A double in the fewest digits: without an exponent from a millionth up to 1e21, whole numbers without a point."""
    value = value.cast("double")
    shown, size = value.cast("string"), F.abs(value)
    plain = F.when(size < 1e13, shown.try_cast("decimal(38,24)").cast("string")).when(size < 1e20, shown.try_cast("decimal(38,17)").cast("string")).otherwise(shown.try_cast("decimal(38,0)").cast("string"))
    plain = F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    power = F.regexp_replace(F.regexp_replace(shown, r"(\.0)?E(-?)", "e$2"), "e(?=[0-9])", "e+")
    return F.when(size == 0, "0").when((size >= 1e-6) & (size < 1e21), plain).otherwise(power)


def literal(value: Column, kind: T.DataType, listed: bool = False) -> Column:
    """A value behind the mark of its type; null is ``^``. In a list (``listed``) the marks go by the values: whole doubles
    are marked as integers."""
    if isinstance(kind, T.BooleanType):
        out = F.concat(F.lit("?"), value.cast("string"))
    elif isinstance(kind, T.IntegralType):
        out = F.concat(F.lit("="), value.cast("string"))
    elif isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        whole = (F.floor(value.cast("double")) == value.cast("double")) & (F.abs(value.cast("double")) < float("inf"))
        out = F.concat(F.when(whole, "=").otherwise("~") if listed else F.lit("~"), number(value))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        out = F.concat(F.lit("@"), F.date_format(value, "yyyy-MM-dd"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: literal(x, kind.elementType, True)), ", "), F.lit("]"))
    elif isinstance(kind, T.StructType):
        out = F.concat(F.lit("{ "), F.concat_ws(" ", *(F.concat(F.lit(f"{f.name}: "), literal(value[f.name], f.dataType)) for f in kind)), F.lit(" }"))
    elif isinstance(kind, T.BinaryType):
        out = F.concat(F.lit("<"), F.hex(value), F.lit(">"))
    else:
        out = F.concat(F.lit('"'), escape(value.cast("string")), F.lit('"'))
    return F.coalesce(out, F.lit("^"))


def keyword(value: Column) -> Column:
    """A keyword behind its mark; null is ``^``."""
    return F.coalesce(F.concat(F.lit("$"), value), F.lit("^"))


def dump(df: DataFrame, rec: str, most: int | None = None, keywords: tuple[str, ...] = ()) -> DataFrame:
    """Each record as a line of text; the first ``most`` in order, if given. ``keywords``: columns that hold keywords."""
    rows = df.orderBy(rec).limit(most) if most is not None else df
    shown = {f.name: keyword(F.col(f"`{f.name}`")) if f.name in keywords else literal(F.col(f"`{f.name}`"), f.dataType) for f in df.schema if f.name != rec}
    line = F.concat(F.lit("{ "), F.concat_ws(" ", *(F.concat(F.lit(f"{name}: "), value) for name, value in shown.items())), F.lit(" }"))
    return rows.select(rec, line.alias("line"))
