"""Reducers over fields: one pass for any number of them, whatever the layout the records came from.

Absent values are skipped. Sums over no values are 0; minima and maxima are null. NaN is left out of minima and maxima
and carries through sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.operators.predicates import field_of


class UnknownField(KeyError):
    """A reducer names a field that the records don't have."""


def _numeric(df: DataFrame, key: str) -> tuple[Column, T.DataType]:
    found = field_of(df.schema, key)
    if found is None:
        raise UnknownField(key)
    if not isinstance(found[1], T.NumericType):
        raise TypeError(f"{key} is no number")
    return found


def sum_f64(df: DataFrame, key: str) -> Column:
    column, _ = _numeric(df, key)
    return F.coalesce(F.sum(column.cast("double")), F.lit(0.0))


def sum_i64(df: DataFrame, key: str, overflow: str = "raise") -> Column:
    """``overflow``: ``raise`` (ANSI mode's error), ``null``, or ``wrap`` modulo 2^64."""
    column, _ = _numeric(df, key)
    column = column.cast("long")
    if overflow == "raise":
        return F.coalesce(F.sum(column), F.lit(0).cast("long"))
    if overflow == "null":
        return F.when(F.count(column) == 0, F.lit(0).cast("long")).otherwise(F.try_sum(column))
    if overflow != "wrap":
        raise ValueError("overflow: raise, null or wrap")
    # halves of 32 bits: neither sum overflows below 2^31 rows, and the high one may wrap by itself
    low = F.sum(column.bitwiseAND(F.lit(0xFFFFFFFF)).cast("decimal(38,0)"))
    high = F.sum(F.shiftright(column, 32).cast("decimal(38,0)"))
    total = F.coalesce(high * F.lit(1 << 32).cast("decimal(11,0)") + low, F.lit(0)).cast("decimal(38,0)")
    size = F.lit(str(1 << 64)).cast("decimal(20,0)")
    folded = F.pmod(total, size)
    return F.when(folded >= F.lit(str(1 << 63)).cast("decimal(20,0)"), folded - size).otherwise(folded).cast("long")


def _without_nan(column: Column, kind: T.DataType) -> Column:
    return F.when(~F.isnan(column), column) if isinstance(kind, (T.FloatType, T.DoubleType)) else column


def min_f64(df: DataFrame, key: str) -> Column:
    return F.min(_without_nan(*_numeric(df, key))).cast("double")


def max_f64(df: DataFrame, key: str) -> Column:
    return F.max(_without_nan(*_numeric(df, key))).cast("double")


def reduce(df: DataFrame, **wanted: tuple[str, str]) -> DataFrame:
    """One row with a column per name: ``total=("sum_f64", "score")``. A single scan and aggregation."""
    kinds = {"sum_f64": sum_f64, "sum_i64": sum_i64, "min_f64": min_f64, "max_f64": max_f64, "count": lambda d, k: F.count(_numeric(d, k)[0])}
    return df.agg(*(kinds[how](df, key).alias(name) for name, (how, key) in wanted.items()))


def is_uniform(df: DataFrame) -> DataFrame:
    """One row, ``uniform``: whether all records have the same fields. The number of masks is bounded by the data's
    shapes; two are enough to tell, so only the least and the greatest are kept."""
    mask = F.concat(*(F.when(F.col(f"`{c}`").isNull(), "0").otherwise("1") for c in df.columns))
    return df.agg((F.coalesce(F.min(mask) == F.max(mask), F.lit(True))).alias("uniform"))


def field_index(df: DataFrame, rec: str, key: str) -> DataFrame:
    """The record ordinal and one field: what indexed reducers read. Cache it to use it again."""
    found = field_of(df.schema, key)
    if found is None:
        raise UnknownField(key)
    return df.select(F.col(rec), found[0].alias(key))


def indexed(index: DataFrame, ordinals: DataFrame | list[int], rec: str) -> DataFrame:
    """The rows of a ``field_index`` at some ordinals, given as a list or as a DataFrame with the column ``rec``, each once:
    what a reducer over an index reads. A short list becomes a filter that scans can use."""
    if isinstance(ordinals, list):
        return index.filter(F.col(rec).isin(ordinals))
    return index.join(ordinals.select(rec), rec, "left_semi")
