"""Predicates over records, bound to a schema when they meet a DataFrame.

A predicate is two-valued: a comparison with an absent value, an unknown field or a literal of another kind is false,
so its negation is true. NaN compares false with everything. Ordering is for numbers only. A field's declared type
decides how it is compared; numbers of different widths are promoted. Dotted keys reach into structs.
"""

from __future__ import annotations

import functools
import math
import operator
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LONG = (-(1 << 63), (1 << 63) - 1)


def field_of(schema: T.StructType, key: str) -> tuple[Column, T.DataType] | None:
    """Column and type of a key: a column of that very name, or a dotted path into structs. None if there is none."""
    if key in schema.fieldNames():
        return F.col(f"`{key}`"), schema[key].dataType
    head, *rest = key.split(".")
    if head not in schema.fieldNames() or not rest:
        return None
    column, kind = F.col(f"`{head}`"), schema[head].dataType
    for part in rest:
        if not isinstance(kind, T.StructType) or part not in kind.fieldNames():
            return None
        column, kind = column.getField(part), kind[part].dataType
    return column, kind


class Predicate:
    """A condition; combine with ``&``, ``|`` and ``~``."""

    def __and__(self, other: Predicate) -> Predicate:
        return and_(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return or_(self, other)

    def __invert__(self) -> Predicate:
        return not_(self)

    def strict(self, schema: T.StructType) -> Column:
        """A column that is never null."""
        raise NotImplementedError

    def loose(self, schema: T.StructType) -> Column:
        """A column that is true on the same rows, though null on others: what a scan can take over."""
        return self.strict(schema)


@dataclass(frozen=True)
class Compare(Predicate):
    key: str
    op: str
    value: object

    def _bare(self, schema: T.StructType) -> Column | None:
        found = field_of(schema, self.key)
        if found is None:
            return None
        column, kind = found
        value = self.value
        if isinstance(value, bool):
            fits = isinstance(kind, T.BooleanType) and self.op == "eq"
        elif isinstance(value, (int, float)):
            fits = isinstance(kind, T.NumericType)
            if isinstance(value, int) and not _LONG[0] <= value <= _LONG[1]:
                value = float(value)
            fits = fits and not (isinstance(value, float) and math.isnan(value))
        elif isinstance(value, str):
            fits = isinstance(kind, T.StringType) and self.op == "eq"
        else:
            fits = isinstance(value, bytes) and isinstance(kind, T.BinaryType) and self.op == "eq"
        if not fits:
            return None
        out = {"eq": operator.eq, "gt": operator.gt, "lt": operator.lt, "gte": operator.ge, "lte": operator.le}[self.op](column, F.lit(value))
        may_be_nan = isinstance(kind, (T.FloatType, T.DoubleType)) and self.op in ("gt", "gte")
        return out & ~F.isnan(column) if may_be_nan else out

    def strict(self, schema: T.StructType) -> Column:
        bare = self._bare(schema)
        return F.lit(False) if bare is None else F.coalesce(bare, F.lit(False))

    def loose(self, schema: T.StructType) -> Column:
        bare = self._bare(schema)
        return F.lit(False) if bare is None else bare


@dataclass(frozen=True)
class All(Predicate):
    parts: tuple[Predicate, ...]

    def strict(self, schema: T.StructType) -> Column:
        return functools.reduce(operator.and_, (p.strict(schema) for p in self.parts), F.lit(True))

    def loose(self, schema: T.StructType) -> Column:
        return functools.reduce(operator.and_, (p.loose(schema) for p in self.parts)) if self.parts else F.lit(True)


@dataclass(frozen=True)
class Any(Predicate):
    parts: tuple[Predicate, ...]

    def strict(self, schema: T.StructType) -> Column:
        return functools.reduce(operator.or_, (p.strict(schema) for p in self.parts), F.lit(False))

    def loose(self, schema: T.StructType) -> Column:
        return functools.reduce(operator.or_, (p.loose(schema) for p in self.parts)) if self.parts else F.lit(False)


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate

    def strict(self, schema: T.StructType) -> Column:
        return ~self.part.strict(schema)


@dataclass(frozen=True)
class Callback(Predicate):
    """A condition as a function from a batch (pandas DataFrame of ``keys``) to a boolean series. The slow way."""

    keys: tuple[str, ...]
    function: Callable

    def strict(self, schema: T.StructType) -> Column:
        import pandas as pd

        function, keys = self.function, list(self.keys)
        found = [field_of(schema, k) for k in keys]
        if None in found:  # an unknown field: false, as in a comparison
            return F.lit(False)

        def test(rows):
            return function(rows.set_axis(keys, axis=1)).fillna(False).astype(bool)

        test.__annotations__ = {"rows": pd.DataFrame, "return": pd.Series}  # Spark reads types, not their names
        return F.coalesce(F.pandas_udf(test, "boolean")(F.struct(*(f[0].alias(f"c{i}") for i, f in enumerate(found)))), F.lit(False))


def eq(key: str, value: object) -> Predicate:
    return Compare(key, "eq", value)


def neq(key: str, value: object) -> Predicate:
    return Not(Compare(key, "eq", value))


def gt(key: str, value: float) -> Predicate:
    return Compare(key, "gt", value)


def lt(key: str, value: float) -> Predicate:
    return Compare(key, "lt", value)


def gte(key: str, value: float) -> Predicate:
    return Compare(key, "gte", value)


def lte(key: str, value: float) -> Predicate:
    return Compare(key, "lte", value)


def and_(*parts: Predicate) -> Predicate:
    """True without parts."""
    return All(parts)


def or_(*parts: Predicate) -> Predicate:
    """False without parts."""
    return Any(parts)


def not_(part: Predicate) -> Predicate:
    return Not(part)


def test(function: Callable, *keys: str) -> Predicate:
    return Callback(keys, function)
