"""Records: a DataFrame with an ordinal column, queried lazily."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lamina.operators import reducers
from lamina.operators.predicates import Predicate, field_of

#: Ordinals up to which a batch lookup is a list in the filter, which scans can use.
_LISTED = 1000


class Records:
    """Records in the order of ``rec``, a unique ordinal. Everything returns DataFrames or Records, but for
    ``count``, ``first``, ``iterate`` and ``materialise``, which run."""

    def __init__(self, df: DataFrame, rec: str = "_rec"):
        if rec not in df.columns:
            raise ValueError(f"no column {rec} to order records by")
        self.df, self.rec = df, rec

    # -- schema
    @property
    def keys(self) -> list[str]:
        return [c for c in self.df.columns if c != self.rec]

    def slot(self, key: str) -> int:
        """Place of a key; -1 if there is none."""
        return self.df.columns.index(key) if key in self.df.columns else -1

    def column(self, key: str) -> Column:
        """A field or dotted path; null where any segment is absent, and for unknown keys."""
        found = field_of(self.df.schema, key)
        return found[0] if found else F.lit(None)

    # -- filters
    def all(self) -> Records:
        return self

    def where(self, predicate: Predicate) -> Records:
        return Records(self.df.filter(predicate.loose(self.df.schema)), self.rec)

    def between(self, first: int, last: int) -> Records:
        """Records from ordinal ``first`` to ``last``, both included."""
        return Records(self.df.filter(F.col(self.rec).between(first, last)), self.rec)

    def record(self, i: int) -> Records:
        return Records(self.df.filter(F.col(self.rec) == i), self.rec)

    def lookup(self, ordinals: list[int]) -> Records:
        """Records at these ordinals; a long list becomes a semi-join."""
        if len(ordinals) <= _LISTED:
            return Records(self.df.filter(F.col(self.rec).isin(ordinals)), self.rec)
        wanted = self.df.sparkSession.createDataFrame([(i,) for i in ordinals], T.StructType([T.StructField(self.rec, T.LongType())]))
        return Records(self.df.join(wanted, self.rec, "left_semi"), self.rec)

    # -- terminals
    def counted(self) -> DataFrame:
        return self.df.agg(F.count("*").alias("n"))

    def count(self) -> int:
        return self.counted().first()["n"]

    def take(self, n: int) -> DataFrame:
        return self.df.orderBy(self.rec).limit(n)

    def first(self) -> dict | None:
        rows = self.take(1).collect()
        return rows[0].asDict(recursive=True) if rows else None

    def iterate(self) -> Iterator[dict]:
        """Records as dictionaries, in order, fetched a partition at a time."""
        return (r.asDict(recursive=True) for r in self.df.orderBy(self.rec).toLocalIterator())

    def materialise(self) -> list[dict]:
        return list(self.iterate())

    # -- projection
    def select(self, *keys: str) -> DataFrame:
        return self.df.select(*(self.column(k).alias(k) for k in keys))

    def slots(self, *places: int) -> DataFrame:
        return self.df.select(*(F.col(f"`{self.df.columns[p]}`") for p in places))

    def has_field(self, key: str) -> DataFrame:
        return self.df.select(self.rec, self.column(key).isNotNull().alias("has_field"))

    def null_bitmap(self, key: str) -> DataFrame:
        return self.df.select(self.rec, self.column(key).isNull().alias("is_null"))

    def scan(self, key: str) -> DataFrame:
        """The ordinal and one field, absent values as null."""
        return self.df.select(self.rec, self.column(key).alias(key))

    def column_buffer(self, key: str):
        """A column as an Arrow chunked array, in record order."""
        return self.scan(key).orderBy(self.rec).toArrow().column(key)

    def column_numpy(self, key: str):
        """A column of numbers as a numpy array, in record order, and which of them are absent (those read as 0)."""
        column = self.column_buffer(key).combine_chunks()
        absent = column.is_null().to_numpy(zero_copy_only=False)
        return column.fill_null(0).to_numpy(zero_copy_only=False), absent

    def get(self, i: int, key: str, default: object = None) -> object:
        """One field of one record; ``default`` where the record, the field or its value is absent."""
        if field_of(self.df.schema, key) is None:
            return default
        found = self.record(i).df.select(self.column(key)).limit(1).collect()
        return default if not found or found[0][0] is None else found[0][0]

    def to_json(self) -> DataFrame:
        """Each record whole, absent fields left out."""
        return self.df.select(self.rec, F.to_json(F.struct(*(F.col(f"`{k}`") for k in self.keys))).alias("json"))

    # -- whole scans and warm columns
    def map_batches(self, function: Callable[[Iterator], Iterator], schema: str, *keys: str) -> DataFrame:
        """``function`` over Arrow batches of the ordinal and some fields: a scan with a callback."""
        return self.df.select(self.rec, *(self.column(k).alias(k) for k in keys)).mapInArrow(function, schema)

    def warmed(self, *keys: str) -> Records:
        """The ordinal and some fields (all, without keys), kept by the executors once read; ``release`` lets them go."""
        kept = self.df.select(self.rec, *(self.column(k).alias(k) for k in keys)) if keys else self.df
        return Records(kept.persist(), self.rec)

    def release(self) -> None:
        self.df.unpersist()

    # -- reducers
    def reduce(self, **wanted: tuple[str, str]) -> DataFrame:
        return reducers.reduce(self.df, **wanted)

    def is_uniform(self) -> DataFrame:
        return reducers.is_uniform(self.df.select(*self.keys))
