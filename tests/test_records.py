"""Predicates, records and reducers on the cases that tables lack: nulls, NaN, unknown keys, other kinds, nothing."""

import math

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.functions import access, text
from lamina.operators import reducers
from lamina.operators.predicates import and_, eq, gt, gte, lt, lte, neq, not_, or_
from lamina.operators.predicates import test as callback
from lamina.operators.records import Records

ROWS = [(0, 1.0, "a", True), (1, None, "b", None), (2, math.nan, None, False), (3, math.inf, "a", True), (4, -5.0, "", False)]


@pytest.fixture
def records(spark):
    return Records(spark.createDataFrame(ROWS, "_rec long, v double, s string, b boolean"))


@pytest.mark.parametrize(
    ("predicate", "want"),
    [
        (gt("v", 0), [0, 3]), (not_(gt("v", 0)), [1, 2, 4]), (lt("v", 0.5), [4]), (gte("v", 1), [0, 3]), (lte("v", 1), [0, 4]),
        (eq("v", 1), [0]), (neq("v", 1), [1, 2, 3, 4]), (eq("v", math.nan), []), (not_(eq("v", math.nan)), [0, 1, 2, 3, 4]),
        (eq("s", "a"), [0, 3]), (neq("s", "a"), [1, 2, 4]), (eq("b", True), [0, 3]), (not_(eq("b", True)), [1, 2, 4]),
        (eq("b", 1), []), (eq("v", True), []), (eq("s", 1), []), (eq("v", "1"), []), (gt("s", 0), []), (gt("b", 0), []), (not_(gt("s", 0)), [0, 1, 2, 3, 4]),
        (eq("nope", 1), []), (~eq("nope", 1), [0, 1, 2, 3, 4]), (and_(), [0, 1, 2, 3, 4]), (or_(), []), (not_(and_()), []),
        (eq("s", "a") & gt("v", 1), [3]), (eq("s", "b") | lt("v", 0), [1, 4]), (not_(or_(eq("s", "b"), lt("v", 0))), [0, 2, 3]),
        (eq("v", 1 << 70), []), (lt("v", 1 << 70), [0, 4]), (callback(lambda r: r["v"] > 0, "v"), [0, 3]),
        (callback(lambda r: r["v"] > 0, "v", "nope"), []), (not_(callback(lambda r: r["v"] > 0, "nope")), [0, 1, 2, 3, 4]),
    ],
)
def test_predicates(records, predicate, want):
    assert sorted(r["_rec"] for r in records.where(predicate).df.collect()) == want
    strict = predicate.strict(records.df.schema)
    assert records.df.filter(strict.isNull()).count() == 0


def test_pushdown(spark):
    events = Records(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "event_id")
    plan = events.where(and_(eq("event_type", "click"), gt("value", 80.0))).df.select("event_id", "value")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan and "GreaterThan(value,80.0)" in plan and "props" not in plan.split("ReadSchema")[1]


def test_terminals(records):
    assert records.count() == 5 and records.first()["_rec"] == 0 and records.where(eq("nope", 1)).first() is None
    assert [r["_rec"] for r in records.iterate()] == [0, 1, 2, 3, 4]
    assert [r["_rec"] for r in records.take(2).collect()] == [0, 1]
    assert records.lookup([4, 1, 99]).count() == 2 and records.between(1, 3).count() == 3 and records.record(9).count() == 0
    assert records.lookup(list(range(2, 3000))).count() == 3
    assert records.slot("s") == 2 and records.slot("nope") == -1
    assert records.column_buffer("s").to_pylist() == ["a", "b", None, "a", ""]
    values, absent = records.column_numpy("v")
    assert values[[0, 1, 4]].tolist() == [1.0, 0.0, -5.0] and absent.tolist() == [False, True, False, False, False]
    assert records.get(0, "s") == "a" and records.get(1, "v") is None and records.get(1, "v", 7) == 7 and records.get(99, "v", 8) == 8 and records.get(0, "nope", 9) == 9


def test_batches_and_warm_columns(records):
    def doubled(batches):
        for b in batches:
            yield b.set_column(1, "v", pa.array([None if v is None else 2 * v for v in b.column(1).to_pylist()], pa.float64()))

    got = {r["_rec"]: r["v"] for r in records.map_batches(doubled, "_rec long, v double", "v").collect()}
    assert got[0] == 2.0 and got[1] is None and got[4] == -10.0
    warm = records.warmed("v", "s")
    assert warm.df.columns == ["_rec", "v", "s"] and warm.count() == 5 and warm.df.is_cached
    warm.release()
    assert not warm.df.is_cached


def test_reducers(spark, records):
    got = records.where(neq("_rec", 2)).reduce(total=("sum_f64", "v"), least=("min_f64", "v"), greatest=("max_f64", "v"), n=("count", "v")).first()
    assert (got["total"], got["least"], got["greatest"], got["n"]) == (math.inf, -5.0, math.inf, 3)
    nan = records.reduce(least=("min_f64", "v"), greatest=("max_f64", "v"), total=("sum_f64", "v")).first()
    assert nan["least"] == -5.0 and nan["greatest"] == math.inf and math.isnan(nan["total"])
    only = spark.createDataFrame([(0, math.inf)], "_rec long, v double")
    assert Records(only).reduce(least=("min_f64", "v")).first()[0] == math.inf
    with pytest.raises(reducers.UnknownField):
        records.reduce(x=("sum_f64", "nope"))
    with pytest.raises(TypeError):
        records.reduce(x=("sum_f64", "s"))


@pytest.mark.parametrize("values", [[(1 << 63) - 1, 1], [-(1 << 63), -1, -1], [5], [], [(1 << 63) - 1] * 5])
def test_overflow(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "i long")
    wrapped = (sum(values) + (1 << 63)) % (1 << 64) - (1 << 63)
    assert df.agg(reducers.sum_i64(df, "i", "wrap").alias("x")).first()["x"] == wrapped
    fits = -(1 << 63) <= sum(values) < 1 << 63
    assert df.agg(reducers.sum_i64(df, "i", "null").alias("x")).first()["x"] == (sum(values) if fits else None)


def test_uniform(spark, records):
    assert records.is_uniform().first()["uniform"] is False
    assert reducers.is_uniform(spark.createDataFrame([(1, None), (2, None)], "a long, b long")).first()["uniform"] is True
    assert reducers.is_uniform(spark.createDataFrame([], "a long")).first()["uniform"] is True


def test_text(spark):
    df = spark.createDataFrame([(0, True, 7, 1.5, None, 'a"b\n', [1, 2])], "_rec long, b boolean, i long, f double, n string, s string, l array<long>")
    assert text.dump(df, "_rec").first()["line"] == '{ b: ?true i: =7 f: ~1.5 n: ^ s: "a\\"b\\n" l: [=1, =2] }'
    assert spark.range(1).select(text.time_ns_date(F.lit(86_400_000_000_000 - 400_000))).first()[0].isoformat() == "1970-01-02"


def test_numbers(spark):
    """Doubles in the fewest digits, marks in lists by value, keywords."""
    shown = {1.5: "1.5", 100.0: "100", -0.0: "0", 0.1: "0.1", 1e-6: "0.000001", 1.25e-7: "1.25e-7", 1e-7: "1e-7", 12345678.9: "12345678.9", 1e20: "100000000000000000000", 1e21: "1e+21", 1.5e300: "1.5e+300", -2.5e-10: "-2.5e-10", 0.30000000000000004: "0.30000000000000004", 123456789012345.67: "123456789012345.67", math.inf: "Infinity"}
    df = spark.createDataFrame([(v,) for v in shown], "v double")
    assert {r["v"]: r["s"] for r in df.select("v", text.number(F.col("v")).alias("s")).collect()} == shown
    df = spark.createDataFrame([(0, [1.0, 2.5, None, -3.0], "word", None, [True], ["x"])], "_rec long, l array<double>, k string, k2 string, b array<boolean>, s array<string>")
    assert text.dump(df, "_rec", keywords=("k", "k2")).first()["line"] == '{ l: [=1, ~2.5, ^, =-3] k: $word k2: ^ b: [?true] s: ["x"] }'


def test_pages_coalesce(spark):
    pages = spark.createDataFrame([(p,) for p in (3, 4, 6, 7, 12)], "page long")
    runs = lambda gap: sorted(map(tuple, access.coalesced_pages(pages, "page", gap).select("first_page", "last_page").collect()))
    assert runs(1) == [(3, 4), (6, 7), (12, 12)] and runs(2) == [(3, 7), (12, 12)] and runs(5) == [(3, 12)]
    assert runs(0) == [(p, p) for p in (3, 4, 6, 7, 12)]
    assert {tuple(r) for r in access.byte_ranges(access.coalesced_pages(pages, "page", 1), 100).select("byte_start", "byte_length").collect()} == {(300, 200), (600, 200), (1200, 100)}


def test_patterns(spark):
    """By jumps: near at most 10, far beyond 100, others don't count."""
    jumps = {"seven": [1] * 7, "near": [1] * 8, "three to one": [1] * 9 + [500] * 3, "more": [1] * 10 + [500] * 3, "far": [1] * 4 + [500] * 5, "tie": [1] * 4 + [500] * 4, "between": [50] * 20, "few and between": [50] * 20 + [1] * 7, "back": [-500] * 8, "edge": [10] * 7 + [101]}
    rows = []
    for who, steps in jumps.items():
        at = 10_000
        rows.append((who, 0, at))
        for t, step in enumerate(steps, 1):
            at += step
            rows.append((who, t, at))
    found = access.patterns(spark.createDataFrame(rows, "who string, t long, record long"), "who", "t", "record")
    got = {r["who"]: r["pattern"] for r in found.collect()}
    assert got == {"seven": "unknown", "near": "sequential", "three to one": "mixed", "more": "sequential", "far": "random", "tie": "mixed", "between": "unknown", "few and between": "unknown", "back": "random", "edge": "sequential"}
    ahead = {(r["who"], r["record"]) for r in access.predicted(found, "who", 3, 10_011).collect()}
    assert ahead == {("near", 10_009), ("near", 10_010)}
    mb = 1 << 20
    sizes = spark.createDataFrame([("full", 11 * mb - 1), ("full", 11 * mb), ("full", 51 * mb), ("none", 1), ("none", 51 * mb - 1)], "hint string, size long")
    assert [r[0] for r in sizes.select(access.strategy(F.col("hint"), F.col("size"))).collect()] == ["eager", "adaptive", "lazy", "adaptive", "adaptive"]


def test_running_over_many_chunks(spark):
    rows = [(i, (i * 7919) % 101) for i in range(0, 3000, 3)]
    df = spark.createDataFrame(rows, "i long, v long").repartition(5)
    sums = {r["i"]: r["t"] for r in access.running(df, "i", F.col("v"), "sum", "t", chunk=64).collect()}
    tops = {r["i"]: r["t"] for r in access.running(df, "i", F.when(F.col("v") > 90, F.col("v")), "max", "t", chunk=64).collect()}
    total, top = 0, None
    for i, v in rows:
        total += v
        top = max(top or 0, v) if v > 90 else top
        assert sums[i] == total and tops[i] == top
    by = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2), ("b", 9000), ("b", 9001)], "who string, page long")
    got = sorted(map(tuple, access.coalesced_pages(by, "page", 1, "who").select("who", "first_page", "last_page", "n_pages").collect()))
    assert got == [("a", 1, 1, 1), ("a", 3, 3, 1), ("b", 2, 2, 1), ("b", 9000, 9001, 2)]
