"""Pages of record files: where they are cut, their numbers, and the queries on them beyond one Arrow batch."""

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina.plans import source_queries
from lamina.sources import record_source
from lamina.sources.record_source import RecordSource, files, mapped, register


def _sizes(path):
    return [[p.n for p in mapped(f).pages] for f in files(str(path))]


@pytest.fixture
def events(spark, tmp_path):
    """Two Arrow batches of 10,000 rows and half a one: 81 pages, of which the last has 20 records."""
    made = spark.range(20500).select(F.col("id").alias("event_id"), F.timestamp_micros(F.col("id") * 1000).alias("ts"), (F.col("id") % 97).alias("user_id"), F.when(F.col("id") % 3 > 0, "click").otherwise("view").alias("event_type"), (F.col("id") % 1013 / 100).alias("value"), F.lit("{}").alias("props"))
    made.write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_pages_span_batches(spark, tmp_path):
    register(spark)
    spark.range(0, 20500, 1, 1).write.format("records").mode("append").option("layout", "paged").option("page_records", 256).save(str(tmp_path / "a"))
    assert _sizes(tmp_path / "a") == [[256] * 80 + [20]]
    spark.range(0, 256, 1, 1).filter("id < 0").write.format("records").mode("append").option("layout", "paged").save(str(tmp_path / "b"))
    assert _sizes(tmp_path / "b") == [[]]


@pytest.mark.parametrize(("sizes", "most", "wanted"), [([100, 0, 3, 250, 7], 64, [64] * 5 + [40]), ([64, 64], 64, [64, 64]), ([], 64, []), ([1] * 5, 2, [2, 2, 1]), ([5], 64, [5])])
def test_pages_are_full(sizes, most, wanted):
    ids = iter(range(10**6))
    batches = [pa.RecordBatch.from_pydict({"id": pa.array([next(ids) for _ in range(n)], pa.int64())}) for n in sizes]
    cut = list(record_source._pages(iter(batches), most))
    assert [len(b) for b in cut] == wanted
    assert [v for b in cut for v in b.column(0).to_pylist()] == list(range(sum(sizes)))


def test_pages_of_large_records_end_sooner(monkeypatch):
    """Rows of 1 kB where a page takes 10 kB: no page of several batches is larger, and no row is lost."""
    monkeypatch.setattr(record_source, "_PAGE_BYTES", 10_000)
    batches = [pa.RecordBatch.from_pydict({"text": [f"{k:03d}{i}" * 250 for i in range(4)]}) for k in range(9)]
    cut = list(record_source._pages(iter(batches), 100))
    assert [len(b) for b in cut] == [8, 8, 8, 8, 4] and all(b.nbytes <= 10_000 for b in cut)
    assert pa.Table.from_batches(cut) == pa.Table.from_batches(batches).combine_chunks()


def test_page_numbers(spark, tmp_path):
    """Through the files, whatever the partitions and filters; null in other layouts."""
    register(spark)
    for k, layout in enumerate(["paged", "row", "paged"]):
        spark.range(1000 * k, 1000 * k + 300, 1, 1).write.format("records").mode("append").option("layout", layout).option("page_records", 128).save(str(tmp_path / str(k)))
        (path,) = files(str(tmp_path / str(k)))
        (tmp_path / f"{k}.rec").write_bytes(open(path, "rb").read())
    want = [(r, page) for r, page in enumerate([0] * 128 + [1] * 128 + [2] * 44 + [None] * 300 + [3] * 128 + [4] * 128 + [5] * 44)]
    read = spark.read.format("records").option("pages", "true")
    for options in ({}, {"records_per_partition": "1"}, {"columns": "id"}):
        got = read.options(**options).load(str(tmp_path))
        assert got.columns == ["_rec", "_page", "id"]
        assert sorted(map(tuple, got.select("_rec", "_page").collect())) == want
        assert [tuple(r) for r in got.filter("_rec in (127, 299, 300, 600, 728)").orderBy("_rec").select("_rec", "_page").collect()] == [want[i] for i in (127, 299, 300, 600, 728)]
    parts = RecordSource({"path": str(tmp_path / "2.rec"), "records_per_partition": "1"}).reader(None).partitions()
    assert [(p.start, p.stop) for p in parts] == [(0, 128), (128, 256), (256, 300)]
    assert spark.read.format("records").load(str(tmp_path)).columns == ["_rec", "id"]


@pytest.mark.parametrize("name", ["s11_page_partitions", "s12_describe"])
def test_query_beyond_a_batch(spark, events, name):
    df = source_queries.QUERIES[name](spark, events)
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{events}/events.parquet/*.parquet'")
    found = con.execute(source_queries.ORACLE[name])
    assert df.columns == [d[0] for d in found.description]
    assert sorted(map(tuple, df.collect())) == sorted(found.fetchall())
