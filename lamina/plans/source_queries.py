"""Queries through the binary record format: tables written in each layout, read back, looked up and streamed."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.operators.predicates import and_, eq, gt
from lamina.operators.records import Records
from lamina.sources.record_source import counted, describe, files, ranged, read_anywhere, register
from lamina.sources.scratch import scratch
from lamina.streaming.running import append, arriving, running_sum


def _stored(spark: SparkSession, sf_dir: str, layout: str, *columns: str, files: int = 4) -> str:
    """Events in record files, in the order of their ids, so that the ordinal is the id."""
    register(spark)
    path = scratch(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(*columns)
    ordered = events.repartitionByRange(files, "event_id").sortWithinPartitions("event_id")
    ordered.write.format("records").mode("append").option("layout", layout).option("page_records", 256).save(path)
    return path


def _read(spark: SparkSession, path: str, **options: str) -> Records:
    return Records(spark.read.format("records").options(**options).load(path))


def row_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _read(spark, _stored(spark, sf_dir, "row", "event_id", "ts", "user_id", "event_type", "value"))
    return records.df.select(F.col("_rec").alias("rec"), "event_id", F.col("ts").alias("ts_ns"), "user_id", "event_type", "value")


def columnar_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _read(spark, _stored(spark, sf_dir, "columnar", "event_id", "user_id", "value"), columns="user_id,value")
    found = records.reduce(total=("sum_f64", "value"), users=("sum_i64", "user_id"), least=("min_f64", "value"), greatest=("max_f64", "value"))
    return found.withColumn("total", F.round("total", 2))


def paged_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _read(spark, _stored(spark, sf_dir, "paged", "event_id", "event_type", "value"))
    kept = records.where(and_(eq("event_type", "click"), gt("value", 80.0)))
    return kept.df.groupBy(F.expr("_rec div 256").alias("page")).agg(F.count("*").alias("n"))


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _read(spark, _stored(spark, sf_dir, "row", "event_id", "event_type"))
    return records.lookup([0, 42, 255, 256, 999]).select("event_id", "event_type")


def whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_anywhere(spark, _stored(spark, sf_dir, "paged", "event_id", "event_type"), ["event_type"]).groupBy("event_type").agg(F.count("*").alias("n"))


def paged_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer and floating reducers over pages, in one scan."""
    records = _read(spark, _stored(spark, sf_dir, "paged", "event_id", "user_id", "value"))
    found = records.reduce(total=("sum_f64", "value"), users=("sum_i64", "user_id"), least=("min_f64", "value"), greatest=("max_f64", "value"), first_user=("min_f64", "user_id"), last_user=("max_f64", "user_id"))
    return found.withColumn("total", F.round("total", 2)).withColumns({c: F.col(c).cast("long") for c in ("first_user", "last_user")})


def paged_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page of the file (256 records) summed by itself. A partition has whole pages, many of them: a task costs Spark
    some 0.1 CPU seconds, as much as thousands of records."""
    path = _stored(spark, sf_dir, "paged", "event_id", "value", files=1)
    pages = _read(spark, path, pages="true").df.withColumn("page", F.col("_page").cast("int"))
    return pages.groupBy("page").agg(F.min("_rec").alias("first"), F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("part"))


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What heads and tails tell of a paged file."""
    found = describe(spark, _stored(spark, sf_dir, "paged", "event_id", "event_type", "value", files=1))
    return found.select("layout", "records", "pages", F.array_join("keys", ",").alias("keys"), "marks", "sealed")


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Booleans, binary, nanoseconds, dates and absent values of every kind, through rows."""
    register(spark)
    path = scratch(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    gone = F.col("event_id") % 3 == 0
    absent = lambda c: F.when(~gone, c)
    kinds = events.select("event_id", absent(F.col("value") > 50).alias("flag"), absent(F.col("event_type").cast("binary")).alias("raw"), absent(F.col("ts")).alias("at"), absent(F.to_date("ts")).alias("day"), absent(F.col("value")).alias("value"), absent(F.col("event_type")).alias("kind"))
    kinds.repartition(3, "event_id").write.format("records").mode("append").save(path)
    return _read(spark, path).df.select("event_id", "flag", F.hex("raw").alias("raw"), "at", "day", "value", "kind")


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists and nested records, some absent, through rows."""
    register(spark)
    path = scratch(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    some = events.select("event_id", F.when(F.col("event_id") % 5 > 0, F.struct(F.col("user_id").alias("who"), F.struct(F.col("value").alias("amount")).alias("what"))).alias("by"), F.when(F.col("event_id") % 2 > 0, F.array("event_id", "user_id")).alias("longs"), F.array(F.col("value"), F.col("value") * 2).alias("doubles"))
    some.repartition(2, "event_id").write.format("records").mode("append").save(path)
    records = _read(spark, path)
    return records.df.select("event_id", records.column("by.who").alias("who"), records.column("by.what.amount").alias("amount"), F.size("longs").alias("n"), F.get("longs", F.lit(1)).alias("second"), F.get("doubles", F.lit(1)).alias("twice"))


def columnar_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings with absent values in columnar files of 700 records at most."""
    register(spark)
    path = scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.when(F.col("doc_id") % 4 > 0, F.col("text")).alias("text"), "lang")
    docs.repartition(2, "doc_id").write.format("records").mode("append").option("layout", "columnar").option("records_per_file", 700).save(path)
    return _read(spark, path, columns="doc_id,text").df.select("doc_id", F.md5("text").alias("digest"))


def by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte ranges of files fetched by a function, a few columns of them."""
    path = _stored(spark, sf_dir, "columnar", "event_id", "user_id", "event_type", "value")
    sizes = {f: os.path.getsize(f) for f in files(path)}
    return ranged(spark, sizes, columns=["event_id", "event_type"], records_per_partition=500).select(F.col("_rec").alias("rec"), "event_id", "event_type")


def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact rows: dense, narrow integers, packed booleans, pooled strings, a delta tail."""
    register(spark)
    path = scratch(spark)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("user_id").cast("int").alias("user_id"), (F.col("value") > 50).alias("large"), (F.col("user_id") % 2 == 0).alias("even"), "event_type", "props", "value")
    ordered = events.repartitionByRange(3, "event_id").sortWithinPartitions("event_id")
    ordered.write.format("records").mode("append").option("layout", "compact").option("pooled", "event_type").save(path)
    return _read(spark, path).df.withColumnRenamed("_rec", "rec")


def metadata_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a folder, counted without a look at any."""
    return counted(spark, _stored(spark, sf_dir, "columnar", "event_id", "value"))


def stream_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running sum of a folder of files, taken in by a stream until nothing more is there."""
    path = _stored(spark, sf_dir, "paged", "event_id", "value")
    name = "sums_" + path.rsplit("-", 1)[1]
    query = running_sum(arriving(spark, path), "value").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select(F.round("total", 2).alias("total"), "n")


def stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of several files as they arrive, some before the stream has started once, some after; counted by kind."""
    path, later = _stored(spark, sf_dir, "row", "event_id", "event_type", "user_id"), scratch(spark)
    every = files(path)
    for f in every[2:]:
        os.replace(f, os.path.join(later, os.path.basename(f)))
    out, at = scratch(spark), scratch(spark)
    for turn in range(2):
        append(arriving(spark, path), out, at).awaitTermination()
        if not turn:
            for f in every[2:]:
                os.replace(os.path.join(later, os.path.basename(f)), f)
    return _read(spark, out).df.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("user_id").cast("long").alias("users"))


def stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that arrive are appended in the record format by a stream, then read."""
    register(spark)
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    arrived = scratch(spark)
    spark.read.parquet(source).select("event_id", "value").write.mode("overwrite").parquet(f"{arrived}/in")
    rows = spark.readStream.schema(schema.__class__([f for f in schema if f.name in ("event_id", "value")])).parquet(f"{arrived}/in")
    out = scratch(spark)
    append(rows, out, scratch(spark)).awaitTermination()
    return _read(spark, out).df.select("event_id", "value")


QUERIES = {
    "s01_row_round_trip": row_round_trip,
    "s02_columnar_reduce": columnar_reduce,
    "s03_paged_query": paged_query,
    "s04_lookup": lookup,
    "s05_whole_files": whole_files,
    "s06_stream_sum": stream_sum,
    "s07_stream_append": stream_append,
    "s08_compact_rows": compact,
    "s09_stream_rows": stream_rows,
    "s10_paged_reduce": paged_reduce,
    "s11_page_partitions": paged_partitions,
    "s12_describe": described,
    "s13_typed_rows": typed,
    "s14_nested_rows": nested,
    "s15_columnar_strings": columnar_strings,
    "s16_ranged_reads": by_ranges,
    "s17_metadata_count": metadata_count,
}
ORACLE = {
    "s01_row_round_trip": "select event_id rec, event_id, epoch_us(ts) * 1000 ts_ns, user_id, event_type, value from events",
    "s02_columnar_reduce": "select round(sum(value), 2) total, sum(user_id)::bigint users, min(value) least, max(value) greatest from events",
    "s03_paged_query": "select event_id // 256 page, count(*) n from events where event_type = 'click' and value > 80 group by 1",
    "s04_lookup": "select event_id, event_type from events where event_id in (0, 42, 255, 256, 999)",
    "s05_whole_files": "select event_type, count(*) n from events group by 1",
    "s06_stream_sum": "select round(sum(value), 2) total, count(*) n from events",
    "s07_stream_append": "select event_id, value from events",
    "s08_compact_rows": "select event_id rec, event_id, user_id, value > 50 large, user_id % 2 = 0 even, event_type, props, value from events",
    "s09_stream_rows": "select event_type, count(*) n, sum(user_id)::bigint users from events group by 1",
    "s10_paged_reduce": "select round(sum(value), 2) total, sum(user_id)::bigint users, min(value) least, max(value) greatest, min(user_id) first_user, max(user_id) last_user from events",
    "s11_page_partitions": "select (event_id // 256)::int page, min(event_id) \"first\", count(*) n, round(sum(value), 2) part from events group by 1",
    "s12_describe": "select 'paged' layout, count(*) records, ceil(count(*) / 256)::int pages, 'event_id,event_type,value' keys, '=\"~' marks, true sealed from events",
    "s13_typed_rows": "select event_id, case when g then value > 50 end flag, case when g then upper(hex(event_type::blob)) end raw, case when g then epoch_us(ts) * 1000 end \"at\", case when g then epoch_us(ts::date::timestamp) * 1000 end \"day\", case when g then value end \"value\", case when g then event_type end kind from (select *, event_id % 3 <> 0 g from events)",
    "s14_nested_rows": "select event_id, case when event_id % 5 > 0 then user_id end who, case when event_id % 5 > 0 then value end amount, case when event_id % 2 > 0 then 2 end n, case when event_id % 2 > 0 then user_id end \"second\", value * 2 twice from events",
    "s15_columnar_strings": "select doc_id, case when doc_id % 4 > 0 then md5(text) end digest from documents",
    "s16_ranged_reads": "select event_id rec, event_id, event_type from events",
    "s17_metadata_count": "select count(*) n from events",
}
