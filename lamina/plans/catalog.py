"""Named queries over the star schema and their DuckDB equivalents.

Every query goes through the operators; the SQL says what it should give. Sums of doubles are rounded on both sides,
as their order differs. Null and NaN cases are derived, as the tables have neither.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lamina.functions import access, text
from lamina.functions.spans import spans
from lamina.operators import reducers
from lamina.operators.predicates import Predicate, and_, eq, gt, gte, lt, lte, neq, not_, or_
from lamina.operators.predicates import test as callback
from lamina.operators.records import Records
from lamina.plans import source_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> Records:
    return Records(_table(spark, sf_dir, "events"), "event_id")


def orders(spark: SparkSession, sf_dir: str) -> Records:
    return Records(_table(spark, sf_dir, "orders").withColumn("is_urgent", F.col("o_orderpriority") == "1-URGENT"), "o_orderkey")


def _sparse(records: Records) -> Records:
    """With ``v``: the value, absent for every third record; and ``w``: NaN for every fifth."""
    i = F.col(records.rec)
    return Records(records.df.withColumn("v", F.when(i % 3 != 0, F.col("value"))).withColumn("w", F.when(i % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))), records.rec)


_SPARSE = "(select *, case when event_id % 3 <> 0 then value end v, case when event_id % 5 = 0 then 'nan'::double else value end w from events)"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks above 80, counted by page of 256 records."""
    kept = events(spark, sf_dir).where(and_(eq("event_type", "click"), gt("value", 80.0)))
    return kept.df.groupBy(F.expr("event_id div 256").alias("page")).agg(F.count("*").alias("n"))


_query("q00_flagship", "select event_id // 256 page, count(*) n from events where event_type = 'click' and value > 80 group by 1")(flagship)


def _count(name: str, table: str, predicate: Predicate, where: str) -> None:
    """A counted filter over events, orders, lineitem, part or events with absent values."""

    @_query(name, f"select count(*) n from {table if table != 'sparse' else _SPARSE} where {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if table == "sparse":
            return _sparse(events(spark, sf_dir)).where(predicate).counted()
        df = orders(spark, sf_dir).df if table == "orders" else _table(spark, sf_dir, table)
        return Records(df, df.columns[0]).where(predicate).counted()


_query("q01_all_count", "select count(*) n from events")(lambda s, d: events(s, d).all().counted())
_count("q02_eq_string", "events", eq("event_type", "click"), "event_type = 'click'")
_query("q03_eq_i64", "select * from events where user_id = 13")(lambda s, d: events(s, d).where(eq("user_id", 13)).df)
_count("q04_eq_f64", "lineitem", eq("l_discount", 0.07), "l_discount = 0.07")
_count("q05_eq_bool", "orders", eq("is_urgent", True), "o_orderpriority = '1-URGENT'")
_count("q06_gt_f64", "events", gt("value", 80.0), "value > 80")
_count("q07_lt_f64", "events", lt("value", 40.0), "value < 40")
_count("q08_gte_f64", "events", gte("value", 80), "value >= 80")
_count("q09_lte_f64", "events", lte("value", 40), "value <= 40")
_count("q10_gt_i64", "part", gt("p_size", 30), "p_size > 30")
_count("q11_and", "events", and_(eq("event_type", "click"), gt("value", 80.0)), "event_type = 'click' and value > 80")
_count("q12_or", "events", or_(gt("value", 200.0), lt("value", 5.0)), "value > 200 or value < 5")
_count("q13_not", "events", not_(eq("event_type", "click")), "not event_type = 'click'")
_count("q14_not_with_null", "sparse", not_(gt("v", 80.0)), "not coalesce(v > 80, false)")
_count("q15_nested_boolean", "sparse", or_(and_(eq("event_type", "click"), not_(gt("v", 40))), lt("value", 5.0)), "(event_type = 'click' and not coalesce(v > 40, false)) or value < 5")
_count("q16_unknown_key", "events", eq("nope", 1), "false")
_count("q17_type_mismatch", "events", eq("value", "x"), "false")
_count("q17b_order_on_string", "events", or_(gt("event_type", 1), lt("event_type", 1)), "false")
_count("q17c_not_unknown_key", "events", not_(eq("nope", 1)), "true")
_count("q18_nan_compare", "sparse", or_(gt("w", -1.0), lte("w", -1.0)), "not isnan(w) and (w > -1 or w <= -1)")
_count("q18b_neq_nan", "sparse", neq("w", 10.0), "not (not isnan(w) and w = 10)")
_count("q18c_empty_and", "events", and_(), "true")
_count("q18d_empty_or", "events", or_(), "false")
_count("q18e_callback", "events", callback(lambda r: r["value"] * 2 > r["user_id"], "value", "user_id"), "value * 2 > user_id")

_query("q19_first", "select * from events where event_type = 'error' order by event_id limit 1")(lambda s, d: events(s, d).where(eq("event_type", "error")).take(1))
_query("q20_first_none", "select * from events where false")(lambda s, d: events(s, d).where(eq("event_type", "no such")).take(1))
_query("q21_take", "select * from events where event_type = 'purchase' order by event_id limit 10")(lambda s, d: events(s, d).where(eq("event_type", "purchase")).take(10))
_query("q22_record_range", "select * from events where event_id between 100 and 199")(lambda s, d: events(s, d).between(100, 199).df)
_query("q23_record_at", "select * from events where event_id = 42")(lambda s, d: events(s, d).record(42).df)
_query("q24_batch_lookup", "select * from events where event_id in (0, 42, 99)")(lambda s, d: events(s, d).lookup([0, 42, 99]).df)
_query("q24b_long_lookup", "select event_id, value from events where event_id % 3 = 0 and event_id < 6000")(lambda s, d: events(s, d).lookup(list(range(0, 6000, 3))).select("event_id", "value"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 2) for n in names})


_query("q25_sum_f64", "select round(sum(value), 2) total from events")(lambda s, d: _rounded(events(s, d).reduce(total=("sum_f64", "value")), "total"))
_query("q26_sum_i64", "select sum(user_id)::bigint total from events")(lambda s, d: events(s, d).reduce(total=("sum_i64", "user_id")))
_query("q26b_sum_i64_wrap", "select (((sum((event_id % 900)::hugeint * 4000000000000000) % 18446744073709551616 + 9223372036854775808) % 18446744073709551616 + 18446744073709551616) % 18446744073709551616 - 9223372036854775808)::bigint total from events")(
    lambda s, d: (df := events(s, d).df.select((F.col("event_id") % 900 * 4000000000000000).alias("big"))).agg(reducers.sum_i64(df, "big", "wrap").alias("total"))
)
_query("q26c_sum_i64_wrap_all", "select (((sum((event_id % 2000)::hugeint * 4000000000000000) % 18446744073709551616 + 9223372036854775808) % 18446744073709551616 + 18446744073709551616) % 18446744073709551616 - 9223372036854775808)::bigint total from events")(
    lambda s, d: (df := events(s, d).df.select((F.col("event_id") % 2000 * 4000000000000000).alias("big"))).agg(reducers.sum_i64(df, "big", "wrap").alias("total"))
)
_query("q27_min_f64", "select min(value) least from events")(lambda s, d: events(s, d).reduce(least=("min_f64", "value")))
_query("q28_max_f64", "select max(value) greatest from events")(lambda s, d: events(s, d).reduce(greatest=("max_f64", "value")))
_query("q29_one_pass", "select round(sum(value), 2) total, sum(user_id)::bigint users, min(value) least, max(value) greatest from events")(
    lambda s, d: _rounded(events(s, d).reduce(total=("sum_f64", "value"), users=("sum_i64", "user_id"), least=("min_f64", "value"), greatest=("max_f64", "value")), "total")
)
_query("q30_sum_skips_absent", f"select round(sum(v), 2) total, count(v) n from {_SPARSE}")(lambda s, d: _rounded(_sparse(events(s, d)).reduce(total=("sum_f64", "v"), n=("count", "v")), "total"))
_query("q31_sum_empty", "select 0.0::double total, 0::bigint users")(lambda s, d: events(s, d).where(eq("nope", 1)).reduce(total=("sum_f64", "value"), users=("sum_i64", "user_id")))
_query("q32_min_empty", "select null::double least, null::double greatest")(lambda s, d: events(s, d).where(eq("nope", 1)).reduce(least=("min_f64", "value"), greatest=("max_f64", "value")))
_query("q33_min_max_nan", f"select min(w) filter (where not isnan(w)) least, max(w) filter (where not isnan(w)) greatest from {_SPARSE}")(lambda s, d: _sparse(events(s, d)).reduce(least=("min_f64", "w"), greatest=("max_f64", "w")))
_query("q34_filtered_sum", "select round(sum(value), 2) total from events where event_type = 'purchase'")(lambda s, d: _rounded(events(s, d).where(eq("event_type", "purchase")).reduce(total=("sum_f64", "value")), "total"))


def _pages(s: SparkSession, d: str) -> DataFrame:
    return events(s, d).df.groupBy(F.expr("event_id div 256").alias("page")).agg(F.sum("value").alias("part"), F.count("*").alias("n"))


_query("q35_partitioned_sum", "select event_id // 256 page, round(sum(value), 2) part, count(*) n from events group by 1")(lambda s, d: _rounded(_pages(s, d), "part"))
_query("q36_running_sum", "select page, round(sum(part) over (order by page), 2) running from (select event_id // 256 page, sum(value) part from events group by 1)")(
    lambda s, d: access.running(_pages(s, d), "page", F.col("part"), "sum", "running").select("page", F.round("running", 2).alias("running"))
)
_query("q37_is_uniform", "select false uniform")(lambda s, d: _sparse(events(s, d)).is_uniform())
_query("q37b_is_uniform_dense", "select true uniform")(lambda s, d: events(s, d).is_uniform())
_query("q38_field_index", "select event_id, value from events")(lambda s, d: reducers.field_index(events(s, d).df, "event_id", "value"))
_query("q38b_indexed_reducers", "select round(sum(value), 2) total, min(value) least, max(value) greatest, count(value) n from events where event_id % 3 = 1")(
    lambda s, d: _rounded(reducers.indexed(reducers.field_index(events(s, d).df, "event_id", "value"), events(s, d).df.filter("event_id % 3 = 1").select("event_id"), "event_id").transform(lambda i: reducers.reduce(i, total=("sum_f64", "value"), least=("min_f64", "value"), greatest=("max_f64", "value"), n=("count", "value"))), "total")
)
_query("q38c_indexed_i64", "select sum(user_id)::bigint users from events where event_id in (0, 42, 99, 256)")(
    lambda s, d: reducers.indexed(reducers.field_index(events(s, d).df, "event_id", "user_id"), [0, 42, 99, 256, 10**12], "event_id").transform(lambda i: reducers.reduce(i, users=("sum_i64", "user_id")))
)
_query("q39_projection", "select event_id, event_type from events")(lambda s, d: events(s, d).select("event_id", "event_type"))
_query("q40_slot_projection", "select event_id, user_id from events")(lambda s, d: events(s, d).slots(0, 2))
_query("q40b_wide_projection", "select l_partkey, l_returnflag, l_tax from lineitem where l_quantity > 45")(lambda s, d: Records(_table(s, d, "lineitem"), "l_orderkey").where(gt("l_quantity", 45)).select("l_partkey", "l_returnflag", "l_tax"))
_query("q41_has_field", f"select count(v) present, count(*) n from {_SPARSE}")(lambda s, d: _sparse(events(s, d)).has_field("v").agg(F.sum(F.col("has_field").cast("long")).alias("present"), F.count("*").alias("n")))
_query("q42_null_bitmap", f"select event_id, v is null is_null from {_SPARSE}")(lambda s, d: _sparse(events(s, d)).null_bitmap("v"))
_query("q43_scan_with_nulls", f"select event_id, v from {_SPARSE}")(lambda s, d: _sparse(events(s, d)).scan("v"))


def _nested(s: SparkSession, d: str) -> Records:
    e = events(s, d)
    inner = F.from_json("props", "k long")
    return Records(e.df.withColumn("p", inner).withColumn("a", F.struct(F.struct(F.col("value").alias("c"), F.col("event_type").alias("d")).alias("b"))), e.rec)


_query("q44_nested_path", "select event_id, cast(json_extract(props, '$.k') as bigint) k from events")(lambda s, d: (r := _nested(s, d)).df.select("event_id", r.column("p.k").alias("k")))
_query("q44b_nested_predicate", "select count(*) n from events where cast(json_extract(props, '$.k') as bigint) >= 50")(lambda s, d: _nested(s, d).where(gte("p.k", 50)).counted())
_query("q45_nested_absent", "select event_id, null::bigint k from events")(lambda s, d: (r := _nested(s, d)).df.select("event_id", r.column("p.nope.k").cast("long").alias("k")))
_query("q46_nested_two_level", "select event_id, value c from events")(lambda s, d: (r := _nested(s, d)).df.select("event_id", r.column("a.b.c").alias("c")))


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "embeddings")


_query("q47_list_len", "select vec_id, len(embedding)::int n from embeddings")(lambda s, d: _vectors(s, d).select("vec_id", F.size("embedding").alias("n")))
_query("q48_list_elem", "select vec_id, embedding[1] e1, embedding[64] e64, embedding[65] e65 from embeddings")(lambda s, d: _vectors(s, d).select("vec_id", *(F.get("embedding", F.lit(i - 1)).alias(f"e{i}") for i in (1, 64, 65))))
_query("q49_list_sum", "select vec_id, round(list_sum(embedding::double[]), 4) total from embeddings")(
    lambda s, d: _vectors(s, d).select("vec_id", F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))
)
_query("q50_time_ns", "select event_id, epoch_us(ts) * 1000 ns from events")(lambda s, d: events(s, d).df.select("event_id", text.time_ns(F.col("ts")).alias("ns")))
_query("q51_time_date", "select event_id, ts::date on_day from events")(lambda s, d: events(s, d).df.select("event_id", text.time_ns_date(text.time_ns(F.date_trunc("DAY", "ts"))).alias("on_day")))
_query("q51b_time_date_rounds", "select event_id, (date '1970-01-01' + (event_id % 1000 + (event_id % 2))::int) on_day from events")(
    lambda s, d: events(s, d).df.select("event_id", text.time_ns_date(F.col("event_id") % 1000 * 86_400_000_000_000 + F.when(F.col("event_id") % 2 == 1, 86_400_000_000_000 - 400_000).otherwise(400_000)).alias("on_day"))
)
_query(
    "q52b_text_dump_kinds",
    "select event_id, '{ event_type: $' || event_type || ' flag: ?' || (user_id % 2 = 0)::varchar || ' user_id: =' || user_id || ' value: ~' || rtrim(rtrim((user_id / 4.0)::decimal(18,2)::varchar, '0'), '.') || ' ts: @' || strftime(ts, '%Y-%m-%d') || "
    "' gone: ^ xs: [=' || user_id || ', =' || (user_id + 1) || '] raw: <' || upper(hex(event_type::blob)) || '> in: { a: =' || user_id || ' b: ^ } quote: \"\\\"' || event_type || '\\n\" }' line from events order by event_id limit 500",
)(
    lambda s, d: text.dump(
        events(s, d).df.select(
            "event_id", "event_type", (F.col("user_id") % 2 == 0).alias("flag"), "user_id", (F.col("user_id") / 4.0).alias("value"), "ts", F.lit(None).cast("long").alias("gone"), F.array(F.col("user_id"), F.col("user_id") + 1).alias("xs"),
            F.col("event_type").cast("binary").alias("raw"), F.struct(F.col("user_id").alias("a"), F.lit(None).cast("string").alias("b")).alias("in"), F.concat(F.lit('"'), "event_type", F.lit("\n")).alias("quote"),
        ),
        "event_id", 500, keywords=("event_type",),
    )
)
_query("q52_text_dump", "select event_id, '{ event_type: \"' || event_type || '\" user_id: =' || user_id || ' }' line from events order by event_id limit 20")(
    lambda s, d: text.dump(events(s, d).df.select("event_id", "event_type", "user_id"), "event_id", 20)
)
_query("q53_string_escape", "select doc_id, md5(replace(replace(replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')) digest from documents")(
    lambda s, d: _table(s, d, "documents").select("doc_id", F.md5(text.escape(F.col("text"))).alias("digest"))
)
_query("q54_printable", "select count(*) n from documents where length(text) between 1 and 4096 and not regexp_matches(text, '[^\\x20-\\x7e]')")(lambda s, d: _table(s, d, "documents").filter(text.is_printable(F.col("text"))).agg(F.count("*").alias("n")))
_query("q55_record_json", "select event_id, '{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}' as json from events")(lambda s, d: Records(events(s, d).df.select("event_id", "event_type", "user_id"), "event_id").to_json())
# Readers whose accesses are sequential, random, mixed or too few to tell: of each user's events the n-th reads this record.
_ACCESSES = (
    "(select user_id, event_id, case user_id % 4 when 0 then n when 1 then n * 1000 + n % 7 when 2 then (n // 2) * 1000 + n % 2 else n * 50 end record "
    "from (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 n from events))"
)


def _accesses(s: SparkSession, d: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    numbered = events(s, d).df.select("user_id", "event_id", n.cast("long").alias("n"))
    n, kind = F.col("n"), F.col("user_id") % 4
    record = F.when(kind == 0, n).when(kind == 1, n * 1000 + n % 7).when(kind == 2, F.floor(n / 2) * 1000 + n % 2).otherwise(n * 50)
    return numbered.select("user_id", "event_id", record.alias("record"))


_PAGES = "select distinct event_id // 256 page from events where value > 200"
_query(
    "q56_page_coalesce",
    f"with p as ({_PAGES}), g as (select page, coalesce((page - lag(page) over (order by page) > 1)::int, 0) s from p), "
    "r as (select page, sum(s) over (order by page) run from g) select min(page) first_page, max(page) last_page, count(*) n_pages from r group by run",
)(lambda s, d: access.coalesced_pages(events(s, d).where(gt("value", 200)).df.select(F.expr("event_id div 256").alias("page")), "page", 1))
_query(
    "q56b_page_coalesce_gaps",
    "with p as (select distinct event_type, event_id // 16 page from events where value > 120), g as (select event_type, page, coalesce((page - lag(page) over (partition by event_type order by page) > 3)::int, 0) s from p), "
    "r as (select event_type, page, sum(s) over (partition by event_type order by page) run from g) "
    "select event_type, min(page) first_page, max(page) last_page, count(*) n_pages, min(page) * 4096 byte_start, (max(page) - min(page) + 1) * 4096 byte_length from r group by event_type, run",
)(lambda s, d: access.byte_ranges(access.coalesced_pages(events(s, d).where(gt("value", 120)).df.select("event_type", F.expr("event_id div 16").alias("page")), "page", 3, "event_type"), 4096))
_PATTERNS = (
    f"j as (select user_id, event_id, record, abs(record - lag(record) over (partition by user_id order by event_id)) jump from {_ACCESSES}), "
    "c as (select user_id, count(jump) n_jumps, coalesce(sum((jump <= 10)::int), 0)::bigint n_near, coalesce(sum((jump > 100)::int), 0)::bigint n_far, max_by(record, event_id) last_record from j group by 1), "
    "k as (select *, case when n_near + n_far < 8 then 'unknown' when n_near > 3 * n_far then 'sequential' when n_far > n_near then 'random' else 'mixed' end pattern from c)"
)
_query("q57_access_pattern", f"with {_PATTERNS} select * from k")(lambda s, d: access.patterns(_accesses(s, d), "user_id", "event_id", "record"))
_query("q57b_predict_next", f"with {_PATTERNS} select user_id, unnest(range(last_record + 1, least(last_record + 4, 99) + 1)) record from k where pattern = 'sequential' and last_record + 1 < 100")(
    lambda s, d: access.predicted(access.patterns(_accesses(s, d), "user_id", "event_id", "record"), "user_id", 4, 100)
)
_query(
    "q57c_load_strategy",
    "select event_id, case when event_type = 'click' and (event_id * 20000) // 1048576 <= 10 then 'eager' when (event_id * 20000) // 1048576 > 50 then 'lazy' else 'adaptive' end strategy from events",
)(lambda s, d: events(s, d).df.select("event_id", access.strategy(F.when(F.col("event_type") == "click", "full").otherwise("partial"), F.col("event_id") * 20000).alias("strategy")))
_query("q57d_upgrade", f"with {_PATTERNS} select user_id, case when pattern = 'sequential' and n_near >= 9 and user_id % 20 <= 10 then 'eager' else 'adaptive' end strategy from k")(
    lambda s, d: access.patterns(_accesses(s, d), "user_id", "event_id", "record").select("user_id", access.upgraded(F.lit("adaptive"), F.col("user_id") % 20 * (1 << 20) + 5, after=9).alias("strategy"))
)
_query("q58_group_count", "select event_type, count(*) n, round(avg(value), 4) mean from events group by 1")(lambda s, d: events(s, d).df.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean")))
_query("q59_join", "select n_name, count(*) n from customer join nation on c_nationkey = n_nationkey group by 1")(
    lambda s, d: _table(s, d, "customer").join(_table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))
)
_query("q59b_group_join", "select c_custkey, count(o_orderkey) n from customer left join orders on c_custkey = o_custkey group by 1")(
    lambda s, d: _table(s, d, "customer").select("c_custkey").join(_table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))
)
_query("q60_distinct", "select distinct l_returnflag, l_linestatus from lineitem")(lambda s, d: _table(s, d, "lineitem").select("l_returnflag", "l_linestatus").distinct())
_query("q61_union_except", "(select user_id from events where value > 100 union select user_id from events where event_type = 'error') except select user_id from events where value < 2")(
    lambda s, d: (e := events(s, d)).where(gt("value", 100)).df.select("user_id").union(e.where(eq("event_type", "error")).df.select("user_id")).distinct().exceptAll(e.where(lt("value", 2)).df.select("user_id").distinct())
)
_query("q61b_intersect", "select user_id from events where value > 100 intersect select user_id from events where event_type = 'error'")(
    lambda s, d: (e := events(s, d)).where(gt("value", 100)).df.select("user_id").intersect(e.where(eq("event_type", "error")).df.select("user_id"))
)
_query("q62_order_offset", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10 offset 5")(
    lambda s, d: orders(s, d).df.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(5).limit(10)
)
_query("q63_any_all", "select bool_or(value > 100) any_large, bool_and(value > 0) all_positive from events")(lambda s, d: events(s, d).df.agg(F.bool_or(F.col("value") > 100).alias("any_large"), F.bool_and(F.col("value") > 0).alias("all_positive")))
_query("q63b_fold", "select user_id, list_aggregate(list(value order by event_id), 'last') last_value from events group by 1")(
    lambda s, d: events(s, d).df.groupBy("user_id").agg(F.max_by("value", "event_id").alias("last_value"))
)
_query(
    "q64_spans",
    "with s as (select i, i % 20 op, (i % 20 + 1) * 1000000 base, (i::hugeint * 2246822519 % 4294967296)::bigint h, (i::hugeint * 2654435761 % 4294967296)::bigint j, ((i::hugeint * 1664525 + 1013904223) % 4294967296)::bigint p from (select row_number() over () - 1 i from events)) "
    "select 'svc_' || (i % 14) service, count(*) n, sum(base + j % (base * 0.8)::bigint - (base * 0.4)::bigint)::bigint total_ns, sum((h < 128849018)::int)::bigint errors, "
    "sum((h >= 128849018 and h < 171798692)::int)::bigint timeouts, sum((op in (14, 15) or (op = 1 and i % 7 = 0) or p < 644245094)::int)::bigint payloads from s group by 1",
)(
    lambda s, d: spans(s, events(s, d).count())
    .groupBy("service")
    .agg(
        F.count("*").alias("n"),
        F.sum("duration_ns").alias("total_ns"),
        F.sum((F.col("status_code") == 1).cast("long")).alias("errors"),
        F.sum((F.col("status_code") == 2).cast("long")).alias("timeouts"),
        F.count("payload").alias("payloads"),
    )
)

QUERIES |= source_queries.QUERIES
ORACLE |= source_queries.ORACLE
