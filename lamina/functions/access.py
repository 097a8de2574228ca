"""Access logs: which pages to fetch together, and what pattern a reader follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Pages that one window orders.
_CHUNK = 4096


def running(df: DataFrame, order: str, value: Column, how: str, into: str, by: list[str] | None = None, chunk: int = _CHUNK) -> DataFrame:
    """Adds ``into``: the ``sum`` or ``max`` of ``value`` over all rows up to this one by the whole number ``order``. Rows
    are windowed in chunks of ``chunk`` consecutive numbers, and only the chunks' totals together, so no task orders
    everything."""
    keys, total = by or [], {"sum": F.sum, "max": F.max}[how]
    cut = df.withColumn("_chunk", F.expr(f"`{order}` div {chunk}")).withColumn("_value", value)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = cut.groupBy(*keys, "_chunk").agg(total("_value").alias("_total")).withColumn("_base", total("_total").over(before)).drop("_total")
    joined = cut.withColumn("_inside", total("_value").over(Window.partitionBy(*keys, "_chunk").orderBy(order))).join(bases, [*keys, "_chunk"])
    base, inside = F.col("_base"), F.col("_inside")
    return joined.withColumn(into, F.greatest(base, inside) if how == "max" else F.coalesce(base + inside, base, inside)).drop("_chunk", "_value", "_inside", "_base")


def coalesced_pages(pages: DataFrame, page: str, gap: int = 1, by: str | None = None) -> DataFrame:
    """Runs of pages whose numbers differ by at most ``gap`` from one to the next: ``first_page``, ``last_page``,
    ``n_pages``, for each ``by`` (a reader or file) if given. A page starts a run if none of the ``gap`` before it is
    wanted."""
    keys = [by] if by else []
    wanted = pages.select(*keys, F.col(page).cast("long").alias("_page")).distinct()
    if gap > 0:
        followed = wanted.select(*keys, F.explode(F.sequence(F.col("_page") + 1, F.col("_page") + gap)).alias("_page")).distinct().withColumn("_goes_on", F.lit(True))
        marked = wanted.join(followed, [*keys, "_page"], "left")
    else:
        marked = wanted.withColumn("_goes_on", F.lit(None).cast("boolean"))
    runs = running(marked, "_page", F.when(F.col("_goes_on").isNull(), F.col("_page")), "max", "_run", keys)
    return runs.groupBy(*keys, "_run").agg(F.min("_page").alias("first_page"), F.max("_page").alias("last_page"), F.count("*").alias("n_pages")).drop("_run")


def byte_ranges(runs: DataFrame, page_size: int) -> DataFrame:
    """Adds ``byte_start`` and ``byte_length`` of runs of pages of ``page_size`` bytes."""
    first, last = F.col("first_page"), F.col("last_page")
    return runs.withColumn("byte_start", first * page_size).withColumn("byte_length", (last - first + 1) * page_size)


def patterns(log: DataFrame, reader: str, order: str, record: str, *, near: int = 10, far: int = 100, least: int = 8, ratio: int = 3) -> DataFrame:
    """Per reader: jumps of at most ``near`` records and beyond ``far``, the last record, and the pattern: ``unknown``
    with fewer than ``least`` of both together, ``sequential`` if there are more than ``ratio`` near ones to a far one,
    ``random`` if there are more far ones, else ``mixed``."""
    jump = F.abs(F.col(record) - F.lag(record).over(Window.partitionBy(reader).orderBy(order)))
    counts = (
        log.select(reader, F.col(order).alias("_order"), F.col(record).alias("_record"), jump.alias("_jump"))
        .groupBy(reader)
        .agg(F.count("_jump").alias("n_jumps"), F.sum((F.col("_jump") <= near).cast("long")).alias("n_near"), F.sum((F.col("_jump") > far).cast("long")).alias("n_far"), F.max_by("_record", "_order").alias("last_record"))
        .fillna(0, ["n_near", "n_far"])
    )
    pattern = (
        F.when(F.col("n_near") + F.col("n_far") < least, "unknown")
        .when(F.col("n_near") > ratio * F.col("n_far"), "sequential")
        .when(F.col("n_far") > F.col("n_near"), "random")
        .otherwise("mixed")
    )
    return counts.withColumn("pattern", pattern)


def predicted(found: DataFrame, reader: str, depth: int, records: int) -> DataFrame:
    """The records that a sequential reader wants next: up to ``depth`` after its last one, below ``records``."""
    following = F.sequence(F.col("last_record") + 1, F.least(F.col("last_record") + depth, F.lit(records - 1)))
    ahead = found.filter((F.col("pattern") == "sequential") & (F.col("last_record") + 1 < records))
    return ahead.select(reader, F.explode(following).alias("record"))


def strategy(hint: Column, size: Column, *, eager_most: int = 10, lazy_most: int = 50) -> Column:
    """How to load a file of ``size`` bytes, counted in whole megabytes: ``eager`` if the hint is ``full`` and it has at
    most ``eager_most``, ``lazy`` if it has more than ``lazy_most``, else ``adaptive``."""
    whole = F.floor(size / (1 << 20))
    return F.when((hint == "full") & (whole <= eager_most), "eager").when(whole > lazy_most, "lazy").otherwise("adaptive")


def upgraded(chosen: Column, size: Column, *, after: int = 100, eager_most: int = 10) -> Column:
    """The strategy after some accesses, over the rows of ``patterns``: an ``adaptive`` one becomes ``eager`` once a
    sequential reader has made ``after`` near jumps, in a file of at most ``eager_most`` whole megabytes."""
    enough = (F.col("pattern") == "sequential") & (F.col("n_near") >= after) & (F.floor(size / (1 << 20)) <= eager_most)
    return F.when((chosen == "adaptive") & enough, "eager").otherwise(chosen)
