"""Connected components by alternating star contraction, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import drop_written, written


def _least(edges: DataFrame) -> DataFrame:
    """Per ``u``, the least of its neighbours and itself. Sums up before it shuffles, so a hub is no large group."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node of the edges ``a``, ``b`` (long, not
    null). Loops only name a node. Each round is written to the shared folder; the number of rounds grows with the
    logarithm of the components' diameter."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        now = tuple(links.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
        # large stars: neighbours above a node go to the least node around it
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "large", rows=2 * now[0])
        # small stars: a node and its lesser neighbours go to the least of these
        least = _least(large)
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.filter("u <> m").select("u", F.col("m").alias("v")))
        after = written(small.distinct(), "small", rows=2 * now[0])
        drop_written(links)
        drop_written(large)
        links = after
    return nodes.join(links.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
