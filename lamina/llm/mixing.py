"""Mixing sources to target weights, with DataFrame operations only.

The words of a source's documents form one stream, cut into blocks of ``block_words``. Every output shard has
``shard_slots`` slots, each dealt to a source by a hash of its number: a multinomial draw of source counts per shard.
The slots of a source are numbered through the shards; number k takes, in pass k div n of the source's n blocks, the
block that a pseudorandom permutation of 0 to n-1 gives for k mod n (a swap-or-not shuffle, keyed by source and pass).
Blocks and slots join by source and block index.

A source never takes more slots than its target has: draws beyond that are given up, and settling shards after the
drawn ones hold what others still lack. So each source's words come within a block of its target, no block (and no
document) is taken more often than the target's passes, and reruns agree whatever the partitioning.

Sizes count runs of anything but ASCII white space; a null or empty text has none and is never taken. A null source is
a source of its own, last in order. Repeated rows are documents each. Without words all targets are 0. Columns other
than the three named are ignored. No documents give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import WORD, written

_ROUNDS = 12
#: Documents of a source that one window orders.
_CHUNK_ROWS = 2048
#: Cells over the slots' range in which a slot looks for its source.
_CELLS = 4096


@dataclass
class Mix:
    """``documents``: one row per input row (``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``
    and ``row_key``, which tells repeated rows apart); ``slots``: the mix itself (``shard``, ``source_no``, ``pass_no``,
    ``block``); ``sources``: a row per source."""

    documents: DataFrame
    slots: DataFrame
    sources: DataFrame


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """A row per source: number by code point (null last), rows, words and target. Sources that would pass ``most``
    times their size stop there; the others share the rest by weight. Sorted by the ratio at which they stop, one
    running sum finds the common level. The windows span one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    sources = (
        sized.groupBy("source")
        .agg(F.count("*").alias("source_rows"), F.sum("size").alias("source_size"))
        .withColumn("source_no", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("stop", F.lit(float(most)) * F.col("source_size"))
    )
    by_stop = Window.orderBy(F.col("stop") / F.col("weight"), "source_no")
    before = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(by_stop.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return (
        sources.withColumn("level", left / weight_left)
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("stop"), F.struct(F.col("stop") / F.col("weight"), "source_no", "level"))).over(everything)["level"])
        .withColumn("target", F.least("stop", F.coalesce(F.col("level") * F.col("weight"), F.col("stop"))))
        .drop("level", "stop")
    )


def permuted(df: DataFrame, place: str, n: str, key: list[Column], into: str, seed: int) -> DataFrame:
    """Adds ``into``: the image of ``place`` under a pseudorandom permutation of 0 to ``n`` - 1 keyed by ``key``. Each
    round pairs every place with its mirror about a keyed point, and a keyed bit decides whether both swap."""
    df = df.withColumn(into, F.col(place))
    for r in range(_ROUNDS):
        point = F.pmod(F.xxhash64(F.lit(seed), F.lit(r), *key), F.col(n))
        df = df.withColumn("_mirror", F.pmod(point - F.col(into), F.col(n)))
        swap = F.xxhash64(F.lit(seed), F.lit(r + _ROUNDS), *key, F.greatest("_mirror", into)).bitwiseAND(F.lit(1)) == 1
        df = df.withColumn(into, F.when(swap, F.col("_mirror")).otherwise(F.col(into)))
    return df.drop("_mirror")


def _dealt(spark, sources: DataFrame, total: int, shard_slots: int, seed: int) -> DataFrame:
    """Runs of slots (``shard``, ``source_no``, ``first``, ``stop``) that cover 0 to ``slots`` - 1 of each source."""
    some = sources.filter("slots > 0").withColumn("reach", F.sum("slots").over(Window.orderBy("source_no"))).select("source_no", "slots", (F.col("reach") - F.col("slots")).alias("low"), "reach")
    width = max(1, -(-total // _CELLS))
    cells = some.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("reach") - 1) / width))))
    draws = spark.range(total).select(F.floor(F.col("id") / shard_slots).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(total)).alias("draw"))
    counts = draws.withColumn("cell", F.floor(F.col("draw") / width)).join(cells, "cell").filter("draw >= low and draw < reach").groupBy("shard", "source_no").agg(F.count("*").alias("drawn"), F.first("slots").alias("slots"))
    through = F.sum("drawn").over(Window.partitionBy("source_no").orderBy("shard"))
    runs = counts.withColumn("stop", through).withColumn("first", F.least(F.col("stop") - F.col("drawn"), "slots")).withColumn("stop", F.least("stop", "slots"))
    drawn = runs.filter("stop > first").select("shard", "source_no", "first", "stop")
    lacking = some.join(counts.groupBy("source_no").agg(F.sum("drawn").alias("had")), "source_no", "left").withColumn("had", F.least(F.coalesce("had", F.lit(0)), "slots"))
    lacking = lacking.withColumn("lack", F.col("slots") - F.col("had")).filter("lack > 0").withColumn("at", F.sum("lack").over(Window.orderBy("source_no")) - F.col("lack"))
    after = -(-total // shard_slots)
    settling = (
        lacking.withColumn("piece", F.explode(F.sequence(F.floor(F.col("at") / shard_slots), F.floor((F.col("at") + F.col("lack") - 1) / shard_slots))))
        .withColumn("first", F.greatest(F.lit(0), F.col("piece") * shard_slots - F.col("at")))
        .withColumn("stop", F.least("lack", (F.col("piece") + 1) * shard_slots - F.col("at")))
        .select((F.col("piece") + after).alias("shard"), "source_no", (F.col("had") + F.col("first")).alias("first"), (F.col("had") + F.col("stop")).alias("stop"))
    )
    return drawn.unionByName(settling)


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block_words: int = 64, shard_slots: int = 4096, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> Mix:
    spark = docs.sparkSession
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")), "sized")
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    sources = source_targets(sized, weights, share, most).withColumn("blocks", blocks)
    sources = sources.withColumn("slots", F.when(F.col("blocks") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long")).otherwise(F.lit(0)))
    sources = written(sources, "sources")
    total = sources.agg(F.sum("slots")).first()[0] or 0

    runs = _dealt(spark, sources, total, shard_slots, seed) if total else spark.createDataFrame([], "shard long, source_no int, first long, stop long")
    slots = (
        runs.join(sources.select("source_no", "blocks"), "source_no")
        .withColumn("k", F.explode(F.sequence("first", F.col("stop") - 1)))
        .withColumn("pass_no", F.floor(F.col("k") / F.col("blocks")))
        .withColumn("place", F.col("k") % F.col("blocks"))
    )
    slots = permuted(slots, "place", "blocks", [F.col("source_no"), F.col("pass_no")], "block", seed)
    slots = written(slots.select("shard", "source_no", "pass_no", "block"), "slots")  # also ends a plan that grows with the rounds

    # where each document starts in its source's stream: sums of chunks, then sums within a chunk
    known = sources.select(F.col("source").alias("_source"), "source_no", "source_rows", "source_size", "target")
    placed = sized.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("source_rows") / _CHUNK_ROWS))).drop("source_rows")
    bases = placed.groupBy("source_no", "chunk").agg(F.sum("size").alias("words"))
    bases = bases.withColumn("base", F.sum("words").over(Window.partitionBy("source_no").orderBy("chunk")) - F.col("words")).drop("words")
    inside = Window.partitionBy("source_no", "chunk").orderBy("doc_id", "size")
    placed = placed.withColumn("row_no", F.row_number().over(inside)).withColumn("start", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    placed = written(placed.join(bases.hint("merge"), ["source_no", "chunk"]).withColumn("start", F.col("start") + F.col("base")).drop("base"), "placed")

    times = slots.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    spans = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words) - F.greatest("start", F.col("block") * block_words)
    row_key = ["source_no", "chunk", "row_no"]
    # neither side is small where the other is, so none is to be broadcast
    taken = spans.select(*row_key, "block", overlap.alias("overlap")).join(times.hint("merge"), ["source_no", "block"]).groupBy(*row_key).agg(F.sum(F.col("overlap") * F.col("times")).alias("taken"))
    documents = placed.join(taken.hint("merge"), row_key, "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.struct(*row_key).alias("row_key")
    )
    return Mix(documents, slots, sources)


def copies(documents: DataFrame) -> DataFrame:
    """A mix's documents with ``copies``: how often each comes if only whole documents can. ``taken`` over ``size``
    times, a fraction being rounded so that the copies of the documents up to any one, in the order of the source's
    chunks and of sizes within a chunk, come to the sum of their shares, less than one apart."""
    row = documents.select("*", "row_key.*").withColumn("often", F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0.0)))
    # in whole millionths, so that sums don't depend on their order
    row = row.withColumn("part", F.round((F.col("often") - F.floor("often")) * 1_000_000).cast("long"))
    bases = row.groupBy("source_no", "chunk").agg(F.sum("part").alias("parts"))
    bases = bases.withColumn("base", F.sum("parts").over(Window.partitionBy("source_no").orderBy("chunk")) - F.col("parts")).drop("parts")
    inside = Window.partitionBy("source_no", "chunk").orderBy("size", "row_no")
    row = row.withColumn("upto", F.sum("part").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))).join(bases.hint("merge"), ["source_no", "chunk"])
    upto = F.col("upto") + F.col("base") + 500_000
    more = F.floor(upto / 1_000_000) - F.floor((upto - F.col("part")) / 1_000_000)
    return row.withColumn("copies", (F.floor("often") + more).cast("long")).select(*documents.columns, "copies")
