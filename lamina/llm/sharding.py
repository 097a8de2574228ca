"""Sharding by Karmarkar-Karp differencing.

Law ``bytes``: rows with equal texts form a group that stays together, and the shards' sizes come out near equal. A
partial partition is 16 (or any number of) sums with the groups behind each. The two with the largest spread are
combined, the largest sum of one with the smallest of the other, until one is left. Groups are dealt to buckets by
their key and each bucket is differenced in a task of its own. The buckets' results, a few sums each, are partial
partitions again: as long as there are more than ``_FAN`` of them, every ``_FAN`` are differenced in one task of the next
level, and the last ones on the driver. So no task and not the driver holds more than ``_FAN`` results, at any size.

A group larger than a whole fair shard can't stay together in near-equal shards: by default only such groups (fewer than
the shards) are split by a hash of the document id, into pieces of an eighth of a shard; with ``whole=True`` they stay
together as well, and their shards are as much larger.

The size of a row is its text's UTF-8 bytes plus 1, so a null text (as an empty one) counts 1. Null ids are allowed;
repeated rows are rows each. Ties: equal sizes are taken in the order of the texts' hashes, and slots follow the id, then
the text's hash. Slots number a shard's rows without gaps. Other columns are ignored. No rows give none.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.common import written

_BUCKET_GROUPS = 2048
#: Buckets whose results one task (or the driver, at the end) takes together.
_FAN = 256
_SLOT_ROWS = 2048


def difference(partials: list[list[tuple[int, int]]], shards: int) -> list[int]:
    """The shard of every item. Each partial partition is a list of (sum, item); missing ones are empty."""
    items = 1 + max((i for p in partials for _, i in p), default=-1)
    following = [-1] * items

    heap = []
    for order, partial in enumerate(partials):
        bins = sorted(((s, i, i) for s, i in partial), reverse=True)
        bins += [(0, -1, -1)] * (shards - len(bins))
        heap.append((bins[-1][0] - bins[0][0], order, bins))
    heapq.heapify(heap)
    order = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        bins = []
        for (s, first, last), (t, head, tail) in zip(a, reversed(b), strict=True):
            if head < 0:
                bins.append((s + t, first, last))
            elif first < 0:
                bins.append((s + t, head, tail))
            else:
                following[last] = head
                bins.append((s + t, first, tail))
        bins.sort(reverse=True)
        heapq.heappush(heap, (bins[-1][0] - bins[0][0], order, bins))
        order += 1
    shard_of = [-1] * items
    for shard, (_, at, _) in enumerate(heap[0][2] if heap else ()):
        while at >= 0:
            shard_of[at] = shard
            at = following[at]
    return shard_of


def _levels(labelled: DataFrame, buckets: int, shards: int) -> DataFrame:
    """The shard of each ``bucket`` and ``label``, from a row per bucket and label (``bytes``)."""
    spark = labelled.sparkSession
    sums = labelled.groupBy("bucket", "label").agg(F.sum("bytes").alias("bytes"))
    steps = []  # each leads from the labels of one level to those of the next

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bucket", "ascending"), ("label", "ascending")])
        bucket, size = table.column("bucket").to_pylist(), table.column("bytes").to_pylist()
        return table.append_column("above", pa.array(_joined(bucket, size, shards), pa.int32()))

    while buckets > _FAN:
        buckets = -(-buckets // _FAN)
        above = sums.withColumn("over", F.col("bucket") % buckets).groupBy("over").applyInArrow(run, "bucket long, label int, bytes long, over long, above int")
        above = written(above, "level")
        steps.append(above)
        sums = above.groupBy(F.col("over").alias("bucket"), F.col("above").alias("label")).agg(F.sum("bytes").alias("bytes"))
    last = sums.orderBy("bucket", "label").collect()  # at most _FAN * shards rows
    found = _joined([r["bucket"] for r in last], [r["bytes"] for r in last], shards)
    at = spark.createDataFrame([(r["bucket"], r["label"], s) for r, s in zip(last, found, strict=True)], "bucket long, label int, shard int")
    for above in reversed(steps):
        upper = at.select(F.col("bucket").alias("over"), F.col("label").alias("above"), "shard")
        at = above.join(upper, ["over", "above"]).select("bucket", "label", "shard")
    return at


def _joined(bucket: list[int], size: list[int], shards: int) -> list[int]:
    """``difference`` over rows of sums, those of one bucket being a partial partition."""
    partials: dict[int, list[tuple[int, int]]] = {}
    for i, (b, s) in enumerate(zip(bucket, size, strict=True)):
        partials.setdefault(b, []).append((s, i))
    return difference(list(partials.values()), shards)


def shard(docs: DataFrame, shards: int = 16, *, whole: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id``, ``size``, ``text_crc32``, ``law`` ("bytes"), ``shard`` and ``slot`` (gapless from 0)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("key"))
    rows = written(rows, "rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    n_rows, total = rows.agg(F.count("*"), F.sum("size")).first()
    fair = max(1, (total or 0) // shards)
    large = groups.filter((F.col("bytes") > fair) & F.lit(not whole)).select("key", F.ceil(F.col("bytes") * 8 / fair).alias("pieces"))  # fewer rows than shards
    rows = rows.join(F.broadcast(large), "key", "left").withColumn("piece", F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), "pieces"))).drop("pieces")
    items = rows.groupBy("key", "piece").agg(F.sum("size").alias("bytes"))
    buckets = max(1, -(-(n_rows or 0) // _BUCKET_GROUPS))
    items = items.withColumn("bucket", F.pmod(F.xxhash64("key", "piece"), F.lit(buckets)))
    schema = "bucket long, key binary, piece long, bytes long, label int"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bytes", "descending"), ("key", "ascending"), ("piece", "ascending")])
        found = difference([[(b, i)] for i, b in enumerate(table.column("bytes").to_pylist())], shards)
        return table.append_column("label", pa.array(found, pa.int32()))

    labelled = items.select("bucket", "key", F.col("piece").cast("long").alias("piece"), "bytes").groupBy("bucket").applyInArrow(run, schema)
    labelled = written(labelled, "labelled")
    at = _levels(labelled, buckets, shards)
    placed = labelled.join(at, ["bucket", "label"]).select("key", "piece", "shard")
    rows = rows.join(placed, ["key", "piece"]).select("doc_id", "size", "text_crc32", "key", "shard")

    parts = max(1, (n_rows or 0) // (shards * _SLOT_ROWS))
    rows = written(rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts))), "dealt")
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    counts = counts.withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n")
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "key")
    return (
        rows.withColumn("row_no", F.row_number().over(inside))
        .join(counts, ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("row_no") - 1).alias("slot"))
    )
