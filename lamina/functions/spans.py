"""The ten-column table of trace spans that append benchmarks use, generated from record numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TWO_32 = 1 << 32


def _product(i, factor: int):
    """i * factor modulo 2^32, without overflow."""
    return F.pmod(i.cast("decimal(20,0)") * F.lit(factor).cast("decimal(10,0)"), F.lit(_TWO_32).cast("decimal(11,0)")).cast("long")


def spans(spark: SparkSession, n: int, operations: int = 20, services: int = 14, payloads: int = 7, base_ns: int = 1_000_000) -> DataFrame:
    """Spans 0 to n - 1. Names are numbered (``op_3``, ``svc_5``); the duration's base is ``base_ns`` times one more
    than the operation's number. ``payload`` is absent unless the rule gives one."""
    i = F.col("id")
    op = i % operations
    base = (op + 1) * base_ns
    jitter = F.pmod(_product(i, 2654435761), (base * 0.8).cast("long")) - (base * 0.4).cast("long")
    h = _product(i, 2246822519)
    drawn = F.pmod(F.pmod(i.cast("decimal(20,0)") * 1664525 + 1013904223, F.lit(_TWO_32).cast("decimal(11,0)")), F.lit(_TWO_32).cast("decimal(11,0)")).cast("long") < 0x26666666
    has_payload = op.isin(14, 15) | ((op == 1) & (i % 7 == 0)) | drawn
    return spark.range(n).select(
        (i * 1_000_003).alias("trace_id_hi"),
        (-(i * 999_983 + 1)).alias("trace_id_lo"),
        (i + 1).alias("span_id"),
        F.when(i % 8 == 0, 0).otherwise(i - 1).alias("parent_span_id"),
        F.concat(F.lit("op_"), op.cast("string")).alias("name"),
        F.concat(F.lit("svc_"), (i % services).cast("string")).alias("service"),
        (F.lit(1_715_018_000_000_000_000) + i * 1_000_000).alias("start_time_ns"),
        (base + jitter).alias("duration_ns"),
        F.when(h < 0x07AE147A, 1).when(h < 0x0A3D70A4, 2).otherwise(0).cast("long").alias("status_code"),
        F.when(has_payload, F.concat(F.lit("payload_"), (i % payloads).cast("string"))).alias("payload"),
    )
