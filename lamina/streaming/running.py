"""Sums over records as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lamina.operators import reducers


def arriving(spark: SparkSession, path: str) -> DataFrame:
    """The records of a growing file, or of all files of a folder that come and grow, each once, when whole."""
    from lamina.sources.record_source import register

    register(spark)
    return spark.readStream.format("records").load(path)


def running_sum(records: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """The sum of a field over all that has arrived, and the number of records; for ``complete`` or ``update`` mode."""
    grouped = records.groupBy(*by) if by else records.groupBy()
    return grouped.agg(reducers.sum_f64(records, key).alias("total"), F.count("*").alias("n"))


def append(records: DataFrame, path: str, checkpoint: str, layout: str = "row") -> StreamingQuery:
    """Appends each micro-batch as files of the record format; ends when what is available now is written. A batch that is
    repeated after a failure replaces what it has written before. One stream a folder, as batches are told by number."""

    def write(batch: DataFrame, number: int) -> None:
        batch.drop("_rec").write.format("records").mode("append").option("layout", layout).option("batch", number).save(path)

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
