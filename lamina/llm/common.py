"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII white space, as ``bytes.split()`` also takes it.
LOWER = bytes(range(256)).lower()
#: Rows of a file of a table whose rows are few numbers each.
_ROWS_A_FILE = 1 << 15


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where that is unset (a session
    in one process, as in tests), a temporary folder of this machine is made and set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lamina-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def written(df: DataFrame, name: str, rows: int | None = None, **options: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: later steps survive the loss of any executor
    and don't compute it again. ``rows``: a bound on the number of rows, where they are few numbers each; so many
    partitions of few rows don't make a file each (for each file that it makes on a local file system, Hadoop starts a
    process from the executor)."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // _ROWS_A_FILE)))
    path = f"{shared_folder(spark)}/lamina/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files that a table made by ``written`` reads, when nothing reads them any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


_BATCH_CONF, _SPARKS_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB at most for the session, unless it asks for another size than Spark's own 64 MB: a batch of
    long texts is held several times, in the executor and in its Python workers."""
    now = spark.conf.get(_BATCH_CONF, None)
    if now is not None and now.rstrip("b") == str(_SPARKS_BATCH):
        spark.conf.set(_BATCH_CONF, str(_BATCH_BYTES))


def ids_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that count, the text without nulls."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))


def input_partitions(df: DataFrame) -> int:
    """Tasks that a scan takes; no job is run."""
    return max(1, df.select(df.columns[0]).rdd.getNumPartitions())


def released(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; it does so when the driver's
    garbage is collected. The session keeps the last plan that has run until the next one, so an empty one runs first."""
    spark.range(1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trimmed() -> None:
    """Returns memory that this process has freed to the system. Idle Python workers stay beside their executor for the
    stages that follow."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(values: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes of text, or ids of lists, each; one row at least."""
    import pyarrow.compute as pc

    start = held = 0
    for i, n in enumerate((pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length)(values).to_pylist()):
        if held and held + (n or 0) > most:
            yield start, i
            start = i
            held = 0
        held += n or 0
    if start < len(values):
        yield start, len(values)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that the table doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    name = f"_{stem}"
    while name in taken:
        name += "_"
    return name
