"""What the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Only where that setting is missing and all runs on one machine, as in tests, is a temporary folder taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: later steps start from the files."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*written: DataFrame) -> None:
    """Deletes the files of tables that materialize() wrote, once all that reads them has been written itself."""
    for df in written:
        files = df.inputFiles()
        if files:
            folder = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Tables of a few numbers a row are broadcast up to this many rows (some 50 MB), else joined by shuffle.
BROADCAST_ROWS = 1_000_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows; it should have been written already."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Rows and bytes of text that a task works on at a time; one longer text is a slice of its own.
SLICE_ROWS, SLICE_BYTES = 1000, 1 << 20


def slices(batch: pa.RecordBatch, column: str = "text", rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of bounded numbers of rows and bytes of a string or binary column."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy()
    at, ends = 0, np.cumsum(lengths, dtype=np.int64)
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def in_batches(df: DataFrame, size: str = "4m") -> DataFrame:
    """df, whose rows go to Python workers in Arrow batches of so many bytes at most.

    By default Spark sends up to 10,000 rows or 64 MB at once, of which the executor and the worker each hold a copy.
    This sets spark.sql.execution.arrow.maxBytesPerBatch of the session.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return df


#: Rows of long texts that a Parquet reader holds at a time.
READ_ROWS = 64


def short_reads(df: DataFrame, rows: int = READ_ROWS) -> DataFrame:
    """df, whose Parquet files are read so many rows at a time at most.

    By default Spark reads 4,096 rows, which of long texts are tens of MB for each task, in arrays that are allocated
    anew with twice the size as they grow; the executor's heap grows with them and is not given back.
    This sets spark.sql.parquet.columnarReaderBatchSize of the session.
    """
    conf, name = df.sparkSession.conf, "spark.sql.parquet.columnarReaderBatchSize"
    conf.set(name, str(min(rows, int(conf.get(name)))))
    return df


def give_back() -> None:
    """Returns this worker's free memory to the system: an idle worker waits for its next task with little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow() in batches of bounded bytes; each task gives its memory back at its end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return in_batches(df).mapInArrow(task, schema)


def apart(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes to differ from df's columns."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        found.append(name)
    return found


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds
