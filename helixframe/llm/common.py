"""Helpers shared by the operators: the shared folder, materialising, streaming Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one in local mode; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and the executors of {master} share")
        base = "file://" + tempfile.mkdtemp(prefix="helixframe-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it back, so that a lost executor costs a re-read only."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes what materialise() wrote, of frames that nothing will read any more."""
    for df in frames:
        if df is not None:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sorted_join(left: DataFrame, right: DataFrame, a: str, b: str, how: str = "inner") -> DataFrame:
    """left and right where their whole numbers a and b are equal, by sorting both, which spills; never by a broadcast: Spark judges by the size of compressed
    files, whose rows take ten times as much in a broadcast's hash table on the driver. Complements are compared, so that a side that was grouped by its key
    is dealt out again, without which Spark doesn't split large keys."""
    return left.join(right.hint("merge"), F.bitwise_not(F.col(a)) == F.bitwise_not(F.col(b)), how)


def free(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of frames that are out of use; it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def light(spark: SparkSession) -> None:
    """Texts are long: unless the session asks for another number than the default, batches to Python hold 2000 rows.

    Spark's limit on a batch's bytes (64 MB by default) holds besides, so a batch is that large at most, or one row."""
    if spark.conf.get(BATCH_ROWS, "10000") == "10000":
        spark.conf.set(BATCH_ROWS, "2000")


def tidy(run: Callable) -> Callable:
    """run over batches; at the end of a partition, the memory that is free goes back to the system, as Spark keeps the worker for later tasks."""

    def out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def utf8(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each string, null as empty, without decoding."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        kind = pa.large_binary() if pa.types.is_large_string(chunk.type) else pa.binary()
        for x in chunk.view(kind) if len(chunk) else ():
            yield x.as_py() or b""


def slices(batches: Iterable[pa.RecordBatch], column: int, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that one slice holds about most_bytes of the given column at most; a single longer value stays whole."""
    for b in batches:
        rows = max(1, b.num_rows)
        step = max(1, int(rows * most_bytes / max(1, b.column(column).nbytes)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def appended(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in fields)])


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the id, the text and the named columns, with the id as long."""
    light(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)
