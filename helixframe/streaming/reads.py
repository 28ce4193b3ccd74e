"""Reads and alignments as streams: the same transforms on files as they arrive, written once each."""

from __future__ import annotations

import io
import pickle
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from helixframe.sources.fastq import SCHEMA, lines_of, records

FILES = "path string, modificationTime timestamp, length long, content binary"
BATCH = 2000


def fastq_stream(spark: SparkSession, path: str, files: int = 64) -> DataFrame:
    """id, seq, qual of the FASTQ or FASTA files of a folder, new ones as they come, so many at a time.

    Spark's own file source keeps the list of files it has seen, so a file counts whenever it appears and whatever its name, and any file system that
    Spark reads will do. A task holds one file as it is stored."""
    found = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files).load(path).select("path", "content")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows = records(lines_of(io.BytesIO(content.as_py()), name))
                while part := list(islice(rows, BATCH)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*part)], ["id", "seq", "qual"])

    return found.mapInArrow(run, SCHEMA)


def write_once(rows: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Applies a transform to each batch of what is there, and writes it under the batch's number, so that a repeated batch replaces its own output."""

    def batch(part: DataFrame, number: int) -> None:
        transform(part).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def not_done(reads: DataFrame, done: DataFrame) -> DataFrame:
    """Resuming a batch run: the reads whose id isn't among those done."""
    return reads.join(done.select("id").distinct(), "id", "left_anti")


def flush_on_change(rows: DataFrame, fold: Callable[[pd.DataFrame], pd.DataFrame], schema: str, file: str = "file", key: str = "qname", order: str = "ord", idle_ms: int | None = None) -> DataFrame:
    """What fold makes of the rows of each key, as soon as the next key of the same file begins.

    Files are grouped by key, as alignments by their read; a row with a null key ends its file, and so does idle_ms without a new row, if it is given (it
    keeps a query running, so it isn't for runs that end when all is read). State holds the rows of one key for each file."""

    def run(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_key, held = (None, None)
        if state.exists:
            open_key, data = state.get
            held = pickle.loads(data)
        if state.hasTimedOut:
            state.remove()
            if held is not None:
                yield fold(held)
            return
        new = pd.concat(list(parts)).sort_values(order, kind="stable")
        runs = (new[key].ne(new[key].shift()) | new[key].isna()).cumsum()
        for _, part in new.groupby(runs, sort=False):
            now = part[key].iloc[0]
            now = None if pd.isna(now) else now
            if held is not None and now == open_key:
                held = pd.concat([held, part])
                continue
            if held is not None:
                yield fold(held)
            open_key, held = now, (part if now is not None else None)
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update((open_key, pickle.dumps(held)))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)

    return rows.groupBy(file).applyInPandasWithState(run, schema, "key string, rows binary", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
