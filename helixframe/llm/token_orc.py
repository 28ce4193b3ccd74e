"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

A range partitioning by document id makes each file a shard of its own id range, in ascending order, so a reader prunes files and stripes by their
statistics and single documents by Bloom filter; stripes are read in parallel. Each row keeps its place within the shard; the place within the whole
is that plus the tokens of all shards before, which a scan of two small columns gives.

Null ids come first; null texts count as empty. Rows of equal id stand in the order of a hash of their text; repeated rows are all written. Other
columns are left out. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.llm import bpe
from helixframe.llm.common import materialise, texts, tidy
from helixframe.llm.tokens import encode_batches

SCHEMA = "shard int, doc_id long, start_in_shard long, n_tokens int, ids array<int>"


def shard_batches(batches: Iterable[pa.RecordBatch], encoder: bpe.Bpe, end: int) -> Iterator[pa.RecordBatch]:
    shard, start = TaskContext.get().partitionId(), 0
    for b in encode_batches(batches, encoder=encoder, end=end):
        ids = b.column(b.schema.get_field_index("ids"))
        n = np.diff(ids.offsets.to_numpy()).astype(np.int64)
        starts = start + np.cumsum(n) - n
        start += int(n.sum())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n), shard, np.int32)), b.column(0), pa.array(starts), pa.array(n.astype(np.int32)), ids],
            ["shard", "doc_id", "start_in_shard", "n_tokens", "ids"],
        )


def write_token_orc(df: DataFrame, path: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, ranks: str | None = None, stride: int = 1000, stripe_bytes: int = 64 << 20, compress: str = "zstd") -> None:
    """Writes the ids of each text, with the id end after them, in ascending order of documents."""
    rows = texts(df, id_col, text_col)
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange(rows.doc_id.asc_nulls_first(), tie).sortWithinPartitions(rows.doc_id.asc_nulls_first(), tie)
    (
        rows.mapInArrow(tidy(lambda bs: shard_batches(bs, bpe.load_library(tokenizer, ranks), end)), SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("compression", compress)
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids. doc_ids: only these, found by file statistics, row index and Bloom filter."""
    stored = spark.read.schema(SCHEMA).orc(path)
    sums = stored.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.select(F.col("shard").alias("s"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("first"))
    # Small and of known size once written, so Spark sends it to the shards rather than exchange the ids; with very many shards it does exchange.
    firsts = materialise(firsts, "token-orc-firsts")
    rows = stored if doc_ids is None else stored.where(F.col("doc_id").isin(doc_ids))
    return rows.join(firsts, rows.shard == firsts.s).select("doc_id", (F.col("first") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids")
