"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams (one word and two), one of the wanted text and one of all text, give each document a log weight: the
mean log ratio of its n-grams, as for a text of NORMAL of them, so that the length of a text doesn't decide. A Gumbel variate of the document's id is added, and the k largest sums are a sample without replacement in proportion to
the weights. Wanted are the labelled documents of quality 1 that aren't toxic; k is their share of the labelled ones, times the number of documents. temperature scales the noise: 1 is plain
sampling, less comes closer to taking the largest weights.

The raw model counts all documents. The target model counts the wanted documents of at most target_rows labelled rows (those of smallest hash). Null texts count as empty and have weight 0; null ids share one variate. Repeated rows have equal sums and are kept or rejected together:
all rows whose sum is at least the k-th largest are kept. Without labels, or without a wanted one, there is no target model and all is kept. Extra columns pass through filter(). An empty table gives no rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import fresh, light, materialise, slices, texts, tidy, utf8

BUCKETS = 1 << 16
TARGET_ROWS = 200_000
SMOOTH = 0.5
NORMAL = 100
SLICE_BYTES = 2 << 20
TEMPERATURE = 0.25


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64, on unsigned 64-bit integers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def features(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the documents, one document after the other, and the number of each document's."""
    words = [d.lower().split() for d in docs]
    n = np.array([len(w) for w in words], np.int64)
    total = int(n.sum())
    one = np.fromiter((zlib.crc32(w) for ws in words for w in ws), np.uint64, total)
    if not total:
        return np.empty(0, np.int64), np.zeros(len(docs), np.int64)
    two = mixed(one[:-1] * np.uint64(0x100000001B3) ^ one[1:])
    ends = np.cumsum(n)
    doc = np.repeat(np.arange(len(docs)), n)
    inner = np.ones(total - 1, bool)
    borders = ends[:-1]
    inner[borders[(borders > 0) & (borders < total)] - 1] = False
    both = np.concatenate([mixed(one), two[inner]]) & np.uint64(BUCKETS - 1)
    owner = np.concatenate([doc, doc[:-1][inner]])
    order = np.argsort(owner, kind="stable")
    return both[order].astype(np.int64), np.bincount(owner, minlength=len(docs))


def count_batches(batches: Iterable[pa.RecordBatch], wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for b in slices(batches, 1, SLICE_BYTES):
        ids = b.column(0).to_numpy(zero_copy_only=False)
        chosen = np.isin(np.nan_to_num(ids.astype(float), nan=-1.0).astype(np.int64) if b.column(0).null_count else ids, wanted)
        if b.column(0).null_count:
            chosen &= ~np.asarray(b.column(0).is_null())
        found, n = features(list(utf8(b.column(1))))
        raw += np.bincount(found, minlength=BUCKETS)
        target += np.bincount(found[np.repeat(chosen, n)], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])


def fit(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS) -> tuple[np.ndarray, float]:
    """The log ratio of each bucket, and the share of wanted documents."""
    known = labels.where("doc_id is not null and quality is not null")
    is_wanted = F.expr("quality = 1 and coalesce(toxic, 0) = 0")
    share = known.agg(F.avg(is_wanted.cast("double"))).first()[0]
    some = known.where(is_wanted).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id").alias("h"))
    wanted = np.sort(np.array([r[0] for r in some.orderBy("h", "doc_id").limit(target_rows).collect()], np.int64))
    counts = texts(docs).mapInArrow(tidy(lambda bs: count_batches(bs, wanted)), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.full(BUCKETS, SMOOTH), np.full(BUCKETS, SMOOTH)
    for r in counts.collect():  # BUCKETS rows at most
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    if share is None or not len(wanted):
        return np.zeros(BUCKETS), 1.0
    return np.log(target / target.sum()) - np.log(raw / raw.sum()), share


def gumbel(ids: pa.Array) -> np.ndarray:
    key = np.asarray(ids.fill_null(-1)).astype(np.int64).view(np.uint64)
    u = ((mixed(key) >> np.uint64(11)).astype(float) + 0.5) / 2.0**53
    return -np.log(-np.log(u))


def score_batches(batches: Iterable[pa.RecordBatch], ratio: np.ndarray, temperature: float, at: tuple[int, int]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each slice with its log weights and sums; at: the places of id and text."""
    for b in slices(batches, at[1], SLICE_BYTES):
        found, n = features(list(utf8(b.column(at[1]))))
        weights = np.zeros(b.num_rows)
        some = np.flatnonzero(n)
        if len(some):
            weights[some] = NORMAL * np.add.reduceat(ratio[found], (np.cumsum(n) - n)[some]) / n[some]
        weights = np.round(weights, 6)
        yield b, weights, np.round(weights + temperature * gumbel(b.column(at[0])), 6)


def kth_largest(keys: DataFrame, column: str, k: int) -> float:
    """Exact, by counting rows per digit of an order-preserving integer: four passes, each giving 65536 counts at most."""
    whole = F.round(F.col(column) * 1e6).cast("long") + F.lit(1 << 62)
    digits, rows, left = [], keys.select(whole.alias("v")), k
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("v", shift).bitwiseAND(0xFFFF)
        for d, n in sorted(rows.groupBy(digit.alias("d")).count().collect(), reverse=True):
            if left <= n:
                break
            left -= n
        digits.append(d)
        rows = rows.where(digit == d)
    return (sum(d << s for d, s in zip(digits, (48, 32, 16, 0))) - (1 << 62)) / 1e6


def cutoff(keys: DataFrame, share: float) -> float | None:
    """The least sum that is kept; None if there are no rows."""
    n = keys.count()
    k = max(1, round(share * n))
    return kth_largest(keys, "key", k) if n else None


def scored(docs: DataFrame, ratio: np.ndarray, temperature: float) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, weights, keys in score_batches(batches, ratio, temperature, (0, 1)):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weights), pa.array(keys)], ["doc_id", "log_weight", "key"])

    return texts(docs).mapInArrow(tidy(run), "doc_id long, log_weight double, key double")


def classify(docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE, target_rows: int = TARGET_ROWS) -> DataFrame:
    """doc_id, log_weight, key (log weight plus noise) and kept of each document."""
    ratio, share = fit(docs, labels, target_rows)
    rows = materialise(scored(docs, ratio, temperature), "importance")
    least = cutoff(rows, share)
    return rows.withColumn("kept", F.lit(True) if least is None else F.col("key") >= least)


def filter_documents(docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE, target_rows: int = TARGET_ROWS) -> DataFrame:
    """The documents of the sample, with all their columns."""
    ratio, share = fit(docs, labels, target_rows)
    least = cutoff(materialise(scored(docs, ratio, temperature).select("key"), "importance"), share)
    if least is None:
        return docs
    light(docs.sparkSession)
    i, t = fresh(docs, "id_to_score"), fresh(docs, "text_to_score")
    rows = docs.withColumns({i: F.col("doc_id").cast("long"), t: F.col("text").cast("string")})
    at = (len(docs.columns), len(docs.columns) + 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, keys in score_batches(batches, ratio, temperature, at):
            yield b.select(list(range(at[0]))).filter(pa.array(keys >= least - 5e-7))

    return rows.mapInArrow(tidy(run), docs.schema)


