"""Language-model scores by context-tree weighting over bytes.

A text is its lower-cased words, a blank behind each, and an end byte. Every byte is eight binary decisions; each is predicted in the contexts of the
last 0 to DEPTH bytes (end bytes before the text) by Krichevsky-Trofimov estimates, and the estimates of all depths are mixed by the weights that
context-tree weighting gives them over the training texts: a node's probability is half its own estimate and half the product of its children's.
The tree is fixed after training, so a byte's probability depends on the DEPTH bytes before it and the byte alone. What is gathered from the corpus
is therefore one count for each run of DEPTH + 1 bytes, and it grows with the corpus.

Texts are written as blocks of what one task reads. A block asks for its different runs and words, with their training counts; these are dealt to
buckets by a hash (runs: of their last three bytes of context), summed there over all blocks, valued, and sent back to the blocks that asked. A row holds
many runs or words in sorted arrays, so Spark moves few large rows. The number of buckets grows with what all blocks ask for, so a bucket stays small, and
a key stands in it once a block at most. Nothing is broadcast or gathered in one place but the counts of the three shallowest contexts, whose number is
bounded by the alphabet. The tree below each context of three bytes is built in one step; it has 256 ** (DEPTH - 2) runs at most, whatever the corpus.

A plain model of whole words gives the base score beside it. Null texts count as empty (the end alone); null ids hash as the empty string. Repeated
rows count as often as they stand there. Extra columns are left out. An empty table gives no rows; without training texts every bit has probability
one half."""

from __future__ import annotations

import math
import pickle
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import free, materialise, texts, tidy, utf8

DEPTH = 5
CUT = 3  # contexts of fewer bytes than this are valued by SQL
BLOCK_BYTES = 32 << 20
PIECE_BYTES = 1 << 20
SLICE_RUNS = 1 << 16
CHUNK = 1 << 16  # of bytes worked on in a processor's cache; their places fill the 16 bits that a run leaves of 64
GROUP_BYTES = 16 << 20
ROW_KEYS = 1 << 16
ROW_BYTES = 8 << 20
BUCKET_KEYS = 1 << 20
LEAST_BUCKETS = 64
END = b"\n"
BLOCKS = "block long, piece long, data binary"
ASKED = "block long, n long, keys binary, counts binary"
DEALT = "bucket long, number long, keys binary, counts binary"
SUMS = "bucket long, number long, keys binary, counts binary, total long, different long"
ANSWERS = "block long, number long, keys binary, counts binary"
TABLE = np.array([[math.lgamma(k + 0.5), math.lgamma(k + 1.0)] for k in range(1024)])


def log_gamma(n: np.ndarray, half: bool) -> np.ndarray:
    """Of n + 1/2 if half, else of n + 1; n: whole numbers."""
    x = n + (0.5 if half else 1.0)
    large = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < len(TABLE), TABLE[np.minimum(n, len(TABLE) - 1), 0 if half else 1], large)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return log_gamma(n0, True) + log_gamma(n1, True) - 2 * TABLE[0, 0] - log_gamma(n0 + n1, False)


def normalised(text: bytes) -> bytes:
    words = text.lower().split()
    return b" ".join([*words, END]) if words else END


def block_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of about BLOCK_BYTES, each in pieces of whole texts: ids, held out or not, ends and the bytes, pickled."""
    block, piece, size = TaskContext.get().partitionId() << 32, 0, 0
    ids, held, parts, held_bytes = [], [], [], 0

    def flush() -> pa.RecordBatch:
        data = pickle.dumps((ids, np.array(held, bool), np.cumsum([len(p) for p in parts]), b"".join(parts)))
        return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([piece]), pa.array([data])], ["block", "piece", "data"])

    for b in batches:
        for i, h, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), utf8(b.column(1))):
            ids.append(i)
            held.append(h)
            parts.append(normalised(t))
            held_bytes += len(parts[-1])
            if held_bytes >= PIECE_BYTES:
                yield flush()
                size += held_bytes
                piece, ids, held, parts, held_bytes = piece + 1, [], [], [], 0
                if size >= BLOCK_BYTES:
                    block, piece, size = block + 1, 0, 0
    if ids:
        yield flush()


def to_blocks(docs: DataFrame) -> DataFrame:
    held = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1).alias("held")
    return texts(docs).select("doc_id", "text", held).mapInArrow(tidy(block_batches), BLOCKS)


def windows(padded: np.ndarray, depth: int) -> np.ndarray:
    """The runs of depth + 1 bytes that begin at each byte but the last ones."""
    n = len(padded) - depth
    code, width, done, power = np.zeros(n, np.int64), 1, 0, padded
    while True:  # power: the runs of width bytes that begin at each byte; those of 1, 2, 4 bytes make up the whole
        if (depth + 1) & width:
            done += width
            begin = depth + 1 - done
            code |= power[begin : begin + n].astype(np.int64) << 8 * (done - width)
        if 2 * width > depth + 1:
            return code
        wide = power.astype((np.uint16, np.uint32, np.int64)[width.bit_length() - 1])
        power = (wide[:-width] << 8 * width) | wide[width:]
        width *= 2


def runs(stream: bytes, ends: np.ndarray, depth: int = DEPTH, change: Callable = lambda run: run) -> np.ndarray:
    """The run of depth + 1 bytes that ends at each byte of the texts, as an integer, changed."""
    starts = np.concatenate([[0], ends[:-1]])
    padded = np.frombuffer((END * depth).join([b"", *(stream[a:b] for a, b in zip(starts.tolist(), ends.tolist()))]), np.uint8)
    real = np.ones(len(padded), bool)
    for j in range(depth):
        real[starts + depth * np.arange(len(ends)) + j] = False
    out, at = np.empty(len(stream), np.int64), 0
    for i in range(0, len(padded) - depth, CHUNK):
        code = windows(padded[i : i + CHUNK + depth], depth)
        code = code[real[i + depth : i + depth + len(code)]]
        out[at : at + len(code)] = change(code)
        at += len(code)
    return out


CONTEXT = (1 << 8 * CUT) - 1
SPREAD = 0x9E3779B1  # odd, so that it has an inverse
GATHER = pow(SPREAD, -1, CONTEXT + 1)


def placed(run: np.ndarray) -> np.ndarray:
    """The run with its last CUT bytes of context hashed (reversibly) and put first, so that an order by it keeps buckets and contexts together."""
    return (((run >> 8 & CONTEXT) * SPREAD & CONTEXT) << 8 * (DEPTH + 1 - CUT)) | (run >> 8 * (CUT + 1) << 8) | (run & 255)


def unplaced(key: np.ndarray) -> np.ndarray:
    low = 8 * (DEPTH + 1 - CUT)
    return ((key & (1 << low) - 1) >> 8 << 8 * (CUT + 1)) | ((key >> low) * GATHER & CONTEXT) << 8 | (key & 255)


def pack(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences, which compress."""
    return np.diff(keys, prepend=0).tobytes()


def unpack(data: pa.Scalar) -> np.ndarray:
    return np.cumsum(np.frombuffer(data.as_buffer(), np.int64))


def words_of(stream: bytes | pa.Buffer) -> pa.Array:
    """The words, each with the blank behind it, and the ends, of texts or of words one behind the other."""
    text = np.frombuffer(stream, np.uint8)
    offsets = np.concatenate([[0], np.flatnonzero((text == 32) | (text == END[0])) + 1])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(stream)])


def listed(words: pa.Array) -> list[bytes]:
    _, offsets, data = words.buffers()
    at, data = np.frombuffer(offsets, np.int64)[: len(words) + 1].tolist(), data.to_pybytes()
    return [data[a:b] for a, b in zip(at, at[1:])]


def words_per_text(stream: bytes, ends: np.ndarray) -> np.ndarray:
    blanks = np.cumsum(np.frombuffer(stream, np.uint8) == 32)
    return np.diff(blanks[ends - 1], prepend=0) + 1


def in_batches(rows: Iterable[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows of longs and binaries as batches of about ROW_BYTES."""
    fields = [f.split() for f in schema.split(", ")]
    names, types = [f[0] for f in fields], [{"long": pa.int64(), "binary": pa.binary()}[f[1]] for f in fields]
    held: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, bytes))
        if size >= ROW_BYTES or len(held) >= 2000:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def word_rows(words: pa.Array) -> Iterator[tuple[int, int, bytes]]:
    """Words as rows of at most ROW_KEYS and about ROW_BYTES: first, last and the words one behind the other. words: as take() and words_of() give them."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[: len(words) + 1]
    first = 0
    while first < len(words):
        last = max(first + 1, min(first + ROW_KEYS, int(np.searchsorted(at, at[first] + ROW_BYTES, "right")) - 1))
        yield first, last, data[at[first] : at[last]].to_pybytes()
        first = last


def by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Each block with its pieces; the pieces of a block come one after the other."""
    rows = ((block, data.as_py()) for b in batches for block, data in zip(b.column(0).to_pylist(), b.column(2)))
    for block, group in groupby(rows, key=lambda r: r[0]):
        yield block, (pickle.loads(data) for _, data in group)


class Counts:
    """Sums by key, in sorted arrays."""

    def __init__(self):
        self.keys, self.sums, self.waiting, self.size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > max(1 << 18, len(self.keys)):
            self.settle()

    def settle(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.sums, *(c for _, c in self.waiting)])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        self.keys, self.sums = keys[first], np.add.reduceat(counts[order], first) if len(first) else counts
        self.waiting, self.size = [], 0


class WordCounts:
    """Sums by word."""

    def __init__(self):
        self.words, self.sums, self.waiting, self.size = pa.array([], pa.large_binary()), np.empty(0, np.int64), [], 0

    def add(self, words: pa.Array, counts: np.ndarray) -> None:
        self.waiting.append((words, counts))
        self.size += len(words)
        if self.size > max(1 << 18, len(self.words)):
            self.settle()

    def settle(self) -> None:
        coded = pa.concat_arrays([self.words, *(w for w, _ in self.waiting)]).dictionary_encode()
        self.words = coded.dictionary
        self.sums = np.bincount(coded.indices.to_numpy(), np.concatenate([self.sums, *(n for _, n in self.waiting)]), len(self.words)).astype(np.int64)
        self.waiting, self.size = [], 0


def count_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ASKED: the different runs of each block, placed and in order, and their training counts."""

    def rows() -> Iterator[tuple]:
        for block, pieces in by_block(batches):
            counts = Counts()
            for _, held, ends, stream in pieces:
                both = runs(stream, ends, change=placed) << 1
                both |= np.repeat(held, np.diff(ends, prepend=0))
                both.sort()
                trained = ~both & 1
                both >>= 1
                first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
                counts.add(both[first], np.add.reduceat(trained, first))
            counts.settle()
            for i in range(0, len(counts.keys), ROW_KEYS):
                part = counts.keys[i : i + ROW_KEYS]
                yield block, len(part), pack(part), counts.sums[i : i + ROW_KEYS].tobytes()

    return in_batches(rows(), ASKED)


def count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ASKED: the different words of each block, in the order of their hashes, and their training counts."""

    def rows() -> Iterator[tuple]:
        for block, pieces in by_block(batches):
            counts = WordCounts()
            for _, held, ends, stream in pieces:
                coded = words_of(stream).dictionary_encode()
                counts.add(coded.dictionary, np.bincount(coded.indices.to_numpy(), np.repeat(~held, words_per_text(stream, ends)), len(coded.dictionary)))
            counts.settle()
            order = np.argsort(np.array(list(map(crc32, listed(counts.words))), np.int64))
            n = counts.sums[order]
            for a, b, data in word_rows(counts.words.take(pa.array(order))):
                yield block, b - a, data, n[a:b].tobytes()

    return in_batches(rows(), ASKED)


def deal_runs(buckets: int) -> Callable:
    """ASKED to DEALT: rows are cut where a bucket ends."""
    low = 8 * (DEPTH + 1 - CUT)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for block, data, counts in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
                keys = unpack(data)
                first, last = ((keys[[0, -1]] >> low) * buckets >> 8 * CUT).tolist()
                begins = -(-(np.arange(first + 1, last + 1) << 8 * CUT) // buckets) << low
                cuts = [0, *np.searchsorted(keys, begins).tolist(), len(keys)]
                numbers = counts.as_buffer() if counts.is_valid else None
                for bucket, (i, j) in enumerate(zip(cuts, cuts[1:]), first):
                    if i < j:
                        yield bucket, block, pack(keys[i:j]), None if numbers is None else numbers[8 * i : 8 * j].to_pybytes()

    return lambda batches: in_batches(rows(batches), DEALT)


def word_bucket(word: bytes, buckets: int) -> int:
    return crc32(word) * buckets >> 32


def deal_words(buckets: int) -> Callable:
    """ASKED to DEALT: rows are cut where a bucket ends."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for block, data, counts in zip(b.column(0).to_pylist(), b.column(2), b.column(3)):
                text = data.as_buffer()
                words = words_of(text)
                at = np.frombuffer(words.buffers()[1], np.int64)
                bucket_at = lambda i: word_bucket(words[i].as_py(), buckets)
                first, last = bucket_at(0), bucket_at(len(words) - 1)
                cuts = [0]
                for bucket in range(first + 1, last + 1):
                    cuts.append(bisect_left(range(len(words)), bucket, cuts[-1], key=bucket_at))
                cuts.append(len(words))
                numbers = counts.as_buffer() if counts.is_valid else None
                for bucket, (i, j) in enumerate(zip(cuts, cuts[1:]), first):
                    if i < j:
                        yield bucket, block, text[at[i] : at[j]].to_pybytes(), None if numbers is None else numbers[8 * i : 8 * j].to_pybytes()

    return lambda batches: in_batches(rows(batches), DEALT)


def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """The parts of batches in which the first two columns, by which they are sorted, are equal."""
    for b in batches:
        if not b.num_rows:
            continue
        x, y = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
        cuts = (np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1).tolist()
        for first, last in zip([0, *cuts], [*cuts, b.num_rows]):
            yield int(x[first]), int(y[first]), b.slice(first, last - first)


def sum_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SUMS of DEALT, sorted: rows of whole contexts, of about SLICE_RUNS runs."""
    low = 8 * (DEPTH + 1 - CUT)

    def rows() -> Iterator[tuple]:
        for bucket, group in groupby(parts(batches), key=lambda p: p[0]):
            counts = Counts()
            for _, _, part in group:
                for data, n in zip(part.column(2), part.column(3)):
                    counts.add(unpack(data), np.frombuffer(n.as_buffer(), np.int64))
            counts.settle()
            keys, sums, first, number = counts.keys, counts.sums, 0, 0
            while first < len(keys):
                last = len(keys)
                if first + SLICE_RUNS < last:
                    context = keys[first + SLICE_RUNS] >> low
                    last = int(np.searchsorted(keys, context << low))
                    if last == first:
                        last = int(np.searchsorted(keys, context + 1 << low))
                n = sums[first:last]
                yield bucket, number, pack(keys[first:last]), n.tobytes(), int(n.sum()), int((n > 0).sum())
                first, number = last, number + 1

    return in_batches(rows(), SUMS)


def sum_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SUMS of DEALT, sorted."""

    def rows() -> Iterator[tuple]:
        for bucket, group in groupby(parts(batches), key=lambda p: p[0]):
            counts = WordCounts()
            for _, _, part in group:
                for data, n in zip(part.column(2), part.column(3)):
                    counts.add(words_of(data.as_buffer()), np.frombuffer(n.as_buffer(), np.int64))
            counts.settle()
            n = counts.sums
            for number, (a, b, data) in enumerate(word_rows(counts.words)):
                yield bucket, number, data, n[a:b].tobytes(), int(n[a:b].sum()), int((n[a:b] > 0).sum())

    return in_batches(rows(), SUMS)


def decisions(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight nodes of each run, context and bits so far in one integer, and the bit that follows there."""
    byte, k = (run & 255)[:, None], np.arange(8)
    return ((run >> 8)[:, None] << 8) | (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1


def parent(node: np.ndarray, depth: int) -> np.ndarray:
    """The same node in the context shorter by its first byte; depth: that of node."""
    return node & ((1 << 8 * depth) - 1)


def subtree(run: np.ndarray, n: np.ndarray) -> dict[int, tuple]:
    """By depth, from DEPTH to CUT: nodes, counts, log of the weighted probability, share of the own estimate in it, and the children's places above."""
    node, bit = decisions(run)
    key, at = np.unique(node.ravel(), return_inverse=True)
    times, bits = np.repeat(n, 8), bit.ravel()
    n1 = np.bincount(at, times * bits, len(key)).astype(np.int64)
    n0 = np.bincount(at, times, len(key)).astype(np.int64) - n1
    levels, below = {}, None
    for depth in range(DEPTH, CUT - 1, -1):
        own = log_kt(n0, n1)
        if below is None:
            weighted, share = own, np.ones(len(own))
        else:
            weighted = math.log(0.5) + np.logaddexp(own, below)
            share = np.exp(math.log(0.5) + own - weighted)
        levels[depth] = (key, n0, n1, weighted, share, at)
        if depth > CUT:
            key, at = np.unique(parent(key, depth), return_inverse=True)
            below, n0, n1 = np.bincount(at, weighted, len(key)), np.bincount(at, n0, len(key)).astype(np.int64), np.bincount(at, n1, len(key)).astype(np.int64)
    return levels


def rise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of CUT bytes of context. Rows: keys and counts of SUMS."""
    for b in batches:
        for data, n in zip(b.column(0), b.column(1)):
            key, n0, n1, weighted, _, _ = subtree(unplaced(unpack(data)), np.frombuffer(n.as_buffer(), np.int64))[CUT]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, n0, n1, weighted)], ["node", "n0", "n1", "weighted"])


def run_values(run: np.ndarray, n: np.ndarray, node: np.ndarray, one: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """log10 of the probability of each run's last byte; node (sorted), one, rest: what the shallower contexts give a node."""
    levels = subtree(run, n)
    place = np.searchsorted(node, levels[CUT][0])
    one, rest = one[place], rest[place]
    for depth in range(CUT, DEPTH + 1):
        _, n0, n1, _, share, _ = levels[depth]
        if depth > CUT:
            up = levels[depth - 1][5]
            one, rest = one[up], rest[up]
        one = one + rest * share * (n1 + 0.5) / (n0 + n1 + 1)
        rest = rest * (1 - share)
    bit = decisions(run)[1].ravel()
    p = one[levels[DEPTH][5]]
    return np.log10(np.where(bit == 1, p, 1 - p)).reshape(-1, 8).sum(1)


def descend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ANSWERS, with the runs' values. Rows: bucket, kind, number, keys, counts, node, one, rest; of each bucket first (kind 0) nodes, then (1) sums, then (2) what blocks ask for."""

    def rows() -> Iterator[tuple]:
        for bucket, group in groupby(parts(batches), key=lambda p: p[0]):
            nodes, top, keys, values, ready = [], None, [], [], None
            for _, kind, part in group:
                if kind == 0:
                    nodes.append([part.column(i).to_numpy() for i in (5, 6, 7)])
                elif kind == 1:
                    if top is None:
                        node, one, rest = map(np.concatenate, zip(*nodes))
                        order = np.argsort(node)
                        top = node[order], one[order], rest[order]
                    for data, n in zip(part.column(3), part.column(4)):
                        keys.append(unpack(data))
                        values.append(run_values(unplaced(keys[-1]), np.frombuffer(n.as_buffer(), np.int64), *top))
                else:
                    if ready is None:
                        ready = np.concatenate(keys), np.concatenate(values)
                    for block, data in zip(part.column(2).to_pylist(), part.column(3)):
                        yield block, bucket, data.as_py(), ready[1][np.searchsorted(ready[0], unpack(data))].tobytes()

    return in_batches(rows(), ANSWERS)


def answer_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ANSWERS, with the words' training counts. Rows: bucket, kind, number, keys, counts; of each bucket first (kind 1) sums, then (2) what blocks ask for."""

    def looked_up(bucket: int, held: list[tuple], known: pa.Array, counts: np.ndarray) -> Iterator[tuple]:
        asked = [words_of(data.as_buffer()) for _, data in held]
        n = counts[pc.index_in(pa.concat_arrays(asked), known).to_numpy()]
        for (block, data), part in zip(held, np.split(n, np.cumsum([len(words) for words in asked]))):
            yield block, bucket, data.as_py(), part.tobytes()

    def rows() -> Iterator[tuple]:
        for bucket, group in groupby(parts(batches), key=lambda p: p[0]):
            names, numbers, ready, held, size = [], [], None, [], 0
            for _, kind, part in group:
                if kind == 1:
                    names += [words_of(data.as_buffer()) for data in part.column(3)]
                    numbers += [np.frombuffer(n.as_buffer(), np.int64) for n in part.column(4)]
                    continue
                if ready is None:
                    ready = pa.concat_arrays(names), np.concatenate(numbers)
                for block, data in zip(part.column(2).to_pylist(), part.column(3)):
                    held.append((block, data))
                    size += len(data.as_buffer())
                    if size >= max(1 << 20, ready[0].nbytes):  # a search hashes all known words first
                        yield from looked_up(bucket, held, *ready)
                        held, size = [], 0
            if held:
                yield from looked_up(bucket, held, *ready)

    return in_batches(rows(), ANSWERS)


def kt_column(n0: pd.Series, n1: pd.Series) -> pd.Series:
    return pd.Series(log_kt(n0.to_numpy(), n1.to_numpy()))


def shallow(deep: DataFrame) -> DataFrame:
    """node (with a context of CUT bytes), one (what the contexts of fewer bytes add to the probability of bit 1) and rest (the share left to longer ones)."""
    half = F.lit(math.log(0.5))
    estimate = F.pandas_udf(kt_column, "double")
    levels, below = {}, deep
    for depth in range(CUT - 1, -1, -1):
        node = F.col("node").bitwiseAND((1 << 8 * (depth + 1)) - 1)
        sums = below.groupBy(node.alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("weighted").alias("below"))
        sums = sums.withColumn("own", estimate("n0", "n1"))
        high, low = F.greatest("own", "below"), F.least("own", "below")
        sums = sums.withColumn("weighted", half + high + F.log1p(F.exp(low - high)))
        below = levels[depth] = materialise(sums.withColumn("share", F.exp(half + F.col("own") - F.col("weighted"))), "ctw-level")
    bit = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    out = levels[0].select("node", (F.col("share") * bit).alias("one"), (1 - F.col("share")).alias("rest"))
    for depth in range(1, CUT):
        up = out.toDF("u_node", "u_one", "u_rest")
        at = levels[depth].join(up, F.col("node").bitwiseAND((1 << 8 * depth) - 1) == F.col("u_node"))
        out = at.select("node", (F.col("u_one") + F.col("u_rest") * F.col("share") * bit).alias("one"), (F.col("u_rest") * (1 - F.col("share"))).alias("rest"))
    up = out.toDF("u_node", "one", "rest")
    return deep.join(up, F.col("node").bitwiseAND((1 << 8 * CUT) - 1) == F.col("u_node")).select("node", "one", "rest")


def number_of_buckets(asked: DataFrame) -> int:
    return max(LEAST_BUCKETS, -(-asked.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // BUCKET_KEYS))


def summed(asked: DataFrame, deal: Callable, add: Callable, name: str) -> DataFrame:
    dealt = asked.mapInArrow(tidy(deal), DEALT)
    return materialise(dealt.repartition("bucket").sortWithinPartitions("bucket", "number").mapInArrow(tidy(add), SUMS), name)


def question(asked: DataFrame, deal: Callable, sums: DataFrame) -> DataFrame:
    """bucket, kind, number, keys, counts: sums (kind 1) and what blocks ask for (2)."""
    bare = asked.select("block", "n", "keys", F.lit(None).cast("binary").alias("counts")).mapInArrow(tidy(deal), DEALT)
    kinds = [df.select("bucket", F.lit(kind).alias("kind"), "number", "keys", "counts") for kind, df in ((1, sums), (2, bare))]
    return kinds[0].union(kinds[1])


def learn(asked: DataFrame) -> DataFrame:
    """ANSWERS: log10 of the probability of each run's last byte after the others, for each block's runs (those that don't occur in training texts have 0 as count)."""
    buckets = number_of_buckets(asked)
    deal = deal_runs(buckets)
    sums = summed(asked, deal, sum_runs, "ctw-counts")
    deep = materialise(sums.select("keys", "counts").mapInArrow(tidy(rise), "node long, n0 long, n1 long, weighted double"), "ctw-deep")
    spread = (F.shiftright("node", 8).bitwiseAND(CONTEXT) * F.lit(SPREAD).cast("long")).bitwiseAND(CONTEXT)
    none = F.lit(None).cast("binary")
    top = shallow(deep).select(F.shiftright(spread * F.lit(buckets).cast("long"), 8 * CUT).alias("bucket"), F.lit(0).alias("kind"), F.col("node").alias("number"), none.alias("keys"), none.alias("counts"), "node", "one", "rest")
    rows = question(asked, deal, sums).select("*", F.lit(None).cast("long").alias("node"), F.lit(None).cast("double").alias("one"), F.lit(None).cast("double").alias("rest"))
    return rows.union(top).repartition("bucket").sortWithinPartitions("bucket", "kind", "number").mapInArrow(tidy(descend), ANSWERS)


BYTE_SCORES = "block long, piece long, place long, doc_id long, held_out boolean, score double, n_bytes long"
WORD_SCORES = "block long, piece long, place long, n_tokens long, n_known long, base_score double"


def beside(answers: DataFrame, blocks: DataFrame) -> DataFrame:
    """block, is_piece, number, data, counts: each block's answers, in the order of their buckets, then its pieces, together in a partition."""
    rows = answers.select("block", F.lit(False).alias("is_piece"), "number", F.col("keys").alias("data"), "counts")
    rows = rows.union(blocks.select("block", F.lit(True), "piece", "data", F.lit(None).cast("binary")))
    return rows.repartition("block").sortWithinPartitions("block", "is_piece", "number")


def with_answers(batches: Iterable[pa.RecordBatch], gather: Callable) -> Iterator[tuple]:
    """block, piece number, piece, and what gather makes of the block's answers, pairs of data and counts."""
    for block, group in groupby(parts(batches), key=lambda p: p[0]):
        answers, ready = [], None
        for _, is_piece, part in group:
            if not is_piece:
                answers += [(data, n.as_buffer()) for data, n in zip(part.column(3), part.column(4))]
                continue
            if ready is None:
                ready, answers = gather(answers), []
            for number, data in zip(part.column(2).to_pylist(), part.column(3)):
                yield block, number, pickle.loads(data.as_buffer()), ready


def score_bytes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """BYTE_SCORES. Answers: placed runs, in order, and their values."""

    def gather(answers: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([unpack(a) for a, _ in answers]), np.concatenate([np.frombuffer(v, np.float64) for _, v in answers])

    for block, piece, (ids, held, ends, stream), (key, value) in with_answers(batches, gather):
        size, n = np.diff(ends, prepend=0), len(ids)
        run = runs(stream, ends, change=placed)
        worth = np.empty(len(run))
        for i in range(0, len(run), CHUNK):  # each different one of a chunk is looked up once, in order
            part = run[i : i + CHUNK].astype(np.uint64) << 16 | np.arange(min(CHUNK, len(run) - i), dtype=np.uint64)
            part.sort()
            asked = (part >> 16).astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], asked[1:] != asked[:-1]]))
            worth[i : i + CHUNK][part.astype(np.uint16)] = np.repeat(value[np.searchsorted(key, asked[first])], np.diff(first, append=len(asked)))
        score = np.add.reduceat(worth, ends - size)
        columns = [np.full(n, block), np.full(n, piece), np.arange(n), pa.array(ids, pa.int64()), held, score, size]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "piece", "place", "doc_id", "held_out", "score", "n_bytes"])


def score_words(tokens: int, different: int) -> Callable:
    """Gives WORD_SCORES. tokens, different: training tokens, and words among them; answers: words and their counts."""
    unseen = tokens + 0.5 * (different + 1)

    def gather(answers: list[tuple]) -> tuple[pa.Array, np.ndarray]:
        return pa.concat_arrays([words_of(a.as_buffer()) for a, _ in answers]), np.concatenate([np.frombuffer(n, np.int64) for _, n in answers])

    def scores(held: list[tuple], known: pa.Array, count: np.ndarray) -> Iterator[pa.RecordBatch]:
        worth, seen = np.log10((count + 0.5) / unseen), (count > 0).astype(np.int64)
        coded = [words_of(stream).dictionary_encode() for _, _, _, stream in held]
        place = pc.index_in(pa.concat_arrays([c.dictionary for c in coded]), known).to_numpy()
        done = 0
        for (block, piece, ends, stream), c in zip(held, coded):
            size, n = words_per_text(stream, ends), len(ends)
            last = np.cumsum(size)
            mine = place[done : done + len(c.dictionary)][c.indices.to_numpy()]
            done += len(c.dictionary)
            value = worth[mine].tolist()
            base = np.array([math.fsum(value[a:b]) for a, b in zip((last - size).tolist(), last.tolist())], float)
            columns = [np.full(n, block), np.full(n, piece), np.arange(n), size, np.add.reduceat(seen[mine], last - size), base]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "piece", "place", "n_tokens", "n_known", "base_score"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(with_answers(batches, gather), key=lambda p: p[0]):
            held, size = [], 0
            for block, piece, (_, _, ends, stream), ready in group:
                held.append((block, piece, ends, stream))
                size += len(stream)
                if size >= GROUP_BYTES:  # a search hashes all known words first
                    yield from scores(held, *ready)
                    held, size = [], 0
            if held:
                yield from scores(held, *ready)

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, score, n_bytes, n_tokens, n_known, base_score, train_tokens and bits_per_byte of each document."""
    spark = docs.sparkSession
    blocks = materialise(to_blocks(docs), "ctw-blocks")
    asked = materialise(blocks.mapInArrow(tidy(count_runs), ASKED), "ctw-runs")
    answers = learn(asked)
    free(spark)
    by_byte = materialise(beside(answers, blocks).mapInArrow(tidy(score_bytes), BYTE_SCORES), "ctw-byte-scores")
    free(spark)
    words = materialise(blocks.mapInArrow(tidy(count_words), ASKED), "ctw-words")
    deal = deal_words(number_of_buckets(words))
    sums = summed(words, deal, sum_words, "ctw-word-counts")
    total = sums.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("different"), F.lit(0))).first()
    free(spark)
    answers = question(words, deal, sums).repartition("bucket").sortWithinPartitions("bucket", "kind", "number").mapInArrow(tidy(answer_words), ANSWERS)
    by_word = beside(answers, blocks).mapInArrow(tidy(score_words(total[0], total[1])), WORD_SCORES)
    rows = by_byte.join(by_word, ["block", "piece", "place"]).drop("block", "piece", "place")
    return rows.withColumns({"train_tokens": F.lit(int(total[0])).cast("long"), "bits_per_byte": -F.col("score") * math.log2(10) / F.col("n_bytes")})
