"""Packing of documents into training sequences, balanced by cost.

A piece of n tokens costs linear * n + quadratic * n * n, as attention stays within it. Per window of documents, sequences of the full length are
opened as the tokens need; documents go in descending order to the cheapest sequence that has room for them. One that fits nowhere is cut: it fills
the cheapest sequence and its rest is placed next. A window takes a whole number of full sequences, the rest of its last document waits for the next
window; what is left at the end of a partition is dealt to sequences of the powers of two that sum to it, which need no padding. So no sequence has
padding, and nothing is shuffled: a task packs what it reads.

Null texts count as empty (their end id alone). Repeated rows and ids are packed each for themselves. Extra columns are left out. An empty table
gives no rows. Memory holds one window (window_tokens, or one longer document)."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from helixframe.llm import bpe
from helixframe.llm.common import texts, tidy
from helixframe.llm.tokens import encode_batches, id_lists, list_parts

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
#: Sequence ids of a task: its partition number, then a counter of this many bits, so that ids need no exchange.
COUNTER_BITS = 33


def powers(n: int) -> list[int]:
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def place(lengths: list[int], rooms: list[int], linear: float = 1.0, quadratic: float = 1 / 1024) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for each piece. The rooms must hold all lengths."""
    room = np.array(rooms, np.int64)
    full, used, cost = room.copy(), np.zeros(len(room), np.int64), np.where(room > 0, 0.0, np.inf)
    out: list[tuple[int, int, int, int, int]] = []
    most = max(rooms, default=0)

    def put(doc: int, start: int, n: int, s: int) -> None:
        out.append((doc, start, n, s, int(used[s])))
        used[s] += n
        cost[s] += linear * n + quadratic * n * n
        if used[s] == full[s]:
            cost[s] = np.inf
        room[s] -= n

    pieces = []
    for doc, n in enumerate(lengths):
        cuts = n // most * most if most else 0
        pieces += [(doc, i, most) for i in range(0, cuts, most)]
        if n > cuts:
            pieces.append((doc, cuts, n - cuts))
    pieces.sort(key=lambda p: (-p[2], p[0], p[1]))
    for doc, start, n in pieces:
        while n:
            s = int(np.argmin(np.where(room >= n, cost, np.inf)))
            if room[s] < n or np.isinf(cost[s]):
                s = int(np.argmin(cost))
            take = int(min(n, room[s]))
            put(doc, start, take, s)
            start, n = start + take, n - take
    return out


def pack_batches(batches: Iterable[pa.RecordBatch], encoder: bpe.Bpe, end: int, length: int, window_tokens: int, linear: float, quadratic: float, crc: bool) -> Iterator[pa.RecordBatch]:
    base, done = TaskContext.get().partitionId() << COUNTER_BITS, 0
    waiting: list[tuple[int | None, int, np.ndarray, int]] = []  # id, start, ids from there, tokens of the document
    held = 0

    def flush(rooms: list[int]) -> pa.RecordBatch:
        nonlocal waiting, held, done
        budget, window, rest = sum(rooms), [], []
        for doc, start, ids, total in waiting:
            take = min(len(ids), budget)
            budget -= take
            if take:
                window.append((doc, start, ids[:take], total))
            if take < len(ids):
                rest.append((doc, start + take, ids[take:], total))
        pieces = place([len(w[2]) for w in window], rooms, linear, quadratic)
        parts = [window[d][2][a : a + n] for d, a, n, _, _ in pieces]
        rows = [
            pa.array([window[p[0]][0] for p in pieces], pa.int64()),
            pa.array([window[p[0]][1] + p[1] for p in pieces], pa.int64()),
            pa.array([p[2] for p in pieces], pa.int64()),
            pa.array([window[p[0]][3] for p in pieces], pa.int64()),
            pa.array([base + done + p[3] for p in pieces], pa.int64()),
            pa.array([p[4] for p in pieces], pa.int64()),
            pa.array(map(crc32, parts), pa.int64()) if crc else id_lists(parts),
        ]
        done += len(rooms)
        waiting, held = rest, sum(len(r[2]) for r in rest)
        return pa.RecordBatch.from_arrays(rows, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32" if crc else "ids"])

    for b in encode_batches(batches, encoder=encoder, end=end):
        column = b.column(b.schema.get_field_index("ids"))
        for doc, ids in zip(b.column(0).to_pylist(), list_parts(column)):
            waiting.append((doc, 0, ids, len(ids)))
            held += len(ids)
            if held >= window_tokens:
                yield flush([length] * (held // length))
    if held:
        yield flush([length] * (held // length) + powers(held % length))


def pack(df: DataFrame, length: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, ranks: str | None = None, window_tokens: int = 1 << 20, linear: float = 1.0, quadratic: float = 1 / 1024, crc: bool = False) -> DataFrame:
    """One row for each piece, with its ids: doc_id, start, length, doc_tokens, sequence_id, offset, ids; with crc, ids_crc32 in place of the ids."""
    rows = texts(df, id_col, text_col)
    schema = SCHEMA + ("ids_crc32 long" if crc else "ids array<int>")
    return rows.mapInArrow(tidy(lambda bs: pack_batches(bs, bpe.load_library(tokenizer, ranks), end, length, window_tokens, linear, quadratic, crc)), schema)


def crc32(ids: np.ndarray) -> int:
    """Of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<i4").tobytes())


def with_crc(df: DataFrame) -> DataFrame:
    """In place of the ids, their crc32."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("ids")
            yield b.set_column(at, "ids_crc32", pa.array(map(crc32, list_parts(b.column(at))), pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" if f.name != "ids" else "ids_crc32 long" for f in df.schema.fields)
    return df.mapInArrow(tidy(run), fields)
