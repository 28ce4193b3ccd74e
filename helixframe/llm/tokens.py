"""Encoding and decoding of a text column (see bpe.py for the method).

Nulls count as empty texts and give no ids. Rows, ties and repeated rows stay as they are; extra columns pass through, and the new column's name
may not be one of theirs. Memory holds one slice of about 8 MB of text, or one longer text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from helixframe.llm import bpe
from helixframe.llm.common import appended, slices, tidy, utf8

IDS = T.ArrayType(T.IntegerType(), False)


def id_lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    values = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def list_parts(column: pa.ListArray) -> Iterator[np.ndarray]:
    """Each row's ids, null as none, as views of one buffer."""
    values = column.values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        yield values[a:b] if column[i].is_valid else values[:0]


def encode_batches(batches: Iterable[pa.RecordBatch], text: str = "text", out: str = "ids", encoder: bpe.Bpe | None = None, end: int | None = None) -> Iterator[pa.RecordBatch]:
    encoder = encoder or bpe.load()
    last = [] if end is None else [end]
    for b in batches:
        at = b.schema.get_field_index(text)
        for part in slices([b], at):
            ids = [encoder.encode(x.decode()) for x in utf8(part.column(at))]
            ids = [np.append(x, last).astype(np.int32) for x in ids] if last else ids
            yield part.append_column(out, id_lists(ids))


def decode_batches(batches: Iterable[pa.RecordBatch], ids: str = "ids", out: str = "decoded", encoder: bpe.Bpe | None = None) -> Iterator[pa.RecordBatch]:
    encoder = encoder or bpe.load()
    for b in batches:
        texts = [encoder.decode_text(x) for x in list_parts(b.column(b.schema.get_field_index(ids)))]
        yield b.append_column(out, pa.array(texts, pa.string()))


def encode(df: DataFrame, text: str = "text", out: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """Appends the ids of each text as array<int>. tokenizer: path of a byte-level BPE vocabulary file."""
    if out.lower() in map(str.lower, df.columns):
        raise ValueError(f"there is a column {out} already")
    return df.mapInArrow(tidy(lambda bs: encode_batches(bs, text, out, bpe.load(tokenizer))), appended(df, (out, IDS)))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """Appends the text of each array of ids; bytes that aren't UTF-8 become U+FFFD. A null array gives an empty text."""
    if out.lower() in map(str.lower, df.columns):
        raise ValueError(f"there is a column {out} already")
    return df.mapInArrow(tidy(lambda bs: decode_batches(bs, ids, out, bpe.load(tokenizer))), appended(df, (out, T.StringType())))
