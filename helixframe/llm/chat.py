r"""Chat formatting at the level of tokens.

A turn is <|turn|> role <|says|> text <|done|>. The three marks are reserved ids after the vocabulary; they are spliced between the separately
encoded role and text, so no text can produce them. The loss mask is the running sum of +1 where an assistant's text begins and -1 where it ends.
Control strings within a text are escaped all the same, for whoever renders the ids as text and reads them again: a backslash goes behind the
first character of each, or of one with backslashes there already, so taking one off gives the text back.

A null role or text counts as empty; rows of a null conv_id form one conversation. Turns of equal number stand in the order of their ids, null
numbers first; repeated rows are repeated turns. Extra columns are left out. An empty table gives no rows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm import bpe
from helixframe.llm.common import light, tidy, utf8
from helixframe.llm.tokens import id_lists, list_parts

MARKS = ("<|turn|>", "<|says|>", "<|done|>")
CONTROL = (*MARKS, "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TURNS = "conv_id long, turn long, ids array<int>, loss_mask array<tinyint>"


class Template:
    def __init__(self, encoder: bpe.Bpe, learn: tuple[str, ...] = ("assistant",), control: tuple[str, ...] = CONTROL):
        self.encoder, self.learn = encoder, learn
        self.begin, self.says, self.done = range(encoder.size, encoder.size + 3)
        by_first: dict[str, list[str]] = {}
        for c in sorted(control, key=len, reverse=True):
            by_first.setdefault(c[0], []).append(re.escape(c[1:]))
        ways = "|".join(rf"(?<={re.escape(f)})(\\*)(?=(?:{'|'.join(r)}))" for f, r in sorted(by_first.items()))
        self.found = re.compile(ways)

    def escape(self, text: str) -> str:
        return self.found.sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self.found.sub(lambda m: m[0][1:], text)

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a turn and its loss mask."""
        pieces = [np.frombuffer(self.encoder.packed_plain(self.escape(x)), self.encoder.dtype).astype(np.int32) for x in (role, text)]
        ids = np.concatenate([[self.begin], pieces[0], [self.says], pieces[1], [self.done]]).astype(np.int32)
        step = np.zeros(len(ids) + 1, np.int8)
        if role in self.learn:
            step[2 + len(pieces[0])] += 1
            step[2 + len(pieces[0]) + len(pieces[1])] -= 1
        return ids, np.cumsum(step[:-1], dtype=np.int8)

    def read(self, ids: np.ndarray, mask: np.ndarray) -> Iterator[tuple[str, str, str, int]]:
        """Role, text, text under the mask and characters as rendered, of each turn in ids."""
        starts = np.flatnonzero(ids == self.begin)
        for a, b in zip(starts, [*starts[1:], len(ids)]):
            part, on = ids[a:b], mask[a:b]
            says, done = (int(np.flatnonzero(part == x)[0]) for x in (self.says, self.done))
            role, text = (self.encoder.decode_text(part[i:j]) for i, j in ((1, says), (says + 1, done)))
            learnt = self.unescape(self.encoder.decode_text(part[on == 1]))
            yield self.unescape(role), self.unescape(text), learnt, len(role) + len(text) + sum(map(len, MARKS))


@lru_cache(maxsize=2)
def template(tokenizer: str | None = None, ranks: str | None = None) -> Template:
    return Template(bpe.load_library(tokenizer, ranks))


def format_turns(df: DataFrame, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """conv_id, turn, ids and loss_mask of each row, in order of turns within each partition; all rows of a conversation are in one partition.

    Turns are encoded where they are read; only ids and masks are exchanged."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = template(tokenizer, ranks)
        for b in batches:
            out = [own.turn(r.decode(), t.decode()) for r, t in zip(utf8(b.column(2)), utf8(b.column(3)))]
            masks = id_lists([m for _, m in out]).cast(pa.list_(pa.int8()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), id_lists([i for i, _ in out]), masks], ["conv_id", "turn", "ids", "loss_mask"])

    light(df.sparkSession)
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), TURNS).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "ids")


def digests(turns: DataFrame, tokenizer: str | None = None, ranks: str | None = None) -> DataFrame:
    """Per conversation what reading its tokens back gives; a conversation streams through, only hashes and sums are held."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = template(tokenizer, ranks)
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, rows, state = None, [], None

        def close() -> None:
            if state is not None:
                rows.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in batches:
            for conv, ids, mask in zip(b.column(0).to_pylist(), list_parts(b.column(2)), list_parts(b.column(3))):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, learnt, chars in own.read(ids, mask):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                    state[4] += chars
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], OUT)
                rows = []
        close()
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], OUT)

    return turns.mapInArrow(tidy(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


OUT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
