"""Encoding, decoding, packing, ORC and chat against the tokenizers library and plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from helixframe.llm import bpe, chat, packing, token_orc, tokens
from helixframe.llm.common import new_path

DOC = "doc_id long, text string, ids string"
ODD = ["", "a", "  ", "hello  world \n\n x", "don't 's  'll <|endoftext|> x<|endoftext|>", "日本語テキスト", "\x1c\x1d a\x85b\xa0c", "😀😀 ñ", "ABCDEFGHIJK" * 50, "a" * 5000, "　 x﻿ y​ z", " \n" * 400]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


def drawn(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice("abceithsnro  '\n\t.,!?éñ漢1234-_<|>\x1c\xa0") for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_both_encoders_equal_the_library(library):
    own, fast = bpe.load(), bpe.load_library()
    for t in ODD + drawn(1500):
        want = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t).tolist() == want and fast.encode(t).tolist() == want
        assert own.decode_text(own.encode(t)) == library.decode(want, skip_special_tokens=False)


LONG = {"blanks": " " * 2_000_000, "line breaks": "\n" * 2_000_000, "mixed": " \n" * 1_000_000, "tail": "a" + " \t" * 700_000 + "b", "word": "na" * 300_000, "marks": "#!" * 300_000}


@pytest.mark.parametrize("name", LONG)
def test_very_long_runs(library, name):
    text = LONG[name]
    want = library.encode(text, add_special_tokens=False).ids
    own, fast = bpe.load(), bpe.load_library()
    assert own.encode(text).tolist() == want and fast.encode(text).tolist() == want
    assert np.frombuffer(fast.packed_plain(text), fast.dtype).tolist() == want
    assert own.decode_text(own.encode(text)) == text


def test_very_long_runs_in_operators(spark, library):
    """Encoding, ORC, packing and chat on whole rows of 2 million blanks, line breaks and both."""
    rows = [(i, t, "x") for i, t in enumerate(LONG.values())]
    df = spark.createDataFrame(rows, DOC)
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t, _ in rows}
    assert {r.doc_id: r.tokens for r in tokens.encode(df, out="tokens").collect()} == want
    path = new_path(spark, "test-long")
    token_orc.write_token_orc(df, path)
    assert {r.doc_id: r.ids[:-1] for r in token_orc.read_token_orc(spark, path).collect()} == want
    pieces = defaultdict(list)
    for r in packing.pack(df).collect():
        pieces[r.doc_id].append((r.start, r.ids))
    assert {i: [x for _, ids in sorted(p) for x in ids][:-1] for i, p in pieces.items()} == want
    got = chat.digests(chat.format_turns(df.selectExpr("doc_id conv_id", "0 turn", "'assistant' role", "text"))).collect()
    assert {r.conv_id: r.loss_sha256 for r in got} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t, _ in rows}


def test_taken_name(spark):
    with pytest.raises(ValueError, match="ids"):
        tokens.encode(spark.createDataFrame([], DOC))


def test_backtracking_of_long_pieces(library):
    own = bpe.load()
    for t in ("thethe" * 300, "tiontionhe" * 200, "aab" * 500):
        assert own._backtrack(t) == own.piece(t) == library.encode(t, add_special_tokens=False).ids


def test_store_that_is_emptied(monkeypatch):
    own = bpe.Bpe(bpe.default_path())
    want = [own.encode(t).tolist() for t in drawn(50)]
    monkeypatch.setattr(bpe, "STORE", 5)
    assert [own.encode(t).tolist() for t in drawn(50)] == want


def test_encode_and_decode_frames(spark, library):
    rows = [(i, t, "clash") for i, t in enumerate(ODD)] + [(None, None, None), (3, "twice", "x"), (3, "twice", "x")]
    df = tokens.decode(tokens.encode(spark.createDataFrame(rows, DOC), out="tokens"), ids="tokens")
    got = df.collect()
    assert len(got) == len(rows) and df.columns == ["doc_id", "text", "ids", "tokens", "decoded"]
    assert all(r.decoded == (r.text or "") and r.tokens == library.encode(r.text or "", add_special_tokens=False).ids for r in got)
    assert tokens.encode(spark.createDataFrame([], DOC), out="tokens").count() == 0


def place_all(lengths, rooms):
    pieces = packing.place(lengths, rooms)
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for d, s, n, q, o in pieces:
        assert n > 0
        by_doc[d].append((s, n))
        by_seq[q].append((o, n))
    for parts, wanted in ((by_doc, dict(enumerate(lengths))), (by_seq, dict(enumerate(rooms)))):
        for k, v in parts.items():
            at = 0
            for s, n in sorted(v):
                assert s == at
                at += n
            assert at == wanted[k]
    return pieces


def test_place():
    rng = random.Random(1)
    for _ in range(60):
        lengths = [rng.choice([1, 5, 100, 700, 2048, 2049, 5000]) + rng.randint(0, 30) for _ in range(rng.randint(1, 60))]
        total = sum(lengths)
        place_all(lengths, [2048] * (total // 2048) + packing.powers(total % 2048))
    assert place_all([], []) == []
    # The longest document opens the cheapest sequence, the next ones go where cost is least.
    assert [(p[0], p[3]) for p in packing.place([6, 5, 3, 2], [8, 8])] == [(0, 0), (1, 1), (2, 1), (3, 0)]


@pytest.mark.parametrize("rows", [[], [(1, None, "x")], [(i % 7, " ".join(["word"] * (i * 37 % 900)), "x") for i in range(60)] + [(None, "tail " * 6000, None)], [(i, " ".join(["some"] * (i * 53 % 1900)), "x") for i in range(40)]])
def test_pack(spark, library, rows):
    got = packing.pack(spark.createDataFrame(rows, DOC).coalesce(1), window_tokens=4096).collect()
    want = sorted(tuple(library.encode(t or "", add_special_tokens=False).ids + [1]) for _, t, _ in rows)
    assert sum(r.length for r in got) == sum(map(len, want))
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length and r.length > 0
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, r.ids, r.doc_tokens))
    for v in by_seq.values():  # gapless from 0, and full or a power of two
        ends = [0, *(o + n for o, n in sorted(v))]
        assert [o for o, _ in sorted(v)] == ends[:-1] and (ends[-1] == 2048 or ends[-1] & (ends[-1] - 1) == 0)
    if len({r[0] for r in rows}) == len(rows):  # each id of a document in one piece, in order
        for i, t, _ in rows:
            ids = library.encode(t or "", add_special_tokens=False).ids + [1]
            assert [x for _, p, _ in sorted(by_doc[i], key=lambda p: p[0]) for x in p] == ids and {n for _, _, n in by_doc[i]} == {len(ids)}
    digests = packing.pack(spark.createDataFrame(rows, DOC).coalesce(1), window_tokens=4096, crc=True).collect()
    key = lambda r: (r.sequence_id, r.offset)
    assert [r.ids_crc32 for r in sorted(digests, key=key)] == [zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in sorted(got, key=key)]


def test_token_orc(spark, library):
    rows = [(i * 3 % 50, f"text {i} " * (i % 9), "x") for i in range(50)] + [(7, "again", "x"), (7, "again", "x"), (None, None, None)]
    path = new_path(spark, "test-orc")
    token_orc.write_token_orc(spark.createDataFrame(rows, DOC).repartition(3), path)
    got = token_orc.read_token_orc(spark, path).orderBy("start").collect()
    assert got[0].doc_id is None and [r.doc_id for r in got[1:]] == sorted(r[0] for r in rows[:-1])
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 2
        at += r.n_tokens
    assert sorted(tuple(r.ids) for r in got) == sorted(tuple(library.encode(t or "", add_special_tokens=False).ids + [2]) for _, t, _ in rows)
    some = token_orc.read_token_orc(spark, path, [6, 7])
    assert {r.doc_id for r in some.collect()} == {6, 7} and some.count() == sum(r[0] in (6, 7) for r in rows)
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()
    empty = new_path(spark, "test-orc")
    token_orc.write_token_orc(spark.createDataFrame([], DOC), empty)
    assert token_orc.read_token_orc(spark, empty).count() == 0


def test_escapes():
    own = chat.template()
    rng = random.Random(4)
    parts = [*chat.CONTROL, "<", "[", "\\", "/s>", "INST]", "|turn|>", "x", " ", "<\\|turn|>", "<\\\\|done|>"]
    for t in ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]:
        out = own.escape(t)
        assert own.unescape(out) == t and not any(c in out for c in chat.CONTROL)


def test_chat(spark):
    rows = [(1, 2, "assistant", "second </s> \\ x"), (1, 0, "user", "<|turn|>hi<|endoftext|>"), (1, 1, "assistant", "été 漢"), (2, 0, "system", None), (None, None, None, "lost"), (None, 1, "tool|>", "x"), (3, 5, "user", "a"), (3, 5, "user", "a")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, ids long")
    turns = chat.format_turns(df)
    got = {r.conv_id: r for r in chat.digests(turns).collect()}
    by = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1])):
        by[c].append((role or "", text or ""))
    assert set(got) == set(by)
    for c, ts in by.items():
        learnt = "".join(t for r, t in ts if r == "assistant")
        assert got[c].n_turns == len(ts) and got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert got[c].formatted_chars >= sum(len(r) + len(t) for r, t in ts)
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0
    size = bpe.load().size
    assert all(sum(i >= size for i in r.ids) == 3 and 50256 not in r.ids for r in turns.collect())
