"""Context-tree weighting against a plain recursion over dictionaries."""

import collections
import math
import pickle
import re
import zlib

import pytest

from helixframe.llm import ctw

DOC = "doc_id long, text string, source string"


def lgamma_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)


def brute(docs, depth):
    seqs = {i: (" ".join([*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})), "\n"]) if (t or "").strip(" \t\n\r\x0b\x0c") else "\n").encode() for i, t in docs}
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i in seqs}
    count = collections.defaultdict(lambda: [0, 0])
    kids = collections.defaultdict(set)

    def walk(seq):
        past = b"\n" * depth + seq
        for k in range(depth, len(past)):
            for bit in range(8):
                node = 1 << bit | past[k] >> (8 - bit)
                yield past[k - depth : k], node, past[k] >> (7 - bit) & 1

    for i, s in seqs.items():
        if not held[i]:
            for context, node, bit in walk(s):
                for d in range(depth + 1):
                    c = context[depth - d :]
                    count[c, node][bit] += 1
                    if d < depth:
                        kids[c, node].add(context[depth - d - 1 :])
    memo = {}

    def weighted(c, node):
        if (c, node) not in memo:
            own = lgamma_kt(*count[c, node]) if (c, node) in count else 0.0
            if len(c) < depth:
                below = sum(weighted(k, node) for k in kids[c, node])
                high, low = max(own, below), min(own, below)
                own = math.log(0.5) + high + math.log1p(math.exp(low - high))
            memo[c, node] = own
        return memo[c, node]

    out = {}
    for i, s in seqs.items():
        total = 0.0
        for context, node, bit in walk(s):
            p, rest = 0.0, 1.0
            for d in range(depth + 1):
                c = context[depth - d :]
                n = count[c, node] if (c, node) in count else [0, 0]
                share = 1.0 if d == depth else math.exp(math.log(0.5) + lgamma_kt(*n) - weighted(c, node)) if (c, node) in count else 0.5
                p += rest * share * (n[bit] + 0.5) / (sum(n) + 1)
                rest *= 1 - share
            total += math.log10(p)
        out[i] = total
    words = {i: [*s.decode()[:-1].split(" ")[:-1], "\n"] if len(s) > 1 else ["\n"] for i, s in seqs.items()}
    c = collections.Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    base = {i: (len(ws), sum(c[w] > 0 for w in ws), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, ws in words.items()}
    return out, base, held, n


@pytest.mark.parametrize("n", [40, 1])
def test_scores_equal_brute_force(spark, n):
    words = ["the", "The", "cat", "sat", "été", "x", "on", "mat."]
    docs = [(i, " ".join(words[(i * k) % 8] for k in range(1, 4 + i % 9)) + "\n tail", "s") for i in range(n)] + [(100, None, "s"), (101, "  ", None), (102, "a" * 300, "s"), (None, "no id", "s")]
    want, base, held, train = brute([d[:2] for d in docs], ctw.DEPTH)
    rows = ctw.score(spark.createDataFrame(docs, DOC).repartition(3)).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.held_out, r.train_tokens, r.n_tokens, r.n_known) == (held[r.doc_id], train, *base[r.doc_id][:2])
        assert r.base_score == pytest.approx(base[r.doc_id][2], abs=1e-9)
        assert r.score == pytest.approx(want[r.doc_id], rel=1e-8)
        assert r.bits_per_byte == pytest.approx(-r.score * math.log2(10) / r.n_bytes)


def test_repeated_rows(spark):
    docs = [(7, "same text here", "s")] * 5 + [(8, "other text", "s")]
    rows = ctw.score(spark.createDataFrame(docs, DOC)).collect()
    assert len(rows) == 6 and len({r.score for r in rows if r.doc_id == 7}) == 1


def test_empty(spark):
    assert ctw.score(spark.createDataFrame([], DOC)).collect() == []


def test_runs_do_not_cross_texts():
    stream, ends = b"ab \ncd \n", __import__("numpy").array([4, 8])
    code = ctw.runs(stream, ends, 2)
    assert [bytes([x >> 16, x >> 8 & 255, x & 255]) for x in code.tolist()] == [b"\n\na", b"\nab", b"ab ", b"b \n", b"\n\nc", b"\ncd", b"cd ", b"d \n"]


def test_buckets(monkeypatch):
    """Runs and words of a block travel in few rows, cut at any bucket, and come back with the sums over all blocks."""
    np, pa = pytest.importorskip("numpy"), pytest.importorskip("pyarrow")
    texts = [[b"a b \n", b"\n", b"abc b a abc \n"], [b"b b xyz \n", b"new \n"], [bytes(range(97, 123)) * 20 + b" \n"]]
    held = [[False, True, False], [False, True], [False]]
    pieces = [pickle.dumps((list(range(len(t))), np.array(h), np.cumsum([len(x) for x in t]), b"".join(t))) for t, h in zip(texts, held)]
    blocks = [pa.RecordBatch.from_arrays([pa.array([5, 6, 7]), pa.array([0, 0, 0]), pa.array(pieces)], ["block", "piece", "data"])]
    runs = ctw.runs(b"".join(texts[0]), np.cumsum([len(x) for x in texts[0]]))
    assert (ctw.unplaced(ctw.placed(runs)) == runs).all()
    assert sum(b.num_rows for b in ctw.count_runs(blocks)) == sum(b.num_rows for b in ctw.count_words(blocks)) == 3
    trained = [t for ts, hs in zip(texts, held) for t, h in zip(ts, hs) if not h]
    as_runs = lambda ts: [int(r) for t in ts for r in ctw.runs(t, np.array([len(t)]), change=ctw.placed)]
    as_words = lambda ts: [w for t in ts for w in re.findall(rb"[^ \n]+ |\n", t)]

    def through(count, deal, add, keys_of):
        dealt = sorted((r for b in deal([b for b in count(blocks)]) for r in b.to_pylist()), key=lambda r: (r["bucket"], r["number"]))
        back = pa.RecordBatch.from_pylist(dealt, pa.schema([("bucket", "int64"), ("number", "int64"), ("keys", "binary"), ("counts", "binary")]))
        sums = [r for b in add([back.slice(0, 2), back.slice(2)]) for r in b.to_pylist()]
        asked = {n: sorted(k for r in dealt if r["number"] == n for k in keys_of(r["keys"])) for n in (5, 6, 7)}
        total = {k: n for r in sums for k, n in zip(keys_of(r["keys"]), np.frombuffer(r["counts"], np.int64).tolist(), strict=True)}
        return dealt, sums, asked, total

    unpacked = lambda data: ctw.unpack(pa.scalar(data)).tolist()
    listed = lambda data: ctw.words_of(data).to_pylist()
    for name in ("ROW_KEYS", "SLICE_RUNS", "CHUNK"):
        for size in (3, 1 << 16):
            monkeypatch.setattr(ctw, name, size)
            for buckets in (1, 7, 1 << 20):
                for count, deal, add, keys_of, of in ((ctw.count_runs, ctw.deal_runs, ctw.sum_runs, unpacked, as_runs), (ctw.count_words, ctw.deal_words, ctw.sum_words, listed, as_words)):
                    dealt, sums, asked, total = through(count, deal(buckets), add, keys_of)
                    assert asked == {n: sorted(set(of(t))) for n, t in zip((5, 6, 7), texts)}
                    want = collections.Counter(of(trained))
                    assert total == {k: want[k] for t in texts for k in of(t)}
                    assert sum(r["total"] for r in sums) == sum(want.values()) and sum(r["different"] for r in sums) == len(want)
                    assert len({r["bucket"] for r in dealt}) <= buckets
                rows = [{**r, "kind": 1, "number": i} for i, r in enumerate(sums)] + [{**r, "kind": 2} for r in dealt]
                rows = [{k: r[k] for k in ("bucket", "kind", "number", "keys", "counts")} for r in sorted(rows, key=lambda r: (r["bucket"], r["kind"], r["number"]))]
                answers = [r for b in ctw.answer_words([pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", "int64"), ("kind", "int32"), ("number", "int64"), ("keys", "binary"), ("counts", "binary")]))]) for r in b.to_pylist()]
                assert sorted((r["block"], w, n) for r in answers for w, n in zip(listed(r["keys"]), np.frombuffer(r["counts"], np.int64).tolist(), strict=True)) == sorted((b, w, total[w]) for b, ws in asked.items() for w in ws)
