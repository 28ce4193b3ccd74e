"""The archive round trip, and the normaliser on foreign files."""

import gzip
import hashlib
import json
import random
import zlib
from collections import defaultdict

import pytest

from helixframe.llm import warc

PAGE = "page_id long, url string, html string, payload string, sha string"


def test_round_trip(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abc <é>") for _ in range(1500))
    rows = [(1, "http://a/", long), (2, "http://a\r\nX: y", long), (3, None, long), (4, "u", long + "x"), (5, "u", "short"), (6, "u", "short"), (7, "u", None), (8, "u", ""), (3, None, long), (None, "u", long), (9, "u", "a" * 1000), (10, "u", "a" * 1000), (11, "u", "a" * 999), (12, "u", "a" * 999), (13, "u", "WARC/1.1\r\n\r\n" * 300)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGE).repartition(3)
    got = warc.read_records(warc.archive_pages(spark, df)).collect()
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[(h or "").encode()].append(i)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        top = max((x for x in groups[p] if x is not None), default=None)
        again = len(p) >= 1000 and len(groups[p]) > 1 and i != top
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", top if again else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty(spark):
    assert warc.read_records(warc.archive_pages(spark, spark.createDataFrame([], PAGE))).count() == 0


def record(n, body):
    return f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:{n}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


@pytest.mark.parametrize("members", [False, True])
def test_normaliser(tmp_path, members):
    rng = random.Random(2)
    bodies = [b"", b"x", rng.randbytes(3_000_000), b"\r\n\r\nWARC/1.0\r\n\r\n" * 50, b"end"]
    whole = [record(i, b) for i, b in enumerate(bodies)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, whole)) if members else gzip.compress(b"".join(whole)))
    index = warc.normalise_file(f"file://{tmp_path}/a.warc.gz", f"file://{tmp_path}/out", 6)
    data = (tmp_path / "out" / "a.warc.gz").read_bytes()
    assert [zlib.decompress(data[r["offset"] : r["offset"] + r["length"]], 31) for r in index] == whole
    assert sum(r["length"] for r in index) == len(data) and gzip.decompress(data) == b"".join(whole)
    assert [json.loads(x) for x in (tmp_path / "out/index/a.jsonl").read_text().splitlines()] == index
    assert [r["record_id"] for r in index] == [f"<urn:x:{i}>" for i in range(5)]


def test_cut_off_stream(tmp_path):
    whole = gzip.compress(record(1, b"abc" * 1000))
    (tmp_path / "a.warc.gz").write_bytes(whole[: len(whole) // 2])
    with pytest.raises(EOFError):
        warc.normalise_file(f"file://{tmp_path}/a.warc.gz", f"file://{tmp_path}/out", 6)
    assert not (tmp_path / "out" / "a.warc.gz").exists()
