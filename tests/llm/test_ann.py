"""Multi-index hashing against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import ann

VEC = "vec_id long, embedding array<float>, row string, code string"


def brute(rows, k=5):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    out = {}
    for n, (q, x) in enumerate(good):
        if q is not None and q % 50 == 0:
            score = [(-float((y * x).sum() / (math.sqrt((y * y).sum()) * math.sqrt((x * x).sum()))), i) for m, (i, y) in enumerate(good) if m != n]
            out.setdefault(q, []).append(sorted(score)[:k])
    return out


@pytest.mark.parametrize("dim", [64, 16, 100])
def test_recall(spark, dim):
    rng = np.random.default_rng(dim)
    middle = rng.normal(size=(12, dim))
    rows = [(i, (middle[i % 12] + rng.normal(size=dim)).tolist()) for i in range(600)]
    got = ann.nearest(spark.createDataFrame([(*r, "x", "y") for r in rows], VEC).repartition(3), F.col("vec_id") % 50 == 0).collect()
    want = brute(rows)
    assert len(got) == 5 * len(want)
    hit = 0
    for q, ((best,),) in ((q, (w,)) for q, w in want.items()):
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hit += len({r.vec_id for r in mine} & {i for _, i in best})
    assert hit >= 0.9 * len(got)


def test_odd_vectors(spark):
    base = [1.0, 2.0, 3.0, 4.0]
    rows = [(0, base), (1, base), (2, [2.0, 4.0, 6.0, 8.0]), (3, [-1.0, 0.0, 0.0, 1.0]), (50, base), (50, base), (7, None), (8, [0.0] * 4), (9, [1.0, None, 2.0, 3.0]), (10, [1.0, float("nan"), 2.0, 3.0]), (11, [float("inf")] * 4), (12, []), (13, [1.0, 2.0]), (100, None)]
    got = ann.nearest(spark.createDataFrame([(*r, None, None) for r in rows], VEC), F.col("vec_id") % 50 == 0).collect()
    mine = [(r["rank"], r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0]
    assert mine[0] == (1, 1) and {i for _, i in mine} == {1, 2, 50, 3} and len(mine) == 5
    assert len(got) == 15 and {r.query_id for r in got} == {0, 50}


def test_few_and_none(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0], None, None), (1, [2.0, 1.0], None, None)], VEC)
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(one, F.col("vec_id") % 50 == 0).collect()] == [(0, 1, 1)]
    assert ann.nearest(one.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ann.nearest(one.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_probing_finds_every_code_within():
    """The same by tables of substrings, by checking all codes, and by a plain count."""
    rng = np.random.default_rng(1)
    code = rng.integers(0, 2**63, size=(300, ann.WORDS), dtype=np.int64).astype(np.uint64)
    code = np.concatenate([code, code[:100]])
    for row in code[300:]:
        for bit in rng.integers(0, ann.BITS, size=rng.integers(0, 80)):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    index = ann.Index(code)
    far = np.array([[sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(a, b)) for b in code] for a in code[:6]])
    assert (ann.distances(code[:6], code) == far).all()
    for radius in (0, 1, 31, 32, 63, 70, 100, 512):
        for i in range(6):
            want = np.flatnonzero(far[i] <= radius).tolist()
            assert index.probed(code[i], radius).tolist() == want == index.checked(code[i][None, :], radius, 0)[0].tolist()
    few = [set(r.tolist()) for r in ann.Index(code).within(code[:6], 0, 7)]
    assert all(r >= set(np.argsort(far[i], kind="stable")[:2].tolist()) and len(r) >= 7 and max(far[i][list(r)]) == np.sort(far[i])[6] for i, r in enumerate(few))


def test_structureless_vectors():
    """Random directions: recall against brute force, and the share of codes behind which vectors are ranked."""
    rng = np.random.default_rng(5)
    x = ann.unit(rng.normal(size=(8000, 64)))
    mean, turn = ann.learn_rotation(x)
    code = ann.codes(x, mean, turn)
    radius = ann.radius_needed(x, code)
    asked = np.arange(4000, 8000, 40)
    found = list(ann.Index(code).within(code[asked], radius, 6))
    near = np.argsort(-(x[asked] @ x.T), axis=1)[:, 1:6]
    recall = np.mean([len(set(n) & set(f.tolist())) / 5 for n, f in zip(near, found)])
    share = np.mean([len(f) for f in found]) / len(x)
    assert recall >= 0.95 and share < 0.1, (recall, share)


def test_recall_of_structureless_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(1500)]
    got = ann.nearest(spark.createDataFrame([(*r, None, None) for r in rows], VEC).repartition(3), F.col("vec_id") % 50 == 0).collect()
    want = brute(rows)
    hit = sum(len({r.vec_id for r in got if r.query_id == q} & {i for _, i in best}) for q, (best,) in want.items())
    assert len(got) == 150 and hit >= 0.9 * 150


def test_tiny_and_huge_components(spark):
    """Scores are the cosines whatever the magnitude, and order by them."""
    base = np.array([3.0, 1.0, -2.0, 0.5])
    near, far = base + [0.1, 0.0, 0.0, 0.0], base + [0.0, 3.0, 0.0, 0.0]
    rows = [(0, (base * 1e-200).tolist()), (1, (far * 1e200).tolist()), (2, (near * 1e-300).tolist()), (3, (base * 1e150).tolist()), (4, (-base * 1e-5).tolist())]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    cosine = lambda a, b: float((a * b).sum() / math.sqrt((a * a).sum() * (b * b).sum()))
    assert [r.vec_id for r in got] == [3, 2, 1, 4]
    assert [r.score for r in got] == pytest.approx([1.0, cosine(base, near), cosine(base, far), -1.0], abs=1e-12)
