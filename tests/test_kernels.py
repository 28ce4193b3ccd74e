"""Matches with whitelists in memory."""

import random

import numpy as np
import pytest

from helixframe.functions import kernels

LENGTHS = (6, 5, 5)


def words(rng, n, alphabet):
    """Words of which half have few different letters in a row."""
    out = set()
    while len(out) < n:
        w = (rng.choice([2, 3, 16]) * [rng.choice("ACGT") for _ in range(rng.choice([1, 2, 3, 16]))] * 16)[:16]
        for _ in range(rng.randrange(4)):
            w[rng.randrange(16)] = rng.choice(alphabet)
        out.add("".join(w))
    return sorted(out)


def edited(rng, word, alphabet):
    w = list(word)
    for _ in range(rng.randrange(4)):
        at, how = rng.randrange(len(w)), rng.randrange(3)
        if how == 0:
            w[at] = rng.choice(alphabet)
        elif how == 1:
            del w[at]
        else:
            w.insert(at, rng.choice("ACGT"))
    return "".join([*w, *(rng.choice("ACGT") for _ in range(8))][:16])


@pytest.mark.parametrize("alphabet", ["ACGT", "ACGTN"])
def test_long_whitelists_match_as_by_all_pairs(alphabet):
    rng = random.Random(3)
    names = words(rng, 700, alphabet)
    codes = kernels.Barcodes(range(len(names)), names, LENGTHS)
    codes.MANY = 0
    turn = str.maketrans("ACGT", "TGCA")
    some = [rng.choice(names) for _ in range(300)]
    rows = [(edited(rng, n.translate(turn)[::-1] if i % 2 else n, alphabet), 3 * (i % 2)) for i, n in enumerate(some)]
    kmers, strand = kernels.letters("".join(r[0] for r in rows)).reshape(-1, 16), np.array([r[1] for r in rows])
    want = set()
    for i, (kmer, way) in enumerate(rows):
        dist = kernels.tail_free(codes.on(way), kernels.letters(kmer), 2)
        for j in np.flatnonzero(dist <= 2).tolist():
            word = bytes(codes.on(way)[j]).decode()
            if any(kmer[p] == word[p] and set(kmer[p]) <= set("ACGT") for p in codes.parts):
                want.add((i, j, int(dist[j])))
    got = list(zip(*(x.tolist() for x in codes.fuzzy(kmers, strand, 2))))
    assert len(got) == len(set(got)) > 300 and set(got) == want


def test_long_whitelists_meet_few_words():
    """Of 40,000 words some 90 share a segment with a k-mer; far fewer are looked at."""
    rng = np.random.default_rng(4)
    names = ["".join(w) for w in rng.choice(list("ACGT"), (40_000, 16))]
    codes = kernels.Barcodes(range(len(names)), names, LENGTHS)
    k, _ = codes.seeded(0, codes.words[:500], 2)
    assert len(k) < 10 * 500


def test_reads_of_one_small_file_are_many_tasks(spark):
    from helixframe.plans import annotated, fixtures

    for rows in (fixtures.frame(spark, "/root/testdata/sf0.001", "noisy"), annotated.unit_reads(spark, "/root/testdata/sf0.001")):
        assert rows.rdd.getNumPartitions() >= 4
