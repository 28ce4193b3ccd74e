"""Operators on hand-made cases, and those whose rule SQL doesn't express against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.functions import codec as C
from helixframe.functions import distance as D
from helixframe.functions import interval as I
from helixframe.functions import kernels
from helixframe.functions import sequence as S
from helixframe.operators import adapters, annotate, barcode, calls, chimera, clones, regions
from helixframe.operators.chemistry import R1, TSO, Chemistry, reverse_complement


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        prev, row[0] = row[:], i + 1
        for j, y in enumerate(b):
            row[j + 1] = min(prev[j + 1] + 1, row[j] + 1, prev[j] + (x != y))
    return row[-1]


def test_segments(spark):
    assert [S.segment_lengths(*x) for x in [(16, 2), (16, 3), (22, 3), (13, 2)]] == [[8, 8], [6, 5, 5], [8, 7, 7], [7, 6]]
    assert [x.segment for x in value(spark, S.segments(F.lit("ABCDEFGHIJKLM"), [7, 6]))] == ["ABCDEFG", "HIJKLM"]
    with pytest.raises(Exception, match="sum"):
        value(spark, S.segments(F.lit("ABC"), [7, 6]))


def test_sequences(spark):
    assert value(spark, S.reverse_complement(F.lit(R1))) == reverse_complement(R1) == "AGATCGGAAGAGCGTCGTGTAG"
    assert value(spark, S.kmers(F.lit("ACG"), 5)) == []
    assert [value(spark, S.kmer_code(F.lit(x))) for x in ("AAAAAA", "AAAAAC", "ACGTAC", "TTTTTT", "ACG", "ACGTAN")] == [0, 1, 433, 4095, -1, -2]
    assert [value(spark, S.poly_tail(F.lit(x))) for x in ("CA" + "A" * 9 + "G", "T" * 10, "A" * 10 + "T" * 10, "ACGT", "A" * 9)] == [0, 3, -1, -1, -1]


@pytest.mark.parametrize(("a", "b", "k", "want"), [("ACGTACGT", "ACGTACGA", 1, 1), ("ACGTACGT", "ACGACGTT", 1, 1), ("ACGTACGT", "ACGTTACG", 1, 1), ("AAACCTGAGCTTATCG", "AAACTGAGCTTATCGA", 1, 1), ("ACG", "ACGT", 3, 0), ("ACGTACGT", "ACGTACGT", 1, 0)])
def test_semiglobal(spark, a, b, k, want):
    assert value(spark, D.semiglobal_distance(F.lit(a), F.lit(b), k, len(a), len(b))) == want


def test_longest_common(spark):
    def plain(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = max(t[i][j + 1], t[i + 1][j], t[i][j] + (x == y))
        return t[-1][-1]

    rng = random.Random(1)
    rows = [("".join(rng.choice("ACGT") for _ in range(rng.randint(1, 12))), "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 12)))) for _ in range(40)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", D.longest_common(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == plain(r.a, r.b) for r in got)


def test_planted_read(spark):
    bc = "AAACCTGAGCTTATCG"
    read = "GG" + R1 + bc + "ACGTACGTAC" + TSO + "CATCATCATCAT" + "A" * 14
    assert tuple(value(spark, D.best_place(R1, F.lit(read), 3))) == (3, 0) and tuple(value(spark, D.best_place(TSO, F.lit(read), 2))) == (51, 0)
    assert value(spark, D.best_place(R1, F.lit("A" * 50), 3)).pos is None
    umi, rest = S.umi_and_insert(F.lit(read), F.lit(25), F.lit(0), F.lit(16))
    assert value(spark, umi) == "ACGTACGTAC" and value(spark, rest).startswith("CATCAT")
    back = reverse_complement(read)
    umi, rest = S.umi_and_insert(F.lit(back), F.lit(50), F.lit(3), F.lit(16))
    assert value(spark, umi) == "ACGTACGTAC" and value(spark, rest).startswith("CATCAT")


def end_free(a, b, k):
    """By the whole table of the recursion."""
    n, m = len(a), len(b)
    if k >= n or k >= m:
        return 0
    t = [[i + j if 0 in (i, j) else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            t[i][j] = min(t[i - 1][j] + 1, t[i][j - 1] + 1, t[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return min([t[i][m] for i in range(n - k, n + 1)] + [t[n][j] for j in range(m - k, m + 1)])


def changed(rng, word):
    """With up to three letters replaced, left out or put in, of the same length."""
    s = list(word)
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(s))
        s[at : at + 1] = rng.choice([[rng.choice("ACGT")], [], [s[at], rng.choice("ACGT")]])
    return ("".join(s) + "ACGTACGT")[: len(word)]


@pytest.mark.parametrize("k", [0, 1, 2, 4, 7])
def test_tail_free_distances(k):
    rng = random.Random(k)
    words = [changed(rng, R1) for _ in range(150)] + ["".join(rng.choice("ACGTN") for _ in R1) for _ in range(50)]
    rows = np.array([kernels.letters(w) for w in words])
    want = [min(end_free(w, R1, k), k + 1) for w in words]
    assert kernels.tail_free(rows, kernels.letters(R1), k).tolist() == want
    assert kernels.tail_free(rows, np.tile(kernels.letters(R1), (len(words), 1)), k).tolist() == want
    assert kernels.tail_free(rows[:3], kernels.letters("ACG"), 3).tolist() == [0, 0, 0]


def planted(rng, word, n=6):
    out = []
    for _ in range(n):
        s = "".join(rng.choice("ACGT") for _ in range(rng.choice([0, 5, 21, 22, 90, 200])))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(s) + 1)
            s = s[:at] + changed(rng, rng.choice([word, reverse_complement(word)])) + s[at:]
        out.append(s)
    return [*out, "", None, "ACGT"]


def test_best_place(spark):
    rng = random.Random(21)
    seqs = planted(rng, R1, 40)
    for first_exact in (False, True):
        got = spark.createDataFrame([(s,) for s in seqs], "s string").select(D.best_place(R1, F.col("s"), 4, first_exact).alias("b")).select("b.*").collect()
        for s, r in zip(seqs, got):
            best = (None, None)
            for p in range(1, len(s or "") - len(R1) + 2):
                d = end_free(s[p - 1 : p + 21], R1, 4)
                if d <= 4 and (best[0] is None or d <= best[1]) and not (first_exact and best[1] == 0):
                    best = (p, d)
            assert tuple(r) == best


def plain_scan(s, regions, word, k):
    hits, back = [], reverse_complement(word)
    for start, end in regions:
        closest = len(word)
        for p in range(start, end - len(word) + 2):
            w = s[p - 1 : p - 1 + len(word)]
            a, b = end_free(w, word, k), end_free(w, back, k)
            d, strand = (b, 3) if b < a else (a, 0)
            if d > closest or d > k:
                continue
            closest = d
            if hits and p - hits[-1][0] < len(word):
                hits.pop()
            hits.append((p, strand, d))
    return hits


def test_adapter_scan(spark):
    rng = random.Random(3)
    rows = []
    for s in planted(rng, R1, 30):
        n = len(s or "")
        cuts = sorted(rng.sample(range(1, n), 2)) if n > 30 else []
        rows.append((s, [(1, cuts[0]), (cuts[0] + 1, cuts[1]), (cuts[1] + 1, n)] if cuts else []))
    df = spark.createDataFrame(rows, "s string, r array<struct<start:int,end:int>>")
    got = df.select(adapters.scan(F.col("s"), R1, 4).alias("whole"), adapters.scan(F.col("s"), R1, 4, F.col("r")).alias("parts")).collect()
    for (s, r), g in zip(rows, got):
        assert [tuple(x) for x in g.whole] == plain_scan(s or "", [(1, len(s or ""))], R1, 4)
        assert [tuple(x) for x in g.parts] == plain_scan(s or "", r, R1, 4)


def test_census(spark):
    rng = random.Random(5)
    seqs = planted(rng, TSO, 25)
    got = spark.createDataFrame([(s,) for s in seqs], "s string").select(adapters.jump_scan(F.col("s"), TSO, 1).alias("h")).collect()
    back = reverse_complement(TSO)
    for s, g in zip(seqs, got):
        want, p = [], 1
        while p <= len(s or "") - len(TSO) + 1:
            w = s[p - 1 : p - 1 + len(TSO)]
            way = 1 if end_free(w, TSO, 1) <= 1 else -1 if end_free(w, back, 1) <= 1 else 0
            want += [(p, way)] if way else []
            p += len(TSO) if way else 1
        assert [tuple(x) for x in g.h] == want


def test_match_in_memory_equals_joins(spark):
    """Both ways, and brute force over all k-mers and barcodes."""
    rng = random.Random(31)
    names = ["".join(rng.choice("ACGT") for _ in range(16)) for _ in range(40)] + ["ACGTACGTACGTACGT"] * 2
    white = spark.createDataFrame([(i + 1, b) for i, b in enumerate(names)], "ordinal long, barcode string")
    rows = []
    for i in range(60):
        b = changed(rng, names[i % 42]) if i % 3 else names[i % 42]
        w = "".join(rng.choice("ACGT") for _ in range(rng.randrange(8))) + (b if i % 2 else reverse_complement(b)) + "".join(rng.choice("ACGT") for _ in range(rng.randrange(6)))
        rows.append((i, w, 5 + i, 0 if i % 2 else 3))
    rows += [(90, None, None, None), (91, "ACG", 1, 0), (92, "N" * 20, 1, 3)]
    df = spark.createDataFrame(rows, "id int, window string, pos int, strand int")
    for exact_first in (True, False):
        got = {r.id: [tuple(x) for x in r.found] for r in barcode.match(df, white, exact_first=exact_first).collect()}
        joined = {r.id: [tuple(x) for x in r.found] for r in barcode.matched_by_join(df, white, 16, 2, exact_first).collect()}
        want = {}
        for i, w, first, strand in rows:
            every = []
            for at in range(len(w or "") - 15):
                k = w[at : at + 16]
                for o, n in enumerate(names):
                    word = n if strand == 0 else reverse_complement(n)
                    if any(k[s : s + m] == word[s : s + m] for s, m in ((0, 6), (6, 5), (11, 5))) and (d := end_free(k, word, 2)) <= 2:
                        every.append((d, first + at, o + 1, n))
            if exact_first and any(x[0] == 0 for x in every if x[3] in (w[x[1] - first : x[1] - first + 16], reverse_complement(w[x[1] - first : x[1] - first + 16]))):
                every = [x for x in every if w[x[1] - first : x[1] - first + 16] == (x[3] if strand == 0 else reverse_complement(x[3]))]
            best = {}
            for x in sorted(every):
                best.setdefault(x[3], x)
            want[i] = sorted(best.values())
        assert got == want and joined == want


def test_complex_class(spark):
    def of(*a):
        return value(spark, adapters.complex_class(F.array(*(F.struct(F.lit(p).alias("pos"), F.lit(s).alias("strand")) for p, s in a))))

    assert [of((10, 0), (100, 0)), of((10, 0), (40, 0)), of((10, 0), (200, 3)), of((10, 0), (60, 3)), of((10, 3), (60, 0)), of((10, 3), (200, 0))] == ["Chimera", "R1a_duplication", "Dual_header", "Others", "Anti_dual_header", "Others"]
    assert of((1, 0), (2, 0), (3, 0)) == "Chimera" and of((1, 0), (2, 3), (3, 0)) == "Others" and of((1, 0)) is None


def test_fuzzy_equals_brute_force(spark):
    rng = random.Random(9)
    names = ["".join(rng.choice("ACGT") for _ in range(16)) for _ in range(25)]
    white = spark.createDataFrame(list(enumerate(names)), "ordinal long, barcode string")
    kmers = []
    for i in range(60):
        b = names[i % 25]
        if i % 2:
            b = reverse_complement(b)
        b = list(b)
        for _ in range(i % 4):
            b[rng.randrange(16)] = rng.choice("ACGT")
        kmers.append((i, 1, "".join(b)))
    got = barcode.fuzzy_matches(spark.createDataFrame(kmers, "id long, pos int, kmer string"), white).collect()
    want = {}
    for i, _, k in kmers:
        for o, n in enumerate(names):
            for strand, w in ((0, n), (3, reverse_complement(n))):
                if any(k[s : s + m] == w[s : s + m] for s, m in ((0, 6), (6, 5), (11, 5))):
                    d = min([lev(k[: 16 - t], w) for t in range(3)] + [lev(k, w[: 16 - t]) for t in range(3)])
                    if d <= 2:
                        want[i, strand, o] = d
    assert {(r.id, r.strand, r.ordinal): r.edits for r in got} == want and len(got) == len(want)


def test_scores_and_codecs(spark):
    assert [value(spark, barcode.barcode_score(F.lit(x))) for x in (0, 1, 2, 3, 4, 5, -1)] == [0, 20, 28, 44, 75, 999999, 999999]
    assert [(value(spark, C.clip(F.lit(x), "left")), value(spark, C.clip(F.lit(x), "right"))) for x in ("10S50M5S", "50M", "50M5H", "3S20M")] == [(10, 5), (-1, -1), (-1, 5), (3, -1)]
    assert [tuple(s) for s in value(spark, C.cigar_segments(F.lit("50M100N50M"), F.lit(101)))] == [(101, 150), (251, 300)]
    assert value(spark, C.tokens(F.lit("a||b|"), "|")) == ["a", "b"] and value(spark, C.joined(F.array().cast("array<int>"), ",")) == "*"
    assert value(spark, C.regions(F.lit("*"))) == [] and [tuple(r) for r in value(spark, C.regions(F.lit("1-5,9-12")))] == [(1, 5), (9, 12)]


def test_intervals(spark):
    cov = lambda *x: round(value(spark, I.coverage(*map(F.lit, x))), 6)
    assert [cov(1, 10, 6, 20), cov(6, 20, 1, 10), cov(6, 10, 1, 20), cov(1, 20, 6, 10), cov(1, 5, 6, 9)] == [0.5, 0.333333, 1.0, 0.25, 0.0]
    over = lambda t, p: value(spark, I.overhang(*map(F.lit, (6, 20, 1, 10)), F.lit(p), t))
    assert [over(5, True), over(5, False), over(3, True), over(3, False)] == [5, 10, 10, 5]
    rows = spark.createDataFrame([(1, 11, 60), (1, 50, 80), (2, 11, 60), (2, 70, 90), (3, 1, 100)], "id int, start int, end int")
    merged = regions.merge(rows)
    assert sorted((r.id, r.start, r.end, r.members) for r in merged.collect()) == [(1, 11, 80, 2), (2, 11, 60, 1), (2, 70, 90, 1), (3, 1, 100, 1)]
    assert sorted(map(tuple, regions.free(merged, F.lit(100)).collect())) == [(1, 1, 10), (1, 81, 100), (2, 1, 10), (2, 61, 69), (2, 91, 100)]


def test_annotation(spark):
    score = lambda t, s, n=2: value(spark, annotate.annotation_score(F.lit(t), F.lit(s), F.lit(n)))
    assert [score("G(fsm/ism=>1>2>3>)", 499), score("G(novel=>1>-1>3>)", 499), score("unspliced", 499), score("unspliced", 499, 1)] == [0, 50, 499, 0]
    hit = lambda s, e, g, x: F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(g).alias("gene"), F.lit(x).alias("score"))
    choose = lambda *h: value(spark, annotate.choose(F.array(*h)))
    assert choose(hit(1, 50, "A", 1)) == "A" and choose(hit(1, 50, "A", 1), hit(60, 90, "B", 1)) == "Fusion: A::B"
    assert choose(hit(1, 50, "A", 1), hit(10, 60, "B", 2)) == "A" and choose(hit(1, 50, "A", 1), hit(10, 60, "B", 1)) == "Ambiguous_mapping"


def test_triage(spark):
    rows = [
        ("one", 1, 0, "t1", "50M", None, None),
        ("theirs", 1, 0, "t1", "10S50M5S", None, None),
        ("theirs", 2, 2048, "t2", "30S10M20S", "t1", "10S50M5S"),
        ("ours", 1, 0, "t1", "30S10M20S", None, None),
        ("ours", 2, 2048, "t2", "10S50M5S", "t1", "30S10M20S"),
        ("both", 1, 0, "t1", "50M30S", None, None),
        ("both", 2, 2048, "t2", "50S30M", "t1", "50M30S"),
        ("both", 3, 2048, "t1", "50M30S", "t1", "50M30S"),
        ("secondary", 1, 0, "t9", "50M", None, None),
        ("secondary", 2, 256, "t2", "50M", None, None),
        ("none", 1, 4, "*", "*", None, None),
    ]
    records = spark.createDataFrame(rows, "read string, ord int, flag int, ref string, cigar string, sa_ref string, sa_cigar string")
    names = spark.createDataFrame([("t1", "A"), ("t2", "B")], "id string, name string")
    got = {r.read: (r.gene, r.chimeric) for r in chimera.triage(records, names).collect()}
    assert got == {"one": ("A", False), "theirs": ("A", False), "ours": ("B", False), "both": (None, True), "secondary": ("t9", False)}


def test_tail_cut_of_three_prime(spark):
    seq = "C" + "G" * 150 + "T" * 10 + "C" * 100
    assert tuple(value(spark, chimera.tail_cut(F.lit(seq), F.lit(True), 3))) == (151 - 70, "split")
    assert value(spark, chimera.tail_cut(F.lit("ACGT"), F.lit(True), 3)).verdict == "read_too_short"
    assert value(spark, chimera.tail_cut(F.lit("C" * 300), F.lit(False), 3)).verdict == "fusion_gene_like"


def test_matrix(spark):
    rows = spark.createDataFrame([("a", "1_X,2_X,3_Y"), ("b", "4_Y,")], "clone string, reads string")
    wide = clones.clone_matrix(clones.clone_reads(rows), ["a", "b"], spark.createDataFrame([("X",), ("Y",), ("Z",)], "barcode string"))
    assert {tuple(r) for r in wide.collect()} == {("X", 2, 0), ("Y", 1, 1), ("Z", 0, 0)}


def test_call(spark):
    rng = random.Random(8)
    names = ["".join(rng.choice("ACGT") for _ in range(16)) for _ in range(12)]
    white = spark.createDataFrame(list(enumerate(names)), "ordinal long, barcode string")
    rows, want = [], {}
    for i, b in enumerate(names):
        used = b if i % 3 else b[:8] + ("A" if b[8] != "A" else "C") + b[9:]
        seq = "GG" + R1 + used + "ACGTACGTAC" + TSO + "".join(rng.choice("CGT") for _ in range(150)) + "A" * (12 if i % 2 else 0)
        rows.append((i, reverse_complement(seq) if i % 4 == 3 else seq))
        want[i] = ("fine", b, 0 if i % 3 else 1, 0 if i % 3 else 20)
    rows += [(50, "ACGT" * 60), (51, "ACGT"), (52, "GG" + R1 + "ACGT" * 40 + reverse_complement(R1) + "CC")]
    got = {r.id: r for r in calls.call(spark.createDataFrame(rows, "id long, seq string"), white).collect()}
    assert {i: (got[i].status, got[i].barcode, got[i].barcode_mismatch, got[i].barcode_score) for i in want} == want
    assert (got[50].status, got[51].status, got[52].status) == ("ICS_R1_missing", "Read_too_short", "Dual_header")


def test_call_of_three_prime(spark):
    """UMIs of 12, poly-T as inner adapter; a barcode found by the inner adapter alone."""
    rng = random.Random(18)
    names = ["".join(rng.choice("ACGT") for _ in range(16)) for _ in range(5)]
    white = spark.createDataFrame(list(enumerate(names)), "ordinal long, barcode string")
    body = "".join(rng.choice("ACG") for _ in range(220))
    rows = [(0, "GG" + R1 + names[0] + "ACGACGACGACG" + "T" * 13 + body), (1, "G" * 12 + names[1] + "ACGACGACGACG" + "T" * 13 + body)]
    rows += [(i + 2, reverse_complement(s)) for i, s in rows]
    got = {r.id: r for r in calls.call(spark.createDataFrame(rows, "id long, seq string"), white, Chemistry(tech=3)).collect()}
    assert {i: (r.status, r.barcode, r.barcode_strand) for i, r in got.items()} == {0: ("fine", names[0], "forward"), 1: ("fine", names[1], "forward"), 2: ("fine", names[0], "reverse"), 3: ("fine", names[1], "reverse")}
    assert Chemistry(tech=3).tso_edits == 6 and len(Chemistry(tech=3).tso) == 30


def test_warping_in_calls(spark):
    rng = random.Random(19)
    names = ["".join(rng.choice("ACGT") for _ in range(16)) for _ in range(6)]
    white = spark.createDataFrame(list(enumerate(names)), "ordinal long, barcode string")
    far = "".join(b if j % 5 else {"A": "C", "C": "G", "G": "T", "T": "A"}[b] for j, b in enumerate(names[2]))  # four bases replaced
    reads = spark.createDataFrame([(0, "GG" + R1 + far + "ACGTACGTAC" + TSO + "CTGCATGC" * 25), (1, "ACGT" * 60)], "id long, seq string")
    from helixframe.operators import dtw

    got = {r.id: r for r in calls.call(reads, white, model=dtw.demo_model()).collect()}
    assert got[1].status == "ICS_R1_missing" and got[0].status in ("fine_DTW", "Barcode_missing")
    assert got[0].status != "fine_DTW" or (got[0].barcode_start is None and got[0].barcode_score == got[0].barcode_mismatch)


def hit_of(start, end, gene, score, orient=0, tag="unspliced", strand=0):
    return (start, end, orient, 1000 + start, 1000 + end, strand, gene, None, tag, score)


@pytest.mark.parametrize(
    ("hits", "occupied", "pos", "want"),
    [
        ([], [(1, 9)], 5, ("Odds_x", None, [])),
        ([hit_of(50, 90, "A", 7)], [(50, 90)], 10, ("A", 0, [])),
        ([hit_of(50, 90, "A", 7, orient=3)], [(50, 90)], 10, ("Non-transcriptome", 999999, [])),
        ([hit_of(50, 90, "A", 7)], [(40, 45), (50, 90)], 10, ("Odds0", None, [])),
        ([hit_of(50, 90, "A", 7), hit_of(120, 150, "B", 9)], [(50, 90), (120, 150)], 100, ("B", 9, [])),
        ([hit_of(50, 90, "A", 7), hit_of(55, 95, "B", 9)], [(50, 95)], 10, ("A", 7, [])),
        ([hit_of(50, 90, "A", 7), hit_of(55, 95, "B", 7)], [(50, 95)], 10, ("Ambiguous_mapping", 999999, [])),
        ([hit_of(50, 60, "A", 7), hit_of(61, 70, "B", 7, strand=3), hit_of(71, 95, "C", 7)], [(50, 95)], 10, ("Fusion: A::B::C", None, [1060, 1070, 1061, 1071])),
    ],
)
def test_read_annotation(spark, hits, occupied, pos, want):
    row = spark.createDataFrame([(hits, occupied)], f"hits {calls.HITS}, occupied {calls.REGIONS}")
    got = row.select(annotate.read_annotation(F.col("hits"), F.col("occupied"), F.lit(pos), F.lit(0)).alias("a")).first().a
    assert (got.annotation, got.score, got.breakpoints) == want


def test_more_functions(spark):
    assert value(spark, I.same_exons(F.array(*map(F.lit, (1, 2))), F.array(*map(F.lit, (2, 1))))) and not value(spark, I.contains_exons(F.array(*map(F.lit, (1, 2))), F.array(*map(F.lit, (2, 2)))))
    feature = lambda s, e, n: F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(n).alias("id"))
    assert value(spark, annotate.choose_feature(F.lit(10), F.lit(30), F.array(feature(1, 30, "a"), feature(12, 30, "b"), feature(5, 30, "c")))) == "b"
    assert S.word_sizes(16, 2) == [6, 5, 5]
    cut = value(spark, S.trimmed(F.lit("AACCGGTTACGT"), F.lit("abcdefghijkl"), F.lit(1), F.lit(0), F.lit(1), 5))
    assert (cut.umi, cut.seq, cut.qual) == ("ACCGGTTACG", "T", "l")
    cut = value(spark, S.trimmed(F.lit("A" * 20 + "C"), F.lit("abcdefghijklmnopqrstu"), F.lit(18), F.lit(3), F.lit(3), 3))
    assert (cut.umi, cut.seq, cut.qual) == ("T" * 12, "AAAAA", "abcde")
    nearest = value(spark, regions.nearest_region(F.lit(50), F.lit(True), F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in ((10, 20), (60, 70)))), behind=True))
    assert nearest.start == 10
    rows = spark.createDataFrame([("a", 90.0, 91.0, "Yes"), ("b", 90.0, 91.0, "No"), ("c", None, 91.0, "Yes"), ("d", 80.0, 91.0, "Yes")], "id string, v_identity double, j_identity double, productive string")
    assert [r.id for r in clones.passing(rows, 85, productive=True).collect()] == ["a"] and clones.passing(rows, 85).count() == 2


def test_split_reports(spark):
    rows = spark.createDataFrame([("x", "ACGTAC", "123456", 3, 2, "split"), ("y", "GG", "12", 1, None, "read_too_short")], "id string, seq string, qual string, barcode_start int, cut int, verdict string")
    assert sorted(map(tuple, chimera.split_report(rows).collect())) == [("x", "x-1,-2", 3, 2, "splited"), ("y", "y", 1, -1, "read_too_short")]
    assert sorted(map(tuple, chimera.raw_parts(rows, F.lit(False)).collect())) == [("x-1", "GTAC", "3456"), ("x-2", "AC", "12"), ("y", "GG", "12")]
