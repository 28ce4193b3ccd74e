"""Importance resampling, quality rules, near duplicates and the pipeline against plain Python."""

import collections
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from helixframe.llm import components, importance, packing, quality_rules, simhash
from helixframe.llm.common import materialise

DOC = "doc_id long, text string, lang string, source string, kept_row string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = "the an on er ti in re ed st ly ha ou nd sh".split()


def text(rng, n, junk=False, deep=3):
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, deep))) for _ in range(n)]
    if junk:
        words = [w + rng.choice(["%%%", "###", "&&&"]) for w in words]
    return " ".join(w + ("." if i % 8 == 7 else "") for i, w in enumerate(words))


def corpus(n=240, seed=1, deep=3):
    rng = random.Random(seed)
    rows = [(i, text(rng, rng.randint(60, 150), i % 6 == 0, deep), "en" if i % 5 else None, f"s{i // 6 % 2}", "mine") for i in range(n)]
    return rows + [(n, None, "en", "s0", None), (n + 1, "", None, None, None), (None, text(rng, 80), "en", "s0", "x"), rows[5], rows[5]]


def test_importance(spark):
    rows = corpus(deep=1)
    labels = [(i, int(i % 6 != 0), 0) for i in range(240) if i % 4 < 2] + [(None, 1, 0), (4, None, None)]
    df, lab = spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = importance.classify(df.repartition(3), lab).collect()
    assert len(got) == len(rows)
    clean = [r for r in got if r.doc_id is not None and r.doc_id < 240 and r.doc_id % 6]
    assert sum(r.kept for r in clean) >= 0.95 * len(clean)
    ratio, share = importance.fit(df, lab)
    found, n = importance.features([(r[1] or "").encode() for r in rows])
    weights = [round(100 * float(ratio[f].mean()), 6) if len(f) else 0.0 for f in np.split(found, np.cumsum(n)[:-1])]
    assert sorted(r.log_weight for r in got) == pytest.approx(sorted(weights), abs=1e-5)
    k = max(1, round(share * len(rows)))
    least = sorted((r.key for r in got), reverse=True)[k - 1]
    assert all(r.kept == (r.key >= least) for r in got)
    out = importance.filter_documents(df, lab)
    assert out.columns == df.columns and collections.Counter(r.doc_id for r in out.collect()) == collections.Counter(r.doc_id for r in got if r.kept)
    assert importance.filter_documents(df, lab.limit(0)).count() == len(rows)
    assert importance.classify(df.limit(0), lab).count() == 0


def test_kth_largest(spark):
    rng = random.Random(2)
    values = [round(rng.uniform(-50, 50), 6) for _ in range(300)] + [1.5] * 20
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 7, 150, 320):
        assert importance.kth_largest(df, "v", k) == pytest.approx(sorted(values, reverse=True)[k - 1], abs=1e-9)


def stats(t):
    words = WORD.findall(t)
    triples = collections.Counter(zip(words, words[1:], words[2:]))
    inside = [False] * len(words)
    for i in range(len(words) - 2):
        if triples[words[i], words[i + 1], words[i + 2]] > 1:
            inside[i] = inside[i + 1] = inside[i + 2] = True
    seen, again = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), again, sum(inside)


def test_text_stats():
    rng = random.Random(5)
    cases = ["", "a b c a b c", "x\nx\n \n \nx\x85y", "é漢 # <|> é漢 # <|>", "a a a a", "a\x0bb\x0cc\rd"] + ["".join(rng.choice("ab \n#é\x1c\xa0") for _ in range(60)) for _ in range(400)]
    for t in cases:
        assert quality_rules.text_stats(t.encode())[:5] == stats(t)


def test_mcd_ignores_outliers():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(300, 6)) * 0.2 + 1, rng.normal(size=(60, 6)) * 0.1 + 9])
    _, mean, _ = quality_rules.mcd(x)
    assert np.abs(mean - 1).max() < 0.1
    assert quality_rules.chi2_cdf(quality_rules.chi2_beyond(0.025, 6), 6) == pytest.approx(0.975)


def test_quality_rules(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, DOC)
    got = quality_rules.rate(df.repartition(3)).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        want = stats(texts[r.doc_id])
        assert tuple(r.s)[:5] == want and r.failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        junk = r.doc_id is not None and r.doc_id < 240 and r.doc_id % 6 == 0
        assert r.kept == (not r.failed and not junk)
    out = quality_rules.filter_documents(df)
    assert out.columns == df.columns and collections.Counter(map(str, (r.doc_id for r in out.collect()))) == collections.Counter(str(r.doc_id) for r in got if r.kept)
    few = quality_rules.rate(df.limit(5)).collect()
    assert len(few) == 5 and all(r.kept != r.failed for r in few)
    assert quality_rules.rate(df.limit(0)).count() == 0 and quality_rules.filter_documents(df.limit(0)).count() == 0


def plain_print(t, width):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = WORD.findall(t)
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def plain_groups(prints):
    n, up = len(prints), list(range(len(prints)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2:
                up[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(n)]


def near_copies(seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(12):
        words = text(rng, 400).split()
        for _ in range(6):
            copy = list(words)
            copy[rng.randrange(400)] = "changed"
            rows.append((len(rows), " ".join(copy), "en", "s", "k"))
    return rows + [(900, None, None, None, None), (901, " \n", "en", "s", "k"), (902, "two words", "en", "s", "k"), (3, rows[3][1], "en", "s", "k"), (None, rows[10][1], "en", "s", "k")]


def test_fingerprints():
    for t in ["", "one", "One two", "a b c", "É b\x85c d", " ".join(map(str, range(300)))]:
        for width in (3, 5):
            assert simhash.fingerprint(t.encode(), width) == plain_print(t, width)


@pytest.mark.parametrize("segments, hot", [(1, 512), (2, 512), (2, 3), (2, 0), (4, 512), (4, 5)])
def test_links_of_all_segment_counts(spark, segments, hot):
    """The same pairs as by comparing all, whether table entries are split or not."""
    rng = random.Random(17)
    prints = {0, (1 << 64) - 1, *(rng.getrandbits(64) for _ in range(40))}
    for base in [*prints][:8]:
        for _ in range(25):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 2, 3, 5]))))
    wide = [x - (1 << 64) if x >> 63 else x for x in prints]
    got = simhash.links(spark.createDataFrame([(x,) for x in wide], "fp long").repartition(3), segments, hot).collect()
    want = {(max(a, b), min(a, b)) for i, a in enumerate(wide) for b in wide[:i] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}
    assert len(got) == len(want) > 100 and {(r.src, r.dst) for r in got} == want


def test_near_duplicates(spark):
    rows = near_copies()
    df = spark.createDataFrame(rows, DOC)
    prints = [plain_print(r[1], 3) for r in rows]
    tops = plain_groups(prints)
    smallest = {}
    for r, t in zip(rows, tops):
        if r[0] is not None:
            smallest[t] = min(smallest.get(t, r[0]), r[0])
    got = simhash.near_duplicates(df.repartition(3)).collect()
    want = sorted(((r[0], p, smallest[t]) for r, p, t in zip(rows, prints, tops)), key=str)
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=str) == want
    assert len(set(tops)) < len(set(prints)) < len(rows)  # there are links, and copies
    kept = simhash.keep_one(df, width=3)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(smallest.values())
    assert simhash.keep_one(df.limit(0)).count() == 0 and simhash.near_duplicates(df.limit(0)).count() == 0


def test_nothing_that_grows_is_broadcast(spark):
    """The files of a million fingerprints are small, but the hash table that a broadcast makes of them fills a driver of 1 GB."""
    prints = materialise(spark.range(3000).select(F.xxhash64("id").alias("fp")), "prints")
    edges = materialise(spark.range(1, 3000).selectExpr("id as src", "id - 1 as dst"), "edges")
    docs = spark.createDataFrame(near_copies(), DOC)
    for df in (simhash.links(prints), simhash.groups(prints), components.star(edges, large=True), simhash.near_duplicates(docs), simhash.keep_one(docs)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_similar(spark):
    rng = random.Random(11)
    rows, parent = [], []
    for i in range(25):
        words = text(rng, 150).split()
        for j in range(3):
            copy = list(words)
            for _ in range(j):
                copy[rng.randrange(150)] = "changed"
            rows.append((len(rows), " ".join(copy), "en", "s", "k"))
            parent.append(i)
    rows += [(900, None, None, None, None), (901, " ", "en", "s", "k"), (902, "two words", "en", "s", "k"), (None, rows[10][1], "en", "s", "k"), (3, rows[3][1], "en", "s", "k")]
    df = spark.createDataFrame(rows, DOC)
    kept = simhash.keep_one_similar(df.repartition(3))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == df.columns and len(ids) == len(set(ids)) and {900, 902} <= set(ids) and 901 not in ids and None not in ids
    assert {i for i in ids if i < 900} >= set(range(0, 75, 3)) and len(ids) <= 27 + 2  # one of each group, with what chance may leave
    assert simhash.keep_one_similar(df.limit(0)).count() == 0


def plain_similar(rows, width=5, similarity=0.8):
    """The ids kept by comparing all pairs."""
    sets = []
    for r in rows:
        words = r[1].lower().split()
        sets.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))})
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= similarity * len(a | sets[j]) - 1e-12:
                up[max(top(i), top(j))] = min(top(i), top(j))
    return sorted({rows[top(i)][0] for i in range(len(rows))})


def doc_rows(texts):
    return [(i, t, "en", "s", "k") for i, t in enumerate(texts)]


def test_similar_among_boilerplate(spark):
    """Near copies whose ids lie among other pages of the same template."""
    rng = random.Random(21)
    shared = text(rng, 150)
    pages = [shared + " " + text(rng, 120) for _ in range(120)]
    copies = [" ".join(p.split()[:-25]) for p in pages]
    rows = doc_rows(pages + copies)
    want = plain_similar(rows)
    assert want == list(range(120))
    got = simhash.keep_one_similar(spark.createDataFrame(rows, DOC).repartition(3))
    assert sorted(r.doc_id for r in got.collect()) == want
    # All members of a key meet, in blocks of whatever size.
    table = spark.createDataFrame([(7, i, 10, 0, i // 2) for i in range(23)], "key long, id long, n int, at int, label long")
    pairs = {(r.src, r.dst) for r in simhash.all_pairs(table, 0.8, block=5).collect()}
    assert pairs == {(i, j) for i in range(23) for j in range(i) if i // 2 != j // 2}


def test_similar_after_whole_edits(spark):
    """Truncated, appended and paragraph-exchanged copies of a similarity just over the threshold are all found, those just under it none."""
    rng = random.Random(22)
    pages, copies, others = [], [], []
    for i in range(90):
        words = text(rng, 240).split()
        cut, add = text(rng, 26).split(), text(rng, 55).split()
        pages.append(" ".join(words))
        copies.append(" ".join([words[:-44], words + add, words[:100] + cut[:20] + words[120:]][i % 3]))
        others.append(" ".join([words[:-60], words + add + cut, words[:100] + cut + cut[:9] + words[135:]][i % 3]) if i % 2 else text(rng, 80))
    rows = doc_rows(pages + copies)
    got = simhash.keep_one_similar(spark.createDataFrame(rows, DOC).repartition(3))
    assert sorted(r.doc_id for r in got.collect()) == plain_similar(rows) == list(range(90))
    rows = doc_rows(pages + others)
    got = simhash.keep_one_similar(spark.createDataFrame(rows, DOC).repartition(3))
    assert sorted(r.doc_id for r in got.collect()) == plain_similar(rows) == list(range(180))


def test_similar_keeps_different_pages_of_a_template(spark):
    """Pages of a template whose similarity is under the threshold are all kept, though many, and each has a near copy."""
    rng = random.Random(23)
    shared = text(rng, 260)
    pages = [shared + " " + text(rng, 45) for _ in range(200)]
    rows = doc_rows(pages + [p + " one more" for p in pages])
    want = plain_similar(rows)
    assert want == list(range(200))
    got = simhash.keep_one_similar(spark.createDataFrame(rows, DOC).repartition(3))
    assert sorted(r.doc_id for r in got.collect()) == want


def test_components(spark):
    rng = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(200, 200 + i) for i in range(1, 40)] + [(5, 5)]
    up = {}

    def top(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a != b:
            up[max(top(a), top(b))] = min(top(a), top(b))
    got = components.components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.node: r.label for r in got} == {i: top(i) for e in edges if e[0] != e[1] for i in e} and len(got) == len({r.node for r in got})
    assert components.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_pipeline(spark, tmp_path):
    df = spark.createDataFrame(corpus() + [(i + 1000, *r[1:]) for i, r in enumerate(near_copies(9)[:12])], DOC).drop("kept").selectExpr("*", "cast(length(text) as long) n_chars")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(240) if i % 4 < 2], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = df
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == df.columns, name
        docs = spark.createDataFrame(out.collect(), df.schema)
    want = packing.with_crc(packing.pack(docs)).select("doc_id").distinct().count()
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == want
    assert not {r.doc_id for r in docs.collect()} & set(range(0, 240, 6))


def test_pipeline_dedups_by_fingerprints(spark):
    """The stage keeps one document of each group of fingerprints within two bits, and no other."""
    from helixframe.llm import pipeline

    rows = [r for r in near_copies() if r[0] is not None]
    prints = [plain_print(r[1], 3) for r in rows]
    smallest = {}
    for r, t in zip(rows, plain_groups(prints)):
        smallest[t] = min(smallest.get(t, r[0]), r[0])
    kept = dict(pipeline.STAGES)["simhash near-dedup"](spark, spark.createDataFrame(rows, DOC), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(smallest.values())
