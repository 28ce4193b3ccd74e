r"""Quality rules: fixed limits on text statistics, then robust multivariate outliers per language and source.

A document's statistics become a vector of six transformed values. Per language and source the minimum covariance determinant gives the centre and
spread of the three quarters of documents that lie closest together: groups are dealt into buckets of bounded size, concentration steps from several
starts run within each, the bucket with the least determinant starts the group, and further concentration steps run over all rows of the group as
DataFrame aggregations; what is known of groups goes to all rows, so no group's rows meet in one task. The estimate is made consistent, reweighted once, and a document whose squared Mahalanobis distance lies beyond the cutoff is
rejected. Documents that fail the fixed limits are rejected before and don't count in the fit.

A small spread is added to each value's variance (SPREAD), as many statistics are the same in nearly all documents. Groups of fewer than LEAST rows
are judged by their language's estimate, or by that of all documents; with fewer rows in all, only the fixed limits count. Null texts have no words
and fail. Null languages and sources are values like others. Repeated rows count as often as they stand there; extra columns pass through filter().
An empty table gives no rows."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import fresh, light, materialise, texts, tidy, utf8

BLANK = b" \t\n\r\x0b\x0c"
INNER = bytes(range(0x80, 0xC0))  # bytes that don't begin a code point
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_punct")
#: Standard deviations that are added to those of the six values: symbols, repeated words, repeated lines, word length, punctuation, variety.
SPREAD = (0.15, 0.1, 0.12, 0.06, 0.04, 0.03)
P = len(SPREAD)
SUBSET = 0.75
LEAST = 60
BUCKET_ROWS = 1000
BROADCAST = 20_000
STARTS = 12
STEPS = 3
TAIL = 1e-10


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    k = len(code)
    ids = np.fromiter(map(code.__getitem__, words), np.int64, n)
    pairs = ids[:-1] * k + ids[1:]
    if k > 1 << 20:
        pairs = np.unique(pairs, return_inverse=True)[1]
        if len(pairs) * k > 1 << 62:
            raise ValueError("text too long")
    triples = pairs[:-1] * k + ids[2:]
    ordered = np.sort(triples)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return 0
    found = np.isin(triples, again)
    inside = np.zeros(n, bool)
    for i in range(3):
        inside[i : n - 2 + i] |= found
    return int(inside.sum())


def text_stats(text: bytes) -> tuple[int, ...]:
    """STATS of a text in UTF-8."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text.translate(None, BLANK + INNER)),
        len(text) - len(text.translate(None, b"#*$%&|<>")),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        len(set(words)),
        len(text) - len(text.translate(None, b".,;:!?")),
    )


def with_stats(df: DataFrame, text_col: str, out: str, keep: list[str]) -> DataFrame:
    """keep, and a struct of STATS."""
    light(df.sparkSession)
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.StructType([T.StructField(s, T.LongType()) for s in STATS]))])
    rows = df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias(fresh(df, "text_of_stats")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([text_stats(x) for x in utf8(b.column(b.num_columns - 1))], np.int64).reshape(b.num_rows, len(STATS))
            struct = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(len(STATS))], list(STATS))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], struct], [*keep, out])

    return rows.mapInArrow(tidy(run), schema)


def base_failed(s: str) -> Column:
    return (F.col(f"{s}.n_words") < 50) | (100 * F.col(f"{s}.n_repeat_words") > 50 * F.col(f"{s}.n_words"))


def vector(s: str) -> list[Column]:
    """The six transformed values."""
    c = {k: F.col(f"{s}.{k}").cast("double") for k in STATS}
    words, lines, chars = (F.greatest(c[k], F.lit(1.0)) for k in ("n_words", "n_lines", "word_chars"))
    return [
        F.asinh(100 * c["n_symbols"] / chars),
        c["n_repeat_words"] / words,
        c["n_dup_lines"] / lines,
        F.log(chars / words),
        c["n_punct"] / words,
        F.log(F.greatest(c["n_distinct"], F.lit(1.0))) / F.log(F.greatest(words, F.lit(2.0))),
    ]


def chi2_cdf(x: float, dof: int) -> float:
    """For an even number of degrees of freedom."""
    term, total = 1.0, 1.0
    for i in range(1, dof // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_beyond(tail: float, dof: int) -> float:
    """The value that is exceeded with probability tail."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        x, term, total = mid / 2, 1.0, 1.0
        for i in range(1, dof // 2):
            term *= x / i
            total += term
        low, high = (mid, high) if math.exp(-x) * total > tail else (low, mid)
    return high


def consistency(share: float) -> float:
    return share / chi2_cdf(chi2_beyond(1 - share, P), P + 2)


def regular(cov: np.ndarray) -> np.ndarray:
    return cov + np.diag(np.square(SPREAD))


def concentrate(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, h: int, steps: int) -> tuple[float, np.ndarray, np.ndarray]:
    for _ in range(steps):
        d = x - mean
        far = np.einsum("ij,jk,ik->i", d, np.linalg.inv(regular(cov)), d)
        near = x[np.argsort(far, kind="stable")[:h]]
        mean, cov = near.mean(0), np.cov(near.T, bias=True)
    return float(np.linalg.slogdet(regular(cov))[1]), mean, cov


def mcd(x: np.ndarray, seed: int = 0) -> tuple[float, np.ndarray, np.ndarray]:
    """(log determinant, mean, covariance) of the closest SUBSET of x: the best of several starts, each concentrated."""
    rng, h = np.random.default_rng(seed), max(P + 1, math.ceil(SUBSET * len(x)))
    x = x[np.lexsort(x.T)]  # the order of rows doesn't count
    middle = np.median(x, 0)
    starts = [(middle, np.diag(np.square(1.4826 * np.median(np.abs(x - middle), 0))))]
    for _ in range(STARTS):
        some = x[rng.choice(len(x), min(len(x), P + 1), replace=False)]
        starts.append((some.mean(0), np.cov(some.T, bias=True)))
    tried = sorted((concentrate(x, m, c, h, 2) for m, c in starts), key=lambda t: t[0])
    return min((concentrate(x, m, c, h, 6) for _, m, c in tried[:3]), key=lambda t: t[0])


def key_of(level: int, lang: Column, source: Column) -> Column:
    named = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("!"))
    return F.concat(F.lit(f"{level}"), named(lang) if level < 2 else F.lit(""), F.lit("\x1f"), named(source) if level < 1 else F.lit(""))


def small(groups: DataFrame) -> DataFrame:
    """Rows of groups, to be sent to all rows of documents if there are BROADCAST at most (some hundred bytes each); joined by key if more."""
    return F.broadcast(groups) if groups.limit(BROADCAST + 1).count() <= BROADCAST else groups


SUMS = [(i, j) for i in range(P) for j in range(i, P)]
MODEL = "key string, n long, mean array<double>, inverse array<double>"


def distance(x: list[Column], mean: Column, inverse: Column) -> Column:
    d = [v - F.get(mean, F.lit(i)) for i, v in enumerate(x)]
    return sum((F.get(inverse, F.lit(k)) * (1.0 if i == j else 2.0) * d[i] * d[j] for k, (i, j) in enumerate(SUMS)), F.lit(0.0))


def model_row(key: str, n: int, mean: np.ndarray, cov: np.ndarray) -> dict:
    inverse = np.linalg.inv(regular(cov))
    return {"key": key, "n": n, "mean": mean.tolist(), "inverse": [float(inverse[i, j]) for i, j in SUMS]}


def moments(rows: DataFrame, factor: float) -> DataFrame:
    """MODEL from the mean and covariance of each key's rows, the latter times factor."""
    x = [F.col(f"x{i}") for i in range(P)]
    sums = rows.groupBy("key").agg(F.count("*").alias("n"), F.array(*(F.sum(v) for v in x)).alias("s"), F.array(*(F.sum(x[i] * x[j]) for i, j in SUMS)).alias("ss"))

    def solve(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, n, s, ss in zip(frame["key"], frame["n"], frame["s"], frame["ss"]):
                mean, cov = np.asarray(s) / n, np.zeros((P, P))
                for k, (i, j) in enumerate(SUMS):
                    cov[i, j] = cov[j, i] = ss[k] / n - mean[i] * mean[j]
                out.append(model_row(key, n, mean, factor * cov))
            yield pd.DataFrame(out, columns=["key", "n", "mean", "inverse"])

    return sums.mapInPandas(solve, MODEL)


def groups(stats: DataFrame) -> DataFrame:
    """lang, source, n, and the level whose estimate judges them: 0 their own, 1 the language's, 2 that of all, 3 none."""
    one = materialise(stats.groupBy("lang", "source").agg(F.count(F.when(~F.col("failed"), 1)).alias("n")), "mcd-counts")
    by_lang = one.groupBy(F.col("lang").alias("l_lang")).agg(F.sum("n").alias("in_lang"))
    in_all = one.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    level = F.when(F.col("n") >= LEAST, 0).when(F.col("in_lang") >= LEAST, 1).otherwise(2 if in_all >= LEAST else 3)
    return one.join(by_lang, F.col("lang").eqNullSafe(F.col("l_lang"))).select("lang", "source", "n", level.alias("level"))


def fit(stats: DataFrame) -> DataFrame:
    """lang, source, mean and inverse that judge each group; null where nothing can be fitted. stats: lang, source, failed, x0 to x5."""
    known = materialise(groups(stats), "mcd-groups")
    named = small(known.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "level", "n"))
    wide = named.groupBy("g_lang").agg(F.max(F.col("level") == 1).alias("by_lang"))
    any_all = known.agg(F.max(F.col("level") == 2)).first()[0]
    rows = stats.where(~F.col("failed")).join(named, stats.lang.eqNullSafe(F.col("g_lang")) & stats.source.eqNullSafe(F.col("g_source")))
    rows = rows.join(small(wide.select(F.col("g_lang").alias("w_lang"), "by_lang")), F.col("lang").eqNullSafe(F.col("w_lang")))
    lang, source = F.col("lang"), F.col("source")
    keys = F.array(F.when(F.col("level") == 0, key_of(0, lang, source)), F.when(F.col("by_lang"), key_of(1, lang, source)), F.when(F.lit(bool(any_all)), key_of(2, lang, source)))
    rows = materialise(rows.select(F.explode(F.array_compact(keys)).alias("key"), *(f"x{i}" for i in range(P))), "mcd-rows")

    counts = materialise(rows.groupBy("key").count().withColumnRenamed("key", "c_key"), "mcd-sizes")
    salted = rows.join(small(counts), F.col("key") == F.col("c_key")).withColumn(
        "bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.ceil(F.col("count") / BUCKET_ROWS))
    )

    def start(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame[[f"x{i}" for i in range(P)]].to_numpy(float)
        if len(x) < LEAST // 2:
            return pd.DataFrame([], columns=["key", "n", "mean", "inverse", "size"])
        size, mean, cov = mcd(x)
        return pd.DataFrame([model_row(frame["key"].iloc[0], len(x), mean, consistency(SUBSET) * cov) | {"size": size}])

    best = salted.groupBy("key", "bucket").applyInPandas(start, MODEL + ", size double").groupBy("key").agg(F.min_by(F.struct("n", "mean", "inverse"), F.struct("size", "mean")).alias("m"))
    model = materialise(best.select("key", "m.*"), "mcd-start")
    x = [F.col(f"x{i}") for i in range(P)]
    for step in range(STEPS + 1):
        at = rows.join(small(model.select(F.col("key").alias("m_key"), "mean", "inverse")), F.col("key") == F.col("m_key"))
        far = at.withColumn("far", distance(x, F.col("mean"), F.col("inverse")))
        if step == STEPS:  # reweighting
            near, factor = far.where(F.col("far") <= chi2_beyond(0.025, P)), consistency(0.975)
        else:  # the closest rows: all bins up to the one in which the wanted number is reached
            far = far.withColumn("bin", F.floor(F.log2(F.greatest(F.col("far"), F.lit(2.0**-20))) * 64).cast("int"))
            w = Window.partitionBy("key").orderBy("bin")
            bins = far.groupBy("key", "bin").count().withColumns({"upto": F.sum("count").over(w), "n": F.sum("count").over(Window.partitionBy("key"))})
            last = bins.where(F.col("upto") >= F.col("n") * SUBSET).groupBy("key").agg(F.min("bin").alias("last")).withColumnRenamed("key", "l_key")
            last = small(materialise(last, "mcd-last"))
            near, factor = far.join(last, (F.col("key") == F.col("l_key")) & (F.col("bin") <= F.col("last"))), consistency(SUBSET)
        model = materialise(moments(near.select("key", *x), factor), "mcd-step")
    chosen = F.element_at(F.array(*(key_of(i, lang, source) for i in range(3))), F.least(F.col("level"), F.lit(2)) + 1)
    judged = known.where("level < 3").select("lang", "source", chosen.alias("g_key"))
    return materialise(judged.join(model, F.col("g_key") == F.col("key")).select("lang", "source", "mean", "inverse"), "mcd-model")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, STATS, failed and the vector of each document, written once."""
    rows = texts(docs, "doc_id", "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    stats = with_stats(rows, "text", "s", ["doc_id", "lang", "source"])
    return stats.select("doc_id", "lang", "source", "s", base_failed("s").alias("failed"), *(v.alias(f"x{i}") for i, v in enumerate(vector("s"))))


def judge(rows: DataFrame, model: DataFrame, tail: float = TAIL) -> DataFrame:
    """Appends mahalanobis (squared, null without an estimate) and kept to rows of measured()."""
    m = small(model.select(F.col("lang").alias("m_lang"), F.col("source").alias("m_source"), "mean", "inverse"))
    both = rows.join(m, rows.lang.eqNullSafe(F.col("m_lang")) & rows.source.eqNullSafe(F.col("m_source")), "left")
    far = distance([F.col(f"x{i}") for i in range(P)], F.col("mean"), F.col("inverse"))
    out = both.withColumn("mahalanobis", far).drop("m_lang", "m_source", "mean", "inverse")
    return out.withColumn("kept", ~F.col("failed") & (F.coalesce(F.col("mahalanobis"), F.lit(0.0)) <= chi2_beyond(tail, P)))


def rate(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, s (STATS), failed, the vector, mahalanobis and kept."""
    rows = materialise(measured(docs), "text-stats")
    return judge(rows, fit(rows))


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns."""
    stats = measured(docs).drop("doc_id", "s")
    model = fit(materialise(stats, "text-stats"))
    s = fresh(docs, "stats_of_text")
    rows = with_stats(docs, "text", s, docs.columns)
    m = model.toDF("m_lang_", "m_source_", "m_mean_", "m_inverse_")
    names = {c: fresh(docs, c) for c in m.columns}
    m = small(m.toDF(*names.values()))
    lang, source, mean, inverse = (F.col(f"`{c}`") for c in m.columns)
    both = rows.join(m, F.col("lang").cast("string").eqNullSafe(lang) & F.col("source").cast("string").eqNullSafe(source), "left")
    far = F.coalesce(distance(vector(s), mean, inverse), F.lit(0.0))
    return both.where(~base_failed(s) & (far <= chi2_beyond(TAIL, P))).select(*(F.col(f"`{c}`") for c in docs.columns))
