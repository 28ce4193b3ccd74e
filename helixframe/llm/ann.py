"""Nearest neighbours by multi-index hashing of learned binary codes.

Rotations are learnt on a bounded sample so that signs keep most of the vectors' directions (iterative quantisation, from several random starts, as many
as BITS need). Each code is split into substrings. All codes within a Hamming radius are found: by the pigeonhole principle such a code has a substring
within its share of the radius, so the balls of a query's substrings are probed in tables of a block's substrings, and the full distance is checked. Where
the balls hold more keys than the block has codes, which is so for vectors without structure, probing them would cost more than checking each code, and
each is checked; what is found is the same. The vectors behind the codes within the radius are ranked by cosine in double precision.

The radius is what NEIGHBOURS of sampled vectors need within the sample (RECALL of them), which is more than they need among all. Where a block has too
few codes within it, the radius grows there until there are enough. Codes are long, so that few lie within the radius: a few hundredths of all for random
vectors of 64 components.

The queries are a stated set; they meet all candidates in blocks of bounded size, queries and candidates both. Vectors that are null, zero, or hold null
or non-finite components take no part, nor do those of another length than the most frequent one (of equal ones the largest). Very small and very large
components are scaled by powers of two first, which changes no cosine. Rows of equal id are vectors of their own; only the query's own row is left out.
Ties go to the smaller id, a null id coming first. Extra columns are left out. An empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.llm.common import materialise

BITS, SUBSTRINGS = 512, 32
SAMPLE, LEARN, TRIALS, NEIGHBOURS, RECALL = 20_000, 5_000, 400, 5, 0.99
CANDIDATES, QUERIES, CHUNK = 16_384, 4_096, 64
WIDTH, WORDS = BITS // SUBSTRINGS, BITS // 64


def learn_rotation(x: np.ndarray, steps: int = 20, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the unit vectors x, and a matrix whose BITS products' signs are the code."""
    rng, mean = np.random.default_rng(seed), x.mean(0)
    y, d = x[:LEARN] - mean, x.shape[1]
    frame = np.eye(d)
    if d > BITS:  # the directions of most spread
        frame = np.linalg.svd(y.T @ y)[2][:BITS].T
        d = BITS
    y, turns = y @ frame, []
    for _ in range(-(-BITS // d)):
        turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(steps):
            u, _, v = np.linalg.svd(np.where(y @ turn >= 0, 1.0, -1.0).T @ y)
            turn = (u @ v).T
        turns.append(turn)
    return mean, frame @ np.concatenate(turns, axis=1)[:, :BITS]


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to between a half and one."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None]) if len(x) else x


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1))[:, None]


def codes(x: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """WORDS unsigned integers of each row."""
    out = np.empty((len(x), WORDS), np.uint64)
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = np.packbits((unit(x[i : i + 4096]) - mean) @ turn >= 0, axis=1).view(np.uint64)
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each code of a and each of b."""
    out = np.zeros((len(a), len(b)), np.uint16)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def radius_needed(x: np.ndarray, code: np.ndarray) -> int:
    some = x[:TRIALS]
    near = np.argsort(-(some @ x.T), axis=1)[:, 1 : NEIGHBOURS + 1]
    if not near.size:
        return BITS
    return int(np.quantile(np.bitwise_count(code[near] ^ code[: len(some), None]).sum(2), RECALL, method="higher"))


def ball(width: int, radius: int) -> np.ndarray:
    """All numbers of that width with so many bits at most."""
    every = np.arange(1 << width, dtype=np.int64)
    return every[np.bitwise_count(every) <= radius]


class Index:
    """The codes of a block, and the rows of each value of each substring."""

    def __init__(self, code: np.ndarray):
        self.code = code
        self.parts = np.ascontiguousarray(code).view(np.uint16).reshape(len(code), SUBSTRINGS)
        self.tables: list | None = None

    def shares(self, radius: int) -> list[int]:
        """Each substring's share of the radius: in one at least a code within it keeps to its share. -1: not looked at."""
        share, more = divmod(radius, SUBSTRINGS)
        return [min(WIDTH, share if s <= more else share - 1) for s in range(SUBSTRINGS)]

    def within(self, asked: np.ndarray, radius: int, k: int) -> Iterator[np.ndarray]:
        """For each code asked for, the rows whose codes are within the radius; if those are fewer than k, within the least radius that gives k."""
        probes = sum(len(self.balls(r)) for r in self.shares(radius) if r >= 0)
        for i in range(0, len(asked), CHUNK):
            part = asked[i : i + CHUNK]
            if probes * 4 < len(self.code):
                for code in part:
                    rows = self.probed(code, radius)
                    yield rows if len(rows) >= min(k, len(self.code)) else self.checked(code[None, :], radius, k)[0]
            else:
                yield from self.checked(part, radius, k)

    def checked(self, asked: np.ndarray, radius: int, k: int) -> list[np.ndarray]:
        far = distances(asked, self.code)
        k = min(k, len(self.code))
        return [np.flatnonzero(row <= max(radius, int(np.partition(row, k - 1)[k - 1]) if k else 0)) for row in far]

    def probed(self, code: np.ndarray, radius: int) -> np.ndarray:
        if self.tables is None:
            orders = [np.argsort(self.parts[:, s], kind="stable") for s in range(SUBSTRINGS)]
            self.tables = [(o, np.searchsorted(self.parts[o, s], np.arange((1 << WIDTH) + 1))) for s, o in enumerate(orders)]
        hit = np.zeros(len(self.code), bool)
        own = np.ascontiguousarray(code).view(np.uint16)
        for s, r in enumerate(self.shares(radius)):
            if r < 0:
                continue
            order, first = self.tables[s]
            keys = self.balls(r) ^ int(own[s])
            start, n = first[keys], first[keys + 1] - first[keys]
            some = n > 0
            start, n = start[some], n[some]
            at = np.repeat(start - (np.cumsum(n) - n), n)
            hit[order[at + np.arange(len(at))]] = True
        rows = np.flatnonzero(hit)
        return rows[distances(code[None, :], self.code[rows])[0] <= radius]

    known: dict[int, np.ndarray] = {}

    @classmethod
    def balls(cls, radius: int) -> np.ndarray:
        if radius not in cls.known:
            cls.known[radius] = ball(WIDTH, radius)
        return cls.known[radius]


def matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


NAMES = ["qb", "cb", "vec_id", "vector", "code", "row"]
FOUND = "query_row long, query_id long, vec_id long, score double"


def words(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The codes of a column of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WORDS)


def nearest(df: DataFrame, is_query: Column, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank from 1, vec_id and score of the k nearest found of each row for which is_query (of vec_id) holds."""
    kind = "array<float>" if isinstance(df.schema[vector_col].dataType.elementType, T.FloatType) else "array<double>"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"))
    rows = rows.where(usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    spark = df.sparkSession
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = int(sizes["dim"]), int(sizes["count"])
    rows = rows.where(F.size("vector") == dim)
    sample = rows.withColumn("h", F.xxhash64("vec_id", "vector")).orderBy("h", "vec_id").select("vector").limit(SAMPLE).toArrow()
    x = unit(matrix(sample.column(0), dim))
    mean, turn = learn_rotation(x)
    radius = radius_needed(x, codes(x, mean, turn))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                raw = codes(matrix(b.column(1), dim), mean, turn).tobytes()
                yield b.append_column("code", pa.array([raw[i : i + 8 * WORDS] for i in range(0, len(raw), 8 * WORDS)], pa.binary()))

    coded = rows.mapInArrow(encode, f"vec_id long, vector {kind}, code binary").withColumn("row", F.monotonically_increasing_id())
    coded = materialise(coded, "ann-codes")
    asked = coded.where(F.coalesce(is_query, F.lit(False)))
    c_blocks, q_blocks = -(-total // CANDIDATES), max(1, -(-asked.count() // QUERIES))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = coded.select(every(q_blocks).alias("qb"), block(c_blocks).alias("cb"), "vec_id", "vector", "code", "row")
    queries = asked.select(block(q_blocks).alias("qb"), every(c_blocks).alias("cb"), "vec_id", "vector", "code", "row")

    def search(there: pa.Table, ask: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if min(there.num_columns, ask.num_columns) >= 4 and there.num_rows and ask.num_rows:
            there, ask = (t.rename_columns(NAMES[-t.num_columns :]) for t in (there, ask))
            v, q = (scaled(matrix(t.column("vector"), dim)) for t in (there, ask))
            norm, q_norm = np.sqrt((v * v).sum(1)), np.sqrt((q * q).sum(1))
            ids = there.column("vec_id")
            rank = np.asarray(ids.fill_null(-(2**63))).astype(np.int64)
            names, own = ids.to_pylist(), there.column("row").to_numpy()
            asked_rows, asked_names = ask.column("row").to_pylist(), ask.column("vec_id").to_pylist()
            for i, found in enumerate(Index(words(there.column("code"))).within(words(ask.column("code")), radius, k + 1)):  # one may be the query itself
                found = found[own[found] != asked_rows[i]]
                cosine = (v[found] * q[i]).sum(1) / (norm[found] * q_norm[i])
                best = np.lexsort((rank[found], -cosine))[:k]
                out += [(asked_rows[i], asked_names[i], names[found[j]], float(cosine[j])) for j in best]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.table({c.split(" ")[0]: pa.array([o[i] for o in out], kinds[i]) for i, c in enumerate(FOUND.split(", "))})

    found = candidates.groupBy("qb", "cb").cogroup(queries.groupBy("qb", "cb")).applyInArrow(search, FOUND)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_first())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
