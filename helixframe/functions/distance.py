"""Distances between sequences as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.functions import kernels

FAR = 99


def semiglobal_distance(a: Column, b: Column, k: int, n: int, m: int, most: int | None = None) -> Column:
    """Edit distance of a and b (of lengths n and m) with up to k letters free at the end of either; 0 if k isn't less than both.

    With most, only distances up to it are told apart and all larger ones are FAR, which makes the banded built-in do."""
    if k >= n or k >= m:
        return F.lit(0)

    def plain(x: Column, y: Column) -> Column:
        if most is None:
            return F.levenshtein(x, y)
        d = F.levenshtein(x, y, most)
        return F.when(d < 0, F.lit(FAR)).otherwise(d)

    ways = [plain(a if t == 0 else F.substring(a, 1, n - t), b) for t in range(k + 1)]
    ways += [plain(a, F.substring(b, 1, m - t)) for t in range(1, k + 1)]
    return F.least(*ways) if len(ways) > 1 else ways[0]


def hamming(a: Column, b: Column) -> Column:
    """Places that differ; an error for unequal lengths."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    total = F.aggregate(differ, F.lit(0), lambda s, x: s + x)
    return F.when(F.length(a) == F.length(b), total).otherwise(F.raise_error(F.lit("sequences differ in length")).cast("int"))


def best_place(query: str, subject: Column, k: int, first_exact: bool = False) -> Column:
    """struct<pos, dist> of the window of subject that is closest to query within k edits, the ends free, the last of equal ones; with first_exact the
    first exact one. Null fields where no window is within k."""

    @F.pandas_udf("pos int, dist int")
    def run(s: pd.Series) -> pd.DataFrame:
        pos, dist = kernels.places([x if isinstance(x, str) else None for x in s], query, k, first_exact)
        return pd.DataFrame({"pos": pd.arrays.IntegerArray(pos, pos == 0), "dist": pd.arrays.IntegerArray(dist, pos == 0)})

    return run(subject)


def longest_common(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: a global alignment with match 1 and nothing else counted, row by row as nested folds."""
    letters = F.split(b, "")
    zero = F.transform(letters, lambda _: F.lit(0))

    def row(above: Column, x: Column) -> Column:
        pairs = F.arrays_zip(letters.alias("y"), above.alias("up"), F.concat(F.array(F.lit(0)), F.slice(above, 1, F.size(above) - 1)).alias("diagonal"))
        start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("left"))

        def cell(state: Column, p: Column) -> Column:
            value = F.greatest(p["up"], state["left"], p["diagonal"] + (p["y"] == x).cast("int"))
            return F.struct(F.concat(state["out"], F.array(value)).alias("out"), value.alias("left"))

        return F.aggregate(pairs, start, cell, lambda s: s["out"])

    return F.coalesce(F.array_max(F.aggregate(F.split(a, ""), zero, row)), F.lit(0))
