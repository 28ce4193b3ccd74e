"""Connected components by alternating large and small stars, with every round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import discard, materialise, sorted_join


def star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: src > dst. large: each node's larger neighbours are linked to the least of its neighbours and itself; else its smaller ones and itself."""
    both = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))
    if large:
        both = both.union(edges.select("dst", "src"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "w")
    at = sorted_join(both, least, "u", "w")
    if large:
        out = at.where("v > u").select(F.col("v").alias("src"), F.col("m").alias("dst"))
    else:
        out = at.select(F.col("v").alias("src"), F.col("m").alias("dst")).union(at.select("u", "m"))
    return out.where("src <> dst").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label: every node that has an edge, and the least node of its component. edges: src, dst, two whole numbers each; rows with a null are left out, and no
    edges give no rows.

    The rounds needed grow with the logarithm of the largest component's diameter."""
    now = edges.where("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    state = None
    for _ in range(rounds):
        before, now = now, materialise(star(star(now, large=True), large=False), "component-round")
        if state is not None:
            discard(before)
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if mark == state:
            break
        state = mark
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("label")).union(now.select("dst", "dst").distinct())
