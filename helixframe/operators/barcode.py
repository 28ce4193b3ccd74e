"""Assigning reads to barcodes: exact and seeded fuzzy joins of k-mers with a whitelist."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import distance as D
from helixframe.functions import kernels
from helixframe.functions import sequence as S

#: A whitelist is sent to all tasks while its rows times the seeds of each take about this much at most; larger ones are joined by exchange.
BROADCAST_BYTES = 256 << 20
ROW_BYTES = 96


def hinted(small: DataFrame, rows: int, copies: int = 1) -> DataFrame:
    """small, with a broadcast hint if that many rows are within the bound."""
    return F.broadcast(small) if rows * copies * ROW_BYTES <= BROADCAST_BYTES else small


def checked_whitelist(whitelist: DataFrame, length: int = 16) -> DataFrame:
    """ordinal, barcode; rows without a barcode are left out, one of another length is an error."""
    rows = whitelist.where(F.col("barcode").isNotNull() & (F.col("barcode") != ""))
    right = F.when(F.length("barcode") == length, F.col("barcode")).otherwise(F.raise_error(F.lit(f"a barcode isn't of {length} bases")).cast("string"))
    return rows.select("ordinal", right.alias("barcode"))


def read_kmers(reads: DataFrame, k: int, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """id, pos, kmer of reads (id, seq), starts between first and last; and strand, where reads have one."""
    more = [c for c in ("strand",) if c in reads.columns]
    return reads.select("id", *more, F.explode(S.kmers(F.col("seq"), k, first, last)).alias("w")).select("id", *more, "w.pos", "w.kmer")


def words(whitelist: DataFrame) -> DataFrame:
    """ordinal, barcode, w_strand, word: each barcode, and its reverse complement for the reverse strand."""
    both = F.array(F.struct(F.lit(S.FORWARD).alias("strand"), F.col("barcode").alias("word")), F.struct(F.lit(S.REVERSE).alias("strand"), S.reverse_complement(F.col("barcode")).alias("word")))
    return whitelist.select("ordinal", "barcode", F.explode(both).alias("s")).select("ordinal", "barcode", F.col("s.strand").alias("w_strand"), "s.word")


def own_strand(kmers: DataFrame) -> Column:
    """Forward words for k-mers of the forward strand, reverse ones for those of the reverse; both where k-mers have no strand."""
    return F.col("strand") == F.col("w_strand") if "strand" in kmers.columns else F.lit(True)


def exact_matches(kmers: DataFrame, whitelist: DataFrame) -> DataFrame:
    """id, pos, strand, ordinal, barcode of k-mers (id, pos, kmer, and strand if it is known) that are a barcode or its reverse complement."""
    side = hinted(words(whitelist), whitelist.count(), 2)
    return kmers.join(side, (kmers.kmer == side.word) & own_strand(kmers)).select("id", "pos", F.col("w_strand").alias("strand"), "ordinal", "barcode")


def fuzzy_matches(kmers: DataFrame, whitelist: DataFrame, length: int = 16, edits: int = 2) -> DataFrame:
    """id, pos, strand, ordinal, barcode, edits of k-mers within so many edits of a barcode (its reverse complement on the reverse strand).

    Of edits + 1 segments one must be equal at its place; the pairs that share one are verified by the end-free distance, computed once."""
    lengths = S.segment_lengths(length, edits + 1)
    index = words(whitelist).select("*", F.explode(S.segments(F.col("word"), lengths)).alias("g")).select("ordinal", "barcode", "w_strand", "word", F.col("g.no").alias("w_no"), F.col("g.segment").alias("w_segment"))
    index = hinted(index, whitelist.count(), 2 * (edits + 1))
    probe = kmers.select("*", F.explode(S.segments(F.col("kmer"), lengths)).alias("g")).select(*kmers.columns, "g.*")
    # A pair that shares several segments counts once, for its first.
    earlier = F.lit(False)
    start = 1
    for no, n in enumerate(lengths[:-1]):
        earlier = earlier | ((F.col("no") > no) & (F.substring("kmer", start, n) == F.substring("word", start, n)))
        start += n
    pairs = probe.join(index, (probe.segment == index.w_segment) & (probe.no == index.w_no) & own_strand(kmers)).where(~earlier)
    pairs = pairs.select("id", "pos", "kmer", F.col("w_strand").alias("strand"), "ordinal", "barcode", "word")
    near = S.once(pairs, "edits", D.semiglobal_distance(F.col("kmer"), F.col("word"), edits, length, length, most=edits))
    return near.where(F.col("edits") <= edits).select("id", "pos", "strand", "ordinal", "barcode", "edits")


#: Whitelist rows that are matched in memory; longer lists are matched by joins.
MEMORY_ROWS = 1_000_000
MATCHES = "array<struct<edits:int,pos:int,ordinal:long,barcode:string>>"


def match(rows: DataFrame, whitelist: DataFrame, length: int = 16, edits: int = 2, exact_first: bool = True) -> DataFrame:
    """Adds found (MATCHES) to rows with a unique id, a window of bases, its place pos and its strand: the barcodes that k-mers of the window match.

    Each barcode stands there once, by its fewest edits, then its first place; fewest edits come first, ties by place, then ordinal. With exact_first,
    windows with an exact match have no others. A null window matches nothing. Lists of up to MEMORY_ROWS go to all tasks, so that a read's barcode is
    found where the read is and nothing is exchanged; longer ones are joined by exchange."""
    lengths = S.segment_lengths(length, edits + 1)
    checked = checked_whitelist(whitelist, length)
    known = checked.limit(MEMORY_ROWS + 1).select(F.col("ordinal").cast("long").alias("ordinal"), "barcode").toPandas()  # a checked bound
    if len(known) > MEMORY_ROWS:
        return matched_by_join(rows, checked, length, edits, exact_first)
    index = rows.sparkSession.sparkContext.broadcast(kernels.Barcodes(known["ordinal"].tolist(), known["barcode"].tolist(), lengths))

    @F.pandas_udf("barcode array<string>, pos array<int>, edits array<int>, ordinal array<long>")
    def run(window: pd.Series, pos: pd.Series, strand: pd.Series) -> pd.DataFrame:
        whole = lambda s: s.fillna(0).to_numpy(np.int64)
        found = index.value.best([w if isinstance(w, str) else None for w in window], whole(pos), whole(strand), edits, exact_first)
        return pd.DataFrame(dict(zip(("barcode", "pos", "edits", "ordinal"), found)))

    out = S.once(rows, "found_lists", run("window", F.col("pos").cast("int"), F.col("strand").cast("int")))
    return S.once(out, "found", F.arrays_zip(*(F.col(f"found_lists.{c}").alias(c) for c in ("edits", "pos", "ordinal", "barcode")))).drop("found_lists")


def matched_by_join(rows: DataFrame, whitelist: DataFrame, length: int, edits: int, exact_first: bool) -> DataFrame:
    """The same by joins of k-mers; a read's few matches meet under its id."""
    kmers = rows.select("id", "strand", F.explode(S.kmers(F.col("window"), length)).alias("w"), F.col("pos").alias("first"))
    kmers = kmers.select("id", "strand", (F.col("first") + F.col("w.pos") - 1).cast("int").alias("pos"), "w.kmer")
    exact = exact_matches(kmers, whitelist).withColumn("edits", F.lit(0))
    if exact_first:
        kmers = kmers.join(exact.select("id").distinct(), "id", "left_anti")
    near = fuzzy_matches(kmers, whitelist, length, edits)
    every = exact.unionByName(near) if exact_first else near
    order = F.struct(F.col("edits").cast("int").alias("edits"), F.col("pos").cast("int").alias("pos"), F.col("ordinal").cast("long").alias("ordinal"))
    one = every.groupBy("id", "barcode").agg(F.min(order).alias("m"))
    found = one.groupBy(F.col("id").alias("m_id")).agg(F.sort_array(F.collect_list(F.struct("m.edits", "m.pos", "m.ordinal", "barcode"))).alias("found"))
    return rows.join(found, F.col("id") == F.col("m_id"), "left").withColumn("found", F.coalesce("found", F.array().cast(MATCHES))).drop("m_id")


def barcode_score(edits: Column) -> Column:
    """Penalty of a barcode by its edits."""
    # The penalties of 0 to 4 edits, and that of all others.
    return F.coalesce(F.get(F.array(*map(F.lit, (0, 20, 28, 44, 75))), F.when(edits >= 0, edits)), F.lit(999999))


def barcode_counts(best: DataFrame) -> DataFrame:
    return best.groupBy("barcode").agg(F.count("*").alias("n_reads"))
