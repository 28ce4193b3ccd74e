"""Locating adapters in reads, and what their places say."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import codec as C
from helixframe.functions import distance as D
from helixframe.functions import kernels
from helixframe.functions import sequence as S
from helixframe.operators.chemistry import R1, TSO, Chemistry, reverse_complement

LISTS = "pos array<int>, strand array<int>, dist array<int>"

def ends(seq: Column, adapter: str, within: int, edits: int) -> Column:
    """struct<left, right> of best places in the first and last bases of the read, the reverse complement at the right end; null where none is.

    At the left end the first exact place wins, else the last of the closest ones, as always at the right end."""
    left = D.best_place(adapter, F.substring(seq, F.lit(1), F.least(F.lit(within), F.length(seq))), edits, first_exact=True)
    offset = F.greatest(F.length(seq) - within, F.lit(0))
    right = D.best_place(reverse_complement(adapter), F.substring(seq, offset + 1, F.lit(within)), edits)
    return F.struct(left["pos"].alias("left"), (right["pos"] + offset).alias("right"))


def scan(seq: Column, adapter: str, edits: int, regions: Column | None = None) -> Column:
    """All places of an adapter and its reverse complement from left to right: array<struct<pos, strand, dist>>.

    A window that is as close as the closest so far begins a hit, or takes over the last one if it lies less than the adapter's length behind it.
    regions: array<struct<start, end>>, looked through one by one, each with a closest of its own."""
    back = reverse_complement(adapter)

    def hits(seqs: pd.Series, limits: tuple | None) -> pd.DataFrame:
        pos, strand, dist = kernels.scanned([x if isinstance(x, str) else None for x in seqs], limits, adapter, back, edits)
        return pd.DataFrame({"pos": pos, "strand": strand, "dist": dist})

    if regions is None:
        found = F.pandas_udf(lambda s: hits(s, None), LISTS)(seq)
    else:
        bounds = [F.transform(regions, lambda r: r[c].cast("int")) for c in ("start", "end")]  # noqa: B023
        found = F.pandas_udf(lambda s, a, b: hits(s, (a, b)), LISTS)(seq, *bounds)
    return F.arrays_zip(*(found[c].alias(c) for c in ("pos", "strand", "dist")))


def jump_scan(seq: Column, adapter: str, edits: int) -> Column:
    """Places of an adapter (strand 1) or its reverse complement (-1) within the edits, going on behind each: array<struct<pos, strand>>."""
    back = reverse_complement(adapter)

    @F.pandas_udf("pos array<int>, strand array<int>")
    def run(s: pd.Series) -> pd.DataFrame:
        pos, strand = kernels.jumped([x if isinstance(x, str) else None for x in s], adapter, back, edits)
        return pd.DataFrame({"pos": pos, "strand": strand})

    found = run(seq)
    return F.arrays_zip(found["pos"].alias("pos"), found["strand"].alias("strand"))


def side(outer_left: Column, inner_left: Column, outer_right: Column, inner_right: Column) -> Column:
    """Where the barcode is by the adapters found at both ends (null: not found): left, right, both, none, or wrong for crossed ones."""
    found = {"il": inner_left, "ol": outer_left, "ir": inner_right, "or": outer_right}
    code = F.concat(*(F.when(c.isNotNull(), "1").otherwise("0") for c in found.values()))
    out = F.when(code == "0000", "none")
    out = out.when(code.isin("0101", "1001", "0110", "1010"), "both")
    out = out.when(code.isin("0100", "1000"), "left").when(code.isin("0001", "0010"), "right")
    out = out.when(code.isin("1100", "1101", "1110"), F.when(outer_left <= inner_left, "left").otherwise("wrong"))
    out = out.when(code.isin("0011", "0111", "1011"), F.when(inner_right <= outer_right, "right").otherwise("wrong"))
    out = out.when((inner_left < outer_left) & (inner_right < outer_right), "right")
    return out.when((inner_left > outer_left) & (inner_right > outer_right), "left").otherwise("both")


def kmer_window(r1: Column, strand: Column, chemistry: Chemistry = Chemistry()) -> tuple[Column, Column]:
    """First and last base of the window in which the barcode beside an adapter of an annotated read lies, for sequence.window_bounds().

    The bases lie from twice the mismatches before the adapter's end to mismatches behind the barcode's, or mirrored on the other strand."""
    n, k, m = len(chemistry.r1), chemistry.barcode, chemistry.mismatches
    forward = strand == S.FORWARD
    first = F.when(forward, r1 + 1 + n - 2 * m).otherwise(r1 + 1 - k - m)
    last = F.when(forward, r1 + 1 + n + k + m).otherwise(r1 + 1 + 2 * m)
    return first, last


def end_window(length: Column, at_left: Column, outer: Column, inner: Column, chemistry: Chemistry = Chemistry()) -> Column:
    """1-based start of the first k-mer beside the adapters at a read's end: by the outer one, else by the inner one; null where that is outside the read.

    The barcode is expected behind R1, or before the UMI and the inner adapter; k-mers begin margin bases before that and there are 2 * margin."""
    n, k, umi, margin = len(chemistry.r1), chemistry.barcode, chemistry.umi, chemistry.margin
    by_outer = F.when(at_left, outer + n - margin).otherwise(outer - k - margin)
    left = inner - k - umi - margin
    right = inner + len(TSO) + umi - margin
    by_inner = F.when(at_left, F.when(left >= 1, left)).otherwise(F.when(inner + len(TSO) + umi + k + margin - 1 <= length, right))
    return F.when(outer.isNotNull(), by_outer).otherwise(by_inner)


def complex_class(adapters: Column) -> Column:
    """Class of a read with two or more adapters: array<struct<pos, strand>> in order of place; null for fewer."""
    a, b = F.get(adapters, F.lit(0)), F.get(adapters, F.lit(1))
    gap = b["pos"] - a["pos"]
    fa, fb = a["strand"] == S.FORWARD, b["strand"] == S.FORWARD
    two = F.when(fa == fb, F.when(gap > 50, "Chimera").otherwise("R1a_duplication")).when(fa, F.when(gap > 100, "Dual_header").otherwise("Others")).otherwise(F.when(gap < 100, "Anti_dual_header").otherwise("Others"))
    same = F.size(F.array_distinct(F.transform(adapters, lambda x: x["strand"]))) == 1
    return F.when(F.size(adapters) == 2, two).when(F.size(adapters) > 2, F.when(same, "Chimera").otherwise("Others"))


def census(reads: DataFrame, r1: str = R1, tso: str = TSO) -> DataFrame:
    """The status report of reads (id, seq): length, runs of A and T, and number, places and strands of R1 within two edits and the oligo within one."""
    rows = reads.withColumns({"r": jump_scan(F.col("seq"), r1, 2), "t": jump_scan(F.col("seq"), tso, 1)})
    text = lambda c, f: C.joined(F.transform(c, lambda h: h[f]), ",")
    return rows.select(
        F.col("id").alias("read_id"),
        F.length("seq").alias("length"),
        S.motif_count(F.col("seq"), "[GCT]A{13}").alias("num_polya"),
        S.motif_count(F.col("seq"), "[GCA]T{13}").alias("num_polyt"),
        *(x.alias(n) for c, name in (("r", "r1"), ("t", "tso")) for n, x in ((f"num_{name}", F.size(c)), (f"{name}_indices", text(c, "pos")), (f"{name}_strand", text(c, "strand")))),
    )


def read_status(length: Column, r1_found: Column, barcode_found: Column, mapped: Column, within: int = 100, most: int = 100_000) -> Column:
    """Status of a read by its length, adapters, barcode and mapping."""
    return (
        length_status(length, within, most)
        .when(~mapped, "Read_unmapped")
        .when(~r1_found, "R1a_missing")
        .when(~barcode_found, "Barcode_missing")
        .otherwise("fine")
    )


def length_status(length: Column, within: int | None, most: int = 100_000) -> Column:
    """The first cases of a read's status: too long, or, with within, too short to have two ends of that length."""
    out = F.when(length >= most, "Read_too_long")
    return out if within is None else out.when(length <= 2 * within, "Read_too_short")
