"""Column functions on nucleotide sequences. Positions are 1-based; null in, null out."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strand codes.
FORWARD, REVERSE = 0, 3


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a costly column that later columns use more than once; as a generator's output it isn't computed anew for each use."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What use makes of a value, which is written down and computed once, within an expression."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def reverse(seq: Column) -> Column:
    return F.reverse(seq)


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    return complement(F.reverse(seq))


def folded_reverse_complement(seq: Column) -> Column:
    """Of any letter case; what isn't a base becomes N."""
    return reverse_complement(F.regexp_replace(F.upper(seq), "[^ACGT]", "N"))


def positions(first: Column, last: Column) -> Column:
    """first..last as an array, empty if first > last."""
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def kmers(seq: Column, k: int, first: Column | None = None, last: Column | None = None) -> Column:
    """array<struct<pos, kmer>> of all k-mers that start between first and last, the whole sequence by default."""
    end = F.length(seq) - F.lit(k - 1)
    first = F.lit(1) if first is None else F.greatest(first, F.lit(1))
    last = end if last is None else F.least(last, end)
    return F.transform(positions(first.cast("int"), last.cast("int")), lambda p: F.struct(p.alias("pos"), F.substring(seq, p, F.lit(k)).alias("kmer")))


def window_bounds(seq: Column, k: int, start: Column, end: Column) -> tuple[Column, Column]:
    """First and last start of the k-mers between the places start and end: the last start is end - k, or the last one there is."""
    room = F.length(seq) - F.lit(k)
    return F.greatest(start - 1, F.lit(0)) + 1, F.when(end > room, room).otherwise(end - F.lit(k)) + 1


def segment_lengths(length: int, parts: int) -> list[int]:
    """Lengths of parts segments, the first ones longer where length isn't a multiple."""
    return [length // parts + (i < length % parts) for i in range(parts)]


def word_sizes(length: int, edits: int) -> list[int]:
    """Segment lengths of which at least one is free of edits."""
    return segment_lengths(length, edits + 1)


def segments(seq: Column, lengths: list[int]) -> Column:
    """array<struct<no, segment>>; an error where the lengths don't sum to the sequence's."""
    starts = [1 + sum(lengths[:i]) for i in range(len(lengths))]
    cut = F.array(*(F.struct(F.lit(i).alias("no"), F.substring(seq, s, n).alias("segment")) for i, (s, n) in enumerate(zip(starts, lengths))))
    return F.when(F.length(seq) == sum(lengths), cut).otherwise(F.raise_error(F.lit("segment lengths don't sum to the sequence length")).cast("array<struct<no:int,segment:string>>"))


def poly_tail(seq: Column, n: int = 10) -> Column:
    """0 with a run of A alone, 3 with a run of T alone, else -1."""
    a, t = seq.contains("A" * n), seq.contains("T" * n)
    return F.when(a & ~t, F.lit(FORWARD)).when(t & ~a, F.lit(REVERSE)).otherwise(F.lit(-1))


def motif_count(seq: Column, pattern: str) -> Column:
    """Matches that don't overlap."""
    return F.regexp_count(seq, F.lit(pattern))


def tail_sites(seq: Column, pattern: str, length: int) -> Column:
    """0-based starts of all matches of a pattern of fixed length."""
    every = positions(F.lit(1), F.length(seq) - F.lit(length - 1))
    return F.transform(F.filter(every, lambda p: F.substring(seq, p, F.lit(length)).rlike(pattern)), lambda p: p - 1)


#: Tails of ten bases and their border: A before another base, and T after one.
A_TAIL, T_TAIL, TAIL_LENGTH = "^A{10}[^A]", "^[^T]T{10}", 11


def kmer_code(kmer: Column, k: int = 6) -> Column:
    """Base-4 number of a k-mer; -1 if it is shorter, -2 if it holds another letter."""
    parts = [_digit(F.substring(kmer, i + 1, 1)) * (4 ** (k - 1 - i)) for i in range(k)]
    return F.when(F.length(kmer) < k, F.lit(-1)).when(~F.substring(kmer, 1, k).rlike("^[ACGT]+$"), F.lit(-2)).otherwise(reduce(lambda a, b: a + b, parts))


def _digit(base: Column) -> Column:
    return F.when(base == "C", 1).when(base == "G", 2).when(base == "T", 3).otherwise(0)


def mean_quality(qual: Column, k: int = 6) -> Column:
    """Mean of the character codes of each k-window, whole numbers, with # (35) at the places before the first window is full."""
    code = F.transform(F.split(qual, ""), lambda c: F.ascii(c))
    n = F.size(code)
    mean = lambda p: F.floor(F.aggregate(F.slice(code, p, k), F.lit(0), lambda a, x: a + x) / k).cast("int")
    return F.when(n < k, F.array_repeat(F.lit(35), n)).otherwise(F.concat(F.transform(positions(F.lit(1), n - F.lit(k - 1)), mean), F.array_repeat(F.lit(35), k - 1)))


def last_quality(qual: Column, k: int = 6) -> Column:
    """Character code of the last base of each k-window; empty where there is none."""
    return F.transform(positions(F.lit(k), F.length(qual)), lambda p: F.ascii(F.substring(qual, p, F.lit(1))))


def trimmed(seq: Column, qual: Column, start: Column, strand: Column, barcode_length: Column, tech: int = 5) -> Column:
    """struct<umi, seq, qual>: the UMI beside a barcode that begins at start, and the read beyond it, given in the direction of the transcript.

    UMIs have 10 bases with 5' chemistry, 12 with 3'. On the reverse strand the UMI lies before the barcode and is given reverse-complemented. Transcripts
    run away from a 5' barcode and towards a 3' one, so the forward strand is turned with 3' chemistry, the reverse one with 5'. Null without a start."""
    n = 10 if tech == 5 else 12
    ahead = start + barcode_length
    forward = strand == FORWARD
    code = F.when(forward, F.substring(seq, ahead, F.lit(n))).otherwise(reverse_complement(F.substring(seq, F.greatest(start - n, F.lit(1)), F.least(F.lit(n), start - 1))))
    left = F.when(forward, ahead + n).otherwise(F.lit(1))
    size = F.when(forward, F.greatest(F.length(seq) - left + 1, F.lit(0))).otherwise(F.greatest(start - 1 - n, F.lit(0)))
    rest, marks = F.substring(seq, left, size), F.substring(qual, left, size)
    turn = forward if tech == 3 else ~forward
    return F.when(start.isNotNull(), F.struct(code.alias("umi"), F.when(turn, reverse_complement(rest)).otherwise(rest).alias("seq"), F.when(turn, F.reverse(marks)).otherwise(marks).alias("qual")))


def umi_and_insert(seq: Column, start: Column, strand: Column, barcode_length: Column, tech: int = 5, umi: int = 10, spacer: int = 13) -> tuple[Column, Column]:
    """The UMI behind a barcode that begins at start, and what is left of the read beyond it and, for 5' chemistry, the template-switch oligo.

    On the reverse strand the UMI lies before the barcode and is given reverse-complemented."""
    skip = umi + (spacer if tech == 5 else 0)
    ahead = start + barcode_length
    forward = strand == FORWARD
    code = F.when(forward, F.substring(seq, ahead, F.lit(umi))).otherwise(reverse_complement(F.substring(seq, F.greatest(start - umi, F.lit(1)), F.least(F.lit(umi), start - 1))))
    rest = F.when(forward, F.substring(seq, ahead + skip, F.length(seq))).otherwise(F.substring(seq, F.lit(1), F.greatest(start - 1 - skip, F.lit(0))))
    return code, F.when(forward, rest).otherwise(reverse_complement(rest))
