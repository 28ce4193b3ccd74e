"""From reads to counts per barcode and gene, with a second pass over the parts of chimeric reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import calls, chimera, clones
from helixframe.operators.chemistry import Chemistry

Aligner = Callable[[DataFrame], DataFrame]


def one_pass(reads: DataFrame, whitelist: DataFrame, align: Aligner, names: DataFrame, chemistry: Chemistry, within: int) -> tuple[DataFrame, DataFrame]:
    """Called reads (id, seq, qual, barcode, barcode_start, barcode_strand), and read, gene, chimeric of their alignments. Reads are named id_barcode."""
    called = calls.call(reads.select("id", "seq"), whitelist, chemistry, within).where("barcode is not null")
    called = called.select(F.col("id").alias("c_id"), "barcode", "barcode_start", "barcode_strand")
    rows = reads.join(called, F.col("id") == F.col("c_id")).drop("c_id")
    named = rows.select(F.concat_ws("_", "id", "barcode").alias("id"), "seq", "qual")
    return rows, chimera.triage(align(named), names)


def two_passes(reads: DataFrame, whitelist: DataFrame, align: Aligner, names: DataFrame, chemistry: Chemistry = Chemistry(), within: int = 100, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """barcode, gene, n of reads (id, seq, qual).

    align gives the alignments of named reads, as chimera.triage() takes them; it stands for the external aligner. Reads whose alignments show two genes
    are split at their poly-A or poly-T tail; the parts are called, aligned and judged anew, and both passes are counted. Names end at the first
    underscore, behind which the barcode stands. keep: what to do with tables that are read more than once, such as writing and re-reading them."""
    called, judged = (keep(df) for df in one_pass(reads, whitelist, align, names, chemistry, within))
    chimeric = judged.where("chimeric").select(F.split("read", "_")[0].alias("id"))
    mixed = chimera.of_reads(called, chimeric)
    forward = F.col("barcode_strand") == calls.STRANDS[S.FORWARD]
    cut = S.once(mixed, "tail", chimera.tail_cut(F.col("seq"), forward, chemistry.tech)).withColumn("cut", F.col("tail.cut")).where("cut is not null")
    _, again = one_pass(chimera.raw_parts(cut, forward), whitelist, align, names, chemistry, within)
    every = judged.unionByName(keep(again)).where("not chimeric and gene is not null")
    return clones.gene_counts(every.select(F.split("read", "_")[1].alias("barcode"), "gene"))
