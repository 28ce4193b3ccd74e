"""Calling reads end to end: adapters, orientation, barcode, status, annotation and score."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import sequence as S
from helixframe.operators import adapters, annotate, barcode, chimera, dtw
from helixframe.operators.chemistry import Chemistry

# Names of statuses by the side on which adapters were found.
REJECTED = {"none": "ICS_R1_missing", "both": "Dual_header", "wrong": "ICS_R1_wrongly_oriented"}
STRANDS = {S.FORWARD: "forward", S.REVERSE: "reverse"}


def located(reads: DataFrame, chemistry: Chemistry = Chemistry(), within: int = 100) -> DataFrame:
    """Adds to reads (id, seq) polyat, side, strand, outer and inner: where the barcode is and the places of the adapters there, null if not found.

    A run of A or T alone fixes the side, and only that end counts; else the table of adapters.side() decides."""
    inner_edits = chemistry.inner_edits if chemistry.tech == 5 else 0
    r1, inside = (adapters.ends(F.col("seq"), word, within, edits) for word, edits in ((chemistry.r1, chemistry.r1_edits), (chemistry.inner, inner_edits)))
    places = F.struct(r1["left"].alias("ol"), r1["right"].alias("orr"), inside["left"].alias("il"), inside["right"].alias("ir"), S.poly_tail(F.col("seq")).alias("tail"))
    rows = S.once(reads, "ends", places)
    ol, orr, il, ir, tail = (F.col(f"ends.{c}") for c in ("ol", "orr", "il", "ir", "tail"))
    known = F.when(tail == (S.FORWARD if chemistry.tech == 5 else S.REVERSE), F.lit("left")).when(tail >= 0, F.lit("right"))
    left = F.when(ol.isNull() & il.isNull(), "none").when(ol > il, "wrong").otherwise("left")
    right = F.when(orr.isNull() & ir.isNull(), "none").when(ir > orr, "wrong").otherwise("right")
    rows = S.once(rows.withColumn("polyat", tail >= 0), "side", F.when(known == "left", left).when(known == "right", right).otherwise(adapters.side(ol, il, orr, ir)))
    pick = lambda a, b: F.when(F.col("side") == "left", a).when(F.col("side") == "right", b)
    return rows.withColumns({"strand": pick(F.lit(S.FORWARD), F.lit(S.REVERSE)), "outer": pick(ol, orr), "inner": pick(il, ir)}).drop("ends")


def windows(rows: DataFrame, chemistry: Chemistry = Chemistry()) -> DataFrame:
    """Adds pos and window to rows of located(): the bases of the k-mers in which the barcode is sought; null where there are none."""
    length, n = F.length("seq"), chemistry.barcode
    rows = S.once(rows, "first_place", adapters.end_window(length, F.col("side") == "left", F.col("outer"), F.col("inner"), chemistry))
    start, last = F.greatest("first_place", F.lit(1)), F.least(F.col("first_place") + 2 * chemistry.margin - 1, length - n + 1)
    there = F.col("side").isin("left", "right") & F.col("first_place").isNotNull() & (start <= last)
    return rows.withColumns({"pos": F.when(there, start), "window": F.when(there, F.substring(F.col("seq"), start, last - start + n))}).drop("first_place")


def chosen(rows: DataFrame) -> DataFrame:
    """Replaces found, pos and window by the summary's columns on barcodes."""
    best = F.get("found", F.lit(0))
    lists = {c: F.transform("found", lambda x: x[f]) for c, f in (("barcodes", "barcode"), ("barcode_starts", "pos"), ("barcode_mismatches", "edits"))}  # noqa: B023
    text = F.when(F.col("strand") == S.FORWARD, STRANDS[S.FORWARD]).when(F.col("strand") == S.REVERSE, STRANDS[S.REVERSE])
    rows = rows.withColumns({"barcode": best["barcode"], "barcode_start": best["pos"], "barcode_mismatch": best["edits"], "barcode_strand": F.when(best["barcode"].isNotNull(), text), "n_barcodes": F.size("found"), **lists})
    return rows.drop("found", "pos", "window")


def rescued(rows: DataFrame, wanted: Column, whitelist: DataFrame, model: np.ndarray, chemistry: Chemistry) -> DataFrame:
    """rows with the barcodes that time warping finds for those wanted; by_warping marks them."""
    found = dtw.rescue(rows.where(wanted), whitelist, model, chemistry).toDF("w_id", "w_barcode", "w_strand", "w_mismatch")
    rows = rows.join(found, F.col("id") == F.col("w_id"), "left").withColumn("by_warping", F.col("w_barcode").isNotNull())
    text = F.when(F.col("w_strand") == S.FORWARD, STRANDS[S.FORWARD]).otherwise(STRANDS[S.REVERSE])
    new = {"barcode": F.coalesce("barcode", "w_barcode"), "barcode_strand": F.when(F.col("by_warping"), text).otherwise(F.col("barcode_strand")), "barcode_mismatch": F.when(F.col("by_warping"), F.col("w_mismatch")).otherwise(F.col("barcode_mismatch"))}
    return rows.withColumns(new).drop("w_id", "w_barcode", "w_strand", "w_mismatch")


def scored(rows: DataFrame) -> DataFrame:
    """Adds score: by the barcode's edits, or for warping the cost beyond the adapter's; null without a barcode."""
    score = F.when(F.col("by_warping"), F.col("barcode_mismatch")).otherwise(barcode.barcode_score(F.col("barcode_mismatch")))
    return rows.withColumn("barcode_score", F.when(F.col("barcode").isNotNull(), score)).drop("by_warping")


CALLED = ["id", "status", "polyat", "side", "outer", "inner", "barcode", "barcode_start", "barcode_strand", "barcode_mismatch", "n_barcodes", "barcodes", "barcode_starts", "barcode_mismatches", "barcode_score"]


def call(reads: DataFrame, whitelist: DataFrame, chemistry: Chemistry = Chemistry(), within: int = 100, model: np.ndarray | None = None) -> DataFrame:
    """CALLED of each read (id, seq): a call without annotation, by the adapters at its ends. Exact matches first, fuzzy ones for reads that have none;
    with a pore model, time warping for those that have neither."""
    rows = windows(located(reads, chemistry, within), chemistry)
    short = F.col("side").isin("left", "right") & F.col("window").isNull()
    rows = rows.withColumn("too_short", short)
    rows = chosen(barcode.match(rows, whitelist, chemistry.barcode, chemistry.mismatches))
    status = adapters.length_status(F.length("seq"), within, chemistry.most_length)
    for side, name in REJECTED.items():
        status = status.when(F.col("side") == side, name)
    status = status.when(F.col("too_short"), "Read_too_short").otherwise("open")
    rows = rows.withColumn("status", status)
    rows = emptied(rows, F.col("status") != "open")
    rows = rows.withColumn("by_warping", F.lit(False)) if model is None else rescued(rows, F.expr("status = 'open' and barcode is null"), whitelist, model, chemistry)
    status = F.when(F.col("status") != "open", F.col("status")).when(F.col("barcode").isNull(), "Barcode_missing").when(F.col("by_warping"), "fine_DTW").otherwise("fine")
    return scored(rows.withColumn("status", status)).select(*CALLED)


def emptied(rows: DataFrame, where: Column) -> DataFrame:
    """rows without their barcodes where a status says so."""
    single = ("barcode", "barcode_start", "barcode_strand", "barcode_mismatch")
    lists = ("barcodes", "barcode_starts", "barcode_mismatches")
    new = {c: F.when(~where, F.col(c)) for c in single} | {c: F.when(where, F.slice(c, 1, 0)).otherwise(F.col(c)) for c in lists}
    return rows.withColumns(new | {"n_barcodes": F.when(where, 0).otherwise(F.col("n_barcodes"))})


REGIONS = "array<struct<start:int,end:int>>"
HITS = "array<struct<start:int,end:int,orient:int,r_start:int,r_end:int,r_strand:int,gene_id:string,gene_name:string,transcript:string,score:int>>"


def with_annotation(reads: DataFrame, annotation: DataFrame) -> DataFrame:
    """reads with free, occupied and hits of annotation (id, free, occupied, hits); no hits where there is no annotation."""
    side = annotation.select(F.col("id").alias("a_id"), F.col("free").cast(REGIONS).alias("free"), F.col("occupied").cast(REGIONS).alias("occupied"), F.col("hits").cast(HITS).alias("hits"))
    rows = reads.join(side, F.col("id") == F.col("a_id"), "left").drop("a_id")
    return rows.withColumn("hits", F.coalesce("hits", F.array().cast(HITS)))


ANNOTATED = ["id", "parent", "status", "r1", "tso", "barcode", "barcode_start", "barcode_strand", "barcode_mismatch", "n_barcodes", "barcodes", "barcode_starts", "barcode_mismatches", "hits", "annotation", "transcript", "barcode_score", "annotation_score", "breakpoints"]


def annotated_call(reads: DataFrame, annotation: DataFrame, whitelist: DataFrame, chemistry: Chemistry = Chemistry(), model: np.ndarray | None = None) -> DataFrame:
    """ANNOTATED of each read (id, seq), and of the parts of reads with several adapters: adapters are sought in the regions that no hit occupies.

    One adapter gives the window of the barcode, and with a barcode the hits give the annotation. Reads with more are of complex structure: each
    adapter with its free region and the occupied one beside it becomes a read of its own (chimera.adapter_parts), called once more with that adapter.
    r1 and tso: array<struct<pos, strand, dist>>. Reads without hits are unmapped; those without an adapter lack a barcode, unless warping finds it."""
    rows = with_annotation(reads.select(F.col("id").cast("string").alias("id"), "seq"), annotation.withColumn("id", F.col("id").cast("string")))
    usable = (F.size("hits") > 0) & (F.length("seq") < chemistry.most_length)
    rows = rows.withColumn("free", F.when(usable, F.coalesce("free", F.array().cast(REGIONS))).otherwise(F.array().cast(REGIONS)))
    rows = S.once(rows, "r1", adapters.scan(F.col("seq"), chemistry.r1, 3 * chemistry.mismatches, F.col("free")))
    own = F.struct("id", F.lit(None).cast("string").alias("parent"), "seq", "free", "occupied", "hits", "r1")
    every = F.concat(F.array(own), chimera.adapter_parts(own))
    rows = rows.select(F.explode(every).alias("part")).select("part.*")
    rows = S.once(rows, "tso", adapters.scan(F.col("seq"), chemistry.tso, chemistry.tso_edits, F.col("free")))
    one = F.size("r1") == 1
    r1 = F.when(one, F.get("r1", F.lit(0)))
    strand = r1["strand"]
    first, last = S.window_bounds(F.col("seq"), chemistry.barcode, *adapters.kmer_window(r1["pos"], strand, chemistry))
    rows = S.once(rows, "bounds", F.struct(first.alias("first"), last.alias("last")))
    first, last = F.col("bounds.first"), F.col("bounds.last")
    there = one & (F.size("hits") > 0) & (first <= last)
    rows = rows.withColumns({"strand": strand, "pos": F.when(there, first), "window": F.when(there, F.substring(F.col("seq"), first, last - first + chemistry.barcode))})
    rows = chosen(barcode.match(rows, whitelist, chemistry.barcode, chemistry.mismatches, exact_first=False))
    status = adapters.length_status(F.length("seq"), None, chemistry.most_length).when(F.size("hits") == 0, "Read_unmapped").when(F.size("r1") > 1, "Complex_structure")
    rows = rows.withColumn("status", status.otherwise("open"))
    rows = rows.withColumn("by_warping", F.lit(False)) if model is None else rescued(rows, F.expr("status = 'open' and barcode is null"), whitelist, model, chemistry)
    missing = F.when((F.size("r1") == 0) & F.lit(model is None), "R1a_missing").otherwise("Barcode_missing")
    done = F.when(F.col("status") != "open", F.col("status")).when(F.col("barcode").isNull(), missing).when(F.col("by_warping"), "fine_DTW").otherwise("fine")
    rows = scored(rows.withColumn("status", done))
    found = F.get("r1", F.lit(0))
    choice = annotate.read_annotation(F.col("hits"), F.col("occupied"), found["pos"], found["strand"], chemistry.tech)
    rows = S.once(rows, "choice", F.when(F.col("barcode").isNotNull() & one, choice))
    rows = rows.withColumns(
        {
            "annotation": F.when(F.col("status") == "Complex_structure", adapters.complex_class(F.col("r1"))).otherwise(F.col("choice.annotation")),
            "transcript": F.col("choice.transcript"),
            "annotation_score": F.col("choice.score"),
            "breakpoints": F.coalesce("choice.breakpoints", F.array().cast("array<int>")),
        }
    )
    return rows.select(*ANNOTATED)


def annotated(called: DataFrame, annotation: DataFrame) -> DataFrame:
    """Called reads with n_hits and the annotation of least name (annotation: id, gene), or the name for none."""
    side = annotation.groupBy(F.col("id").alias("a_id")).agg(F.min("gene").alias("gene"), F.count("*").alias("n_hits"))
    rows = called.join(side, F.col("id") == F.col("a_id"), "left").drop("a_id")
    named = annotate.annotation_name(F.lit(None).cast("string"), F.col("gene"))
    return rows.withColumns({"annotation": named, "n_hits": F.coalesce("n_hits", F.lit(0)).cast("long")}).drop("gene")
