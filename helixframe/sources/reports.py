"""Tab-separated reports as typed tables: the read summary in three layouts, annotations of reads, split reports, mapping statistics, clone tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import codec as C
from helixframe.operators.calls import HITS, REGIONS

UNUSABLE = 999999
# The columns of the summary's layouts.
SUMMARY = {
    3: "read_id status r1_start r1_strand barcode barcode_start barcode_strand barcode_mismatch n_barcodes barcodes barcode_starts barcode_mismatches hit_regions hit_orientations tso_pos tso_strand annotation transcript barcode_score annotation_score breakpoints".split(),
    2: "read_id status outer barcode barcode_start inner barcode_strand barcode_mismatch polyat n_barcodes barcodes barcode_starts barcode_mismatches".split(),
    1: "read_id status outer barcode barcode_start inner barcode_strand barcode_mismatch polyat".split(),
}
ANNOTATION = "read_id gene_ids gene_names orientations free_regions hit_regions hit_coverages reference_regions gene_coverages hit_groups occupied_regions spliced segments transcripts hit_strands scores".split()
SPLIT = "read_id children barcode_start cut verdict".split()


def column(rows: DataFrame, name: str, kind: str) -> Column:
    """The column, or nulls where rows lack it."""
    return F.col(name) if name in rows.columns else F.lit(None).cast(kind)


def listed(values: Column) -> Column:
    """Each value with a comma behind it; the missing mark for none."""
    text = F.concat_ws("", F.transform(values, lambda x: F.concat(x.cast("string"), F.lit(","))))
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, text).otherwise(C.MISSING)


def summary(rows: DataFrame, layout: int = 3) -> DataFrame:
    """The summary's cells, as strings, of called reads (calls.call or calls.annotated_call); -1 for places that are missing."""
    whole = lambda name, none: F.coalesce(column(rows, name, "int"), F.lit(none))
    hits_of = "array<struct<pos:int,strand:int,dist:int>>"

    def places(hits: str, single: str) -> tuple[Column, Column]:
        several = column(rows, hits, hits_of)
        there = F.coalesce(F.size(several), F.lit(0)) > 0
        joined = F.array_join(F.transform(several, lambda h: h["pos"].cast("string")), ",")
        strands = F.array_join(F.transform(several, lambda h: C.strand_text(h["strand"])), ",")
        return F.when(there, joined).otherwise(whole(single, -1).cast("string")), F.when(there, strands).otherwise(C.MISSING)

    (r1, r1_strand), (tso, tso_strand) = places("r1", "outer"), places("tso", "inner")
    hits = column(rows, "hits", HITS)
    empty = F.coalesce(F.size(hits), F.lit(0)) == 0
    regions = F.array_join(F.transform(hits, lambda h: F.concat(h["start"].cast("string"), F.lit("-"), h["end"].cast("string"))), ";")
    orient = F.array_join(F.transform(hits, lambda h: C.strand_text(h["orient"])), ",")
    points = column(rows, "breakpoints", "array<int>")
    cells = {
        "read_id": F.col("id"),
        "status": F.col("status"),
        "r1_start": r1,
        "r1_strand": r1_strand,
        "outer": whole("outer", -1),
        "inner": whole("inner", -1),
        "barcode": F.coalesce(F.col("barcode"), F.lit(C.MISSING)),
        "barcode_start": whole("barcode_start", -1),
        "barcode_strand": F.coalesce(F.col("barcode_strand"), F.lit(C.MISSING)),
        "barcode_mismatch": whole("barcode_mismatch", -1),
        "polyat": F.coalesce(column(rows, "polyat", "boolean").cast("int"), F.lit(0)),
        "n_barcodes": F.col("n_barcodes"),
        **{c: listed(F.col(c)) for c in ("barcodes", "barcode_starts", "barcode_mismatches")},
        "hit_regions": F.when(empty, C.MISSING).otherwise(regions),
        "hit_orientations": F.when(empty, C.MISSING).otherwise(orient),
        "tso_pos": tso,
        "tso_strand": tso_strand,
        "annotation": F.coalesce(column(rows, "annotation", "string"), F.lit(C.MISSING)),
        "transcript": F.coalesce(column(rows, "transcript", "string"), F.lit(C.MISSING)),
        "barcode_score": whole("barcode_score", UNUSABLE),
        "annotation_score": whole("annotation_score", UNUSABLE),
        "breakpoints": F.when(F.coalesce(F.size(points), F.lit(0)) == 0, C.MISSING).otherwise(C.joined(points, ",")),
    }
    return rows.select(*(cells[c].cast("string").alias(c) for c in SUMMARY[layout]))


def read_summary(spark: SparkSession, path: str, layout: int = 3, rows: int | None = None) -> DataFrame:
    """The summary with whole numbers, lists and nulls; places that are missing are null. rows: read so many at most."""
    df = read_cells(spark, path, SUMMARY[layout], rows=rows)
    here = [c for c in SUMMARY[layout] if c in ("outer", "inner", "barcode_start", "barcode_mismatch")]
    new = {c: F.when(F.col(c).cast("int") >= 0, F.col(c).cast("int")) for c in here}
    new |= {c: F.col(c).cast("int") for c in ("polyat", "n_barcodes", "barcode_score", "annotation_score") if c in df.columns}
    new |= {c: C.integers(F.coalesce(c, F.lit(""))) for c in ("barcode_starts", "barcode_mismatches", "breakpoints") if c in df.columns}
    new |= {c: F.filter(C.integers(F.coalesce(c, F.lit(""))), lambda x: x >= 0) for c in ("r1_start", "tso_pos") if c in df.columns}
    new |= {c: C.tokens(F.coalesce(c, F.lit("")), ",") for c in ("barcodes", "r1_strand", "tso_strand", "hit_orientations") if c in df.columns}
    new |= {c: C.signed_regions(F.coalesce(c, F.lit(""))) for c in ("hit_regions",) if c in df.columns}
    return df.withColumns(new)


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, as tables that are filled row by row keep it."""
    others = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("row")).select(key, "row.*")


FULL_HITS = HITS[: -len(">>")] + ",covered:double,gene_covered:double,spliced:int,segments:array<struct<start:int,end:int>>>>"


def annotation(rows: DataFrame) -> DataFrame:
    """The cells of the annotation of reads (id, free, occupied, hits: FULL_HITS, groups: array<array<int>>)."""
    each = lambda f, by=",": F.array_join(F.transform("hits", f), by)
    named = lambda c: lambda h: F.coalesce(h[c].cast("string"), F.lit(C.MISSING))
    span = lambda r, a="start", b="end": F.concat(r[a].cast("string"), F.lit("-"), r[b].cast("string"))
    closed = lambda c: F.concat_ws("", F.transform(c, lambda r: F.concat(span(r), F.lit(";"))))
    share = lambda c: lambda h: F.format_string("%.6f", h[c])
    none = F.size("hits") == 0
    free = F.when(F.size("free") == 0, "-1--1;").otherwise(closed("free"))
    cells = {
        "read_id": F.col("id"),
        "gene_ids": each(named("gene_id")),
        "gene_names": each(named("gene_name")),
        "orientations": each(lambda h: C.strand_text(h["orient"])),
        "free_regions": free,
        "hit_regions": each(lambda h: F.concat(span(h), F.lit(";")), ""),
        "hit_coverages": each(share("covered")),
        "reference_regions": each(lambda h: F.concat(span(h, "r_start", "r_end"), F.lit(";")), ""),
        "gene_coverages": each(share("gene_covered")),
        "hit_groups": C.hit_groups_text(F.col("groups")),
        "occupied_regions": closed("occupied"),
        "spliced": each(named("spliced")),
        "segments": each(lambda h: F.array_join(F.transform(h["segments"], lambda r: span(r)), ","), ";"),
        "transcripts": each(named("transcript")),
        "hit_strands": each(lambda h: C.strand_text(h["r_strand"])),
        "scores": each(named("score")),
    }
    always = ("read_id", "free_regions", "hit_groups")
    return rows.select(*((v if c in always else F.when(none, C.MISSING).otherwise(v)).cast("string").alias(c) for c, v in cells.items()))


def read_annotation(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """id, free, occupied, hits (FULL_HITS) and groups, as calls.annotated_call() and annotation() take them."""
    df = read_cells(spark, path, ANNOTATION, rows=rows, null=None)
    own = lambda c: F.when(F.col(c) == C.MISSING, "").otherwise(F.coalesce(c, F.lit("")))
    names = lambda c: F.transform(C.tokens(own(c), ","), lambda x: F.when(x != C.MISSING, x))
    strands = lambda c: F.transform(C.tokens(own(c), ","), lambda x: C.strand_code(x))
    lists = {
        "place": C.signed_regions(own("hit_regions")),
        "orient": strands("orientations"),
        "reference": C.signed_regions(own("reference_regions")),
        "r_strand": strands("hit_strands"),
        "gene_id": names("gene_ids"),
        "gene_name": names("gene_names"),
        "transcript": names("transcripts"),
        "score": C.integers(own("scores")),
        "covered": C.coverages(own("hit_coverages")),
        "gene_covered": C.coverages(own("gene_coverages")),
        "spliced": C.integers(own("spliced")),
        "segments": F.transform(C.tokens(own("segments"), ";"), C.regions),
    }
    both = F.arrays_zip(*(v.alias(c) for c, v in lists.items()))
    kept = ("orient", "r_strand", "gene_id", "gene_name", "transcript", "score", "covered", "gene_covered", "spliced", "segments")

    def hit(z: Column) -> Column:
        at = {c: z[c] for c in kept}
        first = [z["place"]["start"].alias("start"), z["place"]["end"].alias("end"), at["orient"].alias("orient"), z["reference"]["start"].alias("r_start"), z["reference"]["end"].alias("r_end"), at["r_strand"].alias("r_strand")]
        return F.struct(*first, *(at[c].alias(c) for c in kept if c not in ("orient", "r_strand")))

    hits = F.filter(F.transform(both, hit), lambda h: h["start"].isNotNull()).cast(FULL_HITS)
    return df.select(F.col("read_id").alias("id"), C.signed_regions(own("free_regions")).cast(REGIONS).alias("free"), C.signed_regions(own("occupied_regions")).cast(REGIONS).alias("occupied"), hits.alias("hits"), C.hit_groups(F.col("hit_groups")).alias("groups"))


def read_mapping(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """read, c0 to c3 of the mapping statistics: the clips of an alignment and of the one it names, 0 where there are none; the last row of each read."""
    cells = ["read", "l0", "g0", "r0", "l1", "g1", "r1"]
    df = read_cells(spark, path, cells, rows=rows).withColumn("line", F.monotonically_increasing_id())
    clips = [F.greatest(F.col(c).cast("int"), F.lit(0)).alias(f"c{i}") for i, c in enumerate(("l0", "r0", "l1", "r1"))]
    return last_of(df.select(F.split("read", "_")[0].alias("read"), *clips, "line"), "read", "line")


def read_table(spark: SparkSession, path: str, types: dict[str, str], header: bool = True, rows: int | None = None) -> DataFrame:
    """A table with a header, all strings but for types; NA and empty cells are null. Without header columns are V1, V2 and so on."""
    df = spark.read.csv(path, sep="\t", header=header, nullValue="NA", quote="")
    df = df if header else df.toDF(*(f"V{i + 1}" for i in range(len(df.columns))))
    df = df.withColumns({c: F.expr(f"try_cast(`{c}` as {t})") for c, t in types.items() if c in df.columns})
    return df if rows is None else df.limit(rows)


def read_igblast(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """The annotation of immune sequences, with v_identity and j_identity as numbers."""
    return read_table(spark, path, {"v_identity": "double", "j_identity": "double"}, rows=rows)


def read_clone_summary(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """clone, n, productive."""
    return read_table(spark, path, {}, header=False, rows=rows).selectExpr("V1 as clone", "cast(V3 as long) as n", "V7 as productive")


def read_clone_reads(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """clone, reads (comma-separated)."""
    return read_table(spark, path, {}, header=False, rows=rows).selectExpr("V1 as clone", "V7 as reads")


def write_cells(rows: DataFrame, path: str, header: bool = False, mode: str = "error") -> None:
    """Tab-separated text of strings; nulls get the missing mark. mode append adds to a report that is there."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit(C.MISSING)).alias(c) for c in rows.columns]
    rows.select(*cells).write.mode(mode).csv(path, sep="\t", header=header, quote="", escape="", emptyValue="")


def read_cells(spark: SparkSession, path: str, columns: list[str], header: bool = False, rows: int | None = None, null: str | None = C.MISSING) -> DataFrame:
    """The same as strings, with nulls for the missing mark. rows: read so many at most."""
    options = {} if null is None else {"nullValue": null}
    df = spark.read.csv(path, sep="\t", header=header, schema=", ".join(f"`{c}` string" for c in columns), quote="", **options)
    return df if rows is None else df.limit(rows)
