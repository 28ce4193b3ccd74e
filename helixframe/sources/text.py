"""Readers and writers of the text formats: FASTQ and FASTA, whitelists, pore models, GTF and SAM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions import codec as C
from helixframe.functions import sequence as S
from helixframe.operators.barcode import checked_whitelist


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """id, seq, qual of FASTQ or FASTA files, plain or gzip, with records over any number of lines. The first broken record of a file ends it."""
    from helixframe.sources.fastq import FastqSource

    spark.dataSource.register(FastqSource)
    return spark.read.format("hf_fastq").load(path)


def write_fastq(rows: DataFrame, path: str) -> None:
    """rows: id, seq, qual; gzip files of four lines a record."""
    rows.select(F.concat_ws("\n", F.concat(F.lit("@"), "id"), "seq", F.lit("+"), "qual").alias("value")).write.text(path, compression="gzip")


def called_fastq(rows: DataFrame) -> DataFrame:
    """Reads with a barcode for write_fastq(), named id_barcode, or id_barcode_umi where there is a UMI. rows: id, seq, qual, barcode, umi."""
    return rows.where(F.col("barcode").isNotNull()).select(F.concat_ws("_", F.col("id").cast("string"), "barcode", "umi").alias("id"), "seq", "qual")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, and line: struct<file, block, line>, by which lines stand in the order of files' names and of their places within."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select("value", place.alias("line"))


def read_whitelist(spark: SparkSession, path: str, length: int = 16) -> DataFrame:
    """ordinal (from 1, in file order), barcode. A whitelist is one sorted partition while it is numbered; it has some million lines at most."""
    lines = read_lines(spark, path).select("line", F.trim("value").alias("barcode")).where("barcode <> ''")
    numbered = lines.select(F.row_number().over(Window.orderBy("line")).alias("ordinal"), "barcode")
    return checked_whitelist(numbered, length)


def read_model(spark: SparkSession, path: str, shift: float = 90.0) -> DataFrame:
    """code, kmer, level (mean less shift), stdv, sd_mean, sd_stdv of a pore model; rows are found by their k-mer, not by their place."""
    schema = "kmer string, level_mean double, level_stdv double, sd_mean double, sd_stdv double, weight double"
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema)
    return rows.select(S.kmer_code(F.col("kmer")).alias("code"), "kmer", (F.col("level_mean") - shift).alias("level"), F.col("level_stdv").alias("stdv"), "sd_mean", "sd_stdv")


def attribute(name: str) -> Column:
    """A GTF attribute by its name; null if it isn't there."""
    found = F.regexp_extract("attributes", name + ' "([^"]*)"', 1)
    return F.when(found != "", found)


# Features that carry no exon structure of their own.
SKIPPED = ("Selenocysteine", "start_codon", "stop_codon", "UTR")


def read_gtf(spark: SparkSession, path: str, loose: bool = False) -> DataFrame:
    """feature (gene, transcript, exon), chrom, start, end, strand and names; transcripts and exons of support level 1 only, unless loose."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    cells = F.split("value", "\t")
    rows = lines.select(F.get(cells, F.lit(2)).alias("feature"), F.get(cells, F.lit(0)).alias("chrom"), F.get(cells, F.lit(3)).cast("int").alias("start"), F.get(cells, F.lit(4)).cast("int").alias("end"), F.get(cells, F.lit(6)).alias("strand"), F.get(cells, F.lit(8)).alias("attributes"))
    rows = rows.where(~F.col("feature").isin(*SKIPPED) & F.col("feature").isin("gene", "transcript", "exon"))
    names = {n: attribute(n) for n in ("gene_id", "gene_name", "gene_type", "transcript_id", "transcript_name", "exon_id", "transcript_support_level")}
    rows = rows.withColumns(names).drop("attributes")
    return rows if loose else rows.where((F.col("feature") == "gene") | (F.col("transcript_support_level") == "1"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """ord (rising in file order), qname, flag, ref, pos, cigar, strand, sa (struct), spliced, segments, span of each line but the header."""
    lines = read_lines(spark, path).select(F.col("line").alias("ord"), "value").where(~F.col("value").startswith("@"))
    cells = F.split("value", "\t")
    at = lambda i: F.get(cells, F.lit(i))
    rows = lines.select("ord", at(0).alias("qname"), at(1).cast("int").alias("flag"), at(2).alias("ref"), at(3).cast("int").alias("pos"), at(5).alias("cigar"), C.supplementary(F.col("value")).alias("sa"))
    mapped = F.col("flag").bitwiseAND(4) == 0
    return rows.select(
        "*",
        F.when(F.col("flag").bitwiseAND(16) > 0, S.REVERSE).otherwise(S.FORWARD).alias("strand"),
        F.col("cigar").contains("N").alias("spliced"),
        F.when(mapped, C.cigar_segments(F.col("cigar"), F.col("pos"))).alias("segments"),
        F.when(mapped, C.query_span(F.col("cigar"))).alias("span"),
    )


def mapped(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("flag").bitwiseAND(4) == 0) & (F.col("ref") != C.MISSING))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """id, name; of repeated ids the last."""
    cells = F.split("value", "\t")
    rows = read_lines(spark, path).where("value <> ''").select(cells[0].alias("id"), F.get(cells, F.lit(1)).alias("name"), "line")
    return rows.groupBy("id").agg(F.max_by("name", "line").alias("name"))
