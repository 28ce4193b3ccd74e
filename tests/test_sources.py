"""Readers, writers and streams on small files."""

import gzip
import struct

import pytest

from helixframe.operators import adapters, barcode
from helixframe.operators.chemistry import R1
from helixframe.sources import bam, reports, text
from helixframe.streaming import reads as stream


def test_fastq_forms(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r1 comment\nACGT\nAC\n+\nIIII\n@I\n\n>r2\nGG\nTT\n@r3\n\n+\n\n")
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write("@ok\nAC\n+\nII\n@broken\nACG\n+\nIIIII\n@after\nA\n+\nI\n")
    rows = {r.id: (r.seq, r.qual) for r in text.read_fastq(spark, str(tmp_path)).collect()}
    assert rows == {"r1": ("ACGTAC", "IIII@I"), "r2": ("GGTT", None), "r3": ("", ""), "ok": ("AC", "II")}


def test_fastq_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("x", "ACGT", "IIII", "AAAA", "CC"), ("y", "GG", "##", "TTTT", None), ("z", "A", "I", None, None)], "id string, seq string, qual string, barcode string, umi string")
    text.write_fastq(text.called_fastq(rows), str(tmp_path / "out"))
    assert {tuple(r) for r in text.read_fastq(spark, str(tmp_path / "out")).collect()} == {("x_AAAA_CC", "ACGT", "IIII"), ("y_TTTT", "GG", "##")}


def test_whitelist(spark, tmp_path):
    (tmp_path / "w.lst").write_text("AAAACCCCGGGGTTTT\n\nACGTACGTACGTACGT\n")
    assert [tuple(r) for r in text.read_whitelist(spark, str(tmp_path / "w.lst")).collect()] == [(1, "AAAACCCCGGGGTTTT"), (2, "ACGTACGTACGTACGT")]
    (tmp_path / "w.lst").write_text("ACGT\n")
    with pytest.raises(Exception, match="16 bases"):
        text.read_whitelist(spark, str(tmp_path / "w.lst")).collect()


def test_model(spark, tmp_path):
    (tmp_path / "m").write_text("kmer\tlevel_mean\tlevel_stdv\tsd_mean\tsd_stdv\tweight\nACGTAC\t100.5\t1\t2\t3\t4\nAAAAAA\t86.5\t1\t2\t3\t4\n")
    assert {(r.code, r.level) for r in text.read_model(spark, str(tmp_path / "m")).collect()} == {(433, 10.5), (0, -3.5)}


def test_gtf(spark, tmp_path):
    line = 'chr1\tx\t{}\t1\t9\t.\t+\t.\tgene_id "G1"; gene_name "N"; transcript_id "T"; transcript_support_level "{}";'
    (tmp_path / "a.gtf").write_text("\n".join(["#x", "", *(line.format(f, t) for f, t in [("gene", 5), ("transcript", 1), ("exon", 1), ("exon", 2), ("UTR", 1), ("CDS", 1)])]))
    rows = text.read_gtf(spark, str(tmp_path / "a.gtf"))
    assert sorted(r.feature for r in rows.collect()) == ["exon", "gene", "transcript"]
    assert rows.first().gene_id == "G1" and text.read_gtf(spark, str(tmp_path / "a.gtf"), loose=True).count() == 4


SAM = [("r1", 0, "chr1", 101, "50M100N50M", ""), ("r1", 2064, "chr2", 5, "10S50M5S", "SA:Z:chr1,101,+,50M5H,60,0;"), ("r2", 4, "*", 0, "*", "")]


def test_sam_and_bam_agree(spark, tmp_path):
    body = "".join(f"{q}\t{f}\t{r}\t{p}\t60\t{c}\t*\t0\t0\t*\t*\t{t}\n" for q, f, r, p, c, t in SAM)
    (tmp_path / "a.sam").write_text("@HD\tVN:1\n" + body)
    rows = text.read_sam(spark, str(tmp_path / "a.sam")).orderBy("ord").collect()
    assert [(s.start, s.end) for s in rows[0].segments] == [(101, 150), (251, 300)] and rows[0].spliced
    assert rows[1].strand == 3 and rows[1].sa.cigar == "50M5H" and tuple(rows[1].span) == (11, 60, 65)
    assert text.mapped(text.read_sam(spark, str(tmp_path / "a.sam"))).count() == 2
    refs = ["chr1", "chr2"]
    out = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2) + b"".join(struct.pack("<i", 5) + r.encode() + b"\0" + struct.pack("<i", 999) for r in refs)
    for q, f, r, p, c, t in SAM:
        ops = [] if c == "*" else __import__("re").findall(r"(\d+)([A-Z])", c)
        tags = b"NMi" + struct.pack("<i", 1) + b"XBBc" + struct.pack("<i", 2) + b"\1\2" + (b"SAZ" + t[5:].encode() + b"\0" if t else b"")
        block = struct.pack("<iiBBHHHiiii", refs.index(r) if r in refs else -1, p - 1, len(q) + 1, 0, 0, len(ops), f, 3, -1, -1, 0) + q.encode() + b"\0"
        block += b"".join(struct.pack("<I", int(n) << 4 | "MIDNSHP=X".index(o)) for n, o in ops) + b"\x11\x10" + b"III" + tags
        out += struct.pack("<i", len(block)) + block
    with gzip.open(tmp_path / "a.bam", "wb") as f:
        f.write(out)
    found = bam.read_bam(spark, str(tmp_path / "a.bam")).orderBy("ord").collect()
    assert [(b.qname, b.flag, b.ref, b.pos, b.cigar) for b in found] == [(q, f, r, p, c) for q, f, r, p, c, _ in SAM]
    assert [b.sa for b in found] == [None, "chr1,101,+,50M5H,60,0;", None]


def test_order_of_lines(spark, tmp_path):
    """By files' names and the places within, not by the order in which files are read."""
    for name, lines in (("a", 3), ("b", 400)):
        (tmp_path / name).write_text("".join(f"{name}{i}\t{name}\n" for i in range(lines)))
    (tmp_path / "c").write_text("a1\tlast\n")
    names = {r.id: r.name for r in text.read_names(spark, str(tmp_path)).collect()}
    assert names["a1"] == "last" and names["b399"] == "b"
    rows = text.read_lines(spark, str(tmp_path)).orderBy("line").collect()
    assert [r.value.split("\t")[0] for r in rows] == [f"a{i}" for i in range(3)] + [f"b{i}" for i in range(400)] + ["a1"]


def test_summary_layouts(spark, tmp_path):
    columns = "id string, status string, outer int, inner int, polyat boolean, barcode string, barcode_start int, barcode_strand string, barcode_mismatch int, n_barcodes int, barcodes array<string>, barcode_starts array<int>, barcode_mismatches array<int>, barcode_score int"
    rows = spark.createDataFrame([("a", "fine", 3, None, True, "AC", 25, "forward", 1, 2, ["AC", "GT"], [25, 26], [1, 2], 20), ("b", "Dual_header", None, None, False, None, None, None, None, 0, [], [], [], None)], columns)
    for layout, width in ((1, 9), (2, 13), (3, 21)):
        cells = reports.summary(rows, layout)
        assert len(cells.columns) == width
        reports.write_cells(cells, str(tmp_path / f"s{layout}"))
        lines = sorted(r.value for r in spark.read.text(str(tmp_path / f"s{layout}")).collect())
        assert [len(x.split("\t")) for x in lines] == [width, width]
    assert lines[0].split("\t") == ["a", "fine", "3", "*", "AC", "25", "forward", "1", "2", "AC,GT,", "25,26,", "1,2,", "*", "*", "-1", "*", "*", "*", "20", "999999", "*"]
    assert lines[1].split("\t")[2:12] == ["-1", "*", "*", "-1", "*", "-1", "0", "*", "*", "*"]
    back = {r.read_id: r for r in reports.read_summary(spark, str(tmp_path / "s3")).collect()}
    assert (back["a"].r1_start, back["a"].barcodes, back["a"].barcode_starts, back["a"].barcode_score) == ([3], ["AC", "GT"], [25, 26], 20)
    assert (back["b"].barcode, back["b"].barcode_start, back["b"].r1_start, back["b"].breakpoints) == (None, None, [], [])
    assert reports.read_summary(spark, str(tmp_path / "s2"), 2, rows=1).count() == 1


def test_annotation_report(spark, tmp_path):
    hits = [(11, 60, 0, 1011, 1060, 3, "G1", "N1", "T1(fsm/ism=>1>2>)", 12, 0.98, 0.5, 1, [(1011, 1030), (1040, 1060)]), (55, 80, 3, 2055, 2080, 0, None, None, None, 9999, 1.0, 0.0, 0, [(2055, 2080)])]
    rows = spark.createDataFrame([("r1", [(1, 10), (81, 90)], [(11, 80)], hits, [[0, 1]]), ("r2", [(1, 90)], [], [], [])], f"id string, free {reports.REGIONS}, occupied {reports.REGIONS}, hits {reports.FULL_HITS}, groups array<array<int>>")
    cells = reports.annotation(rows)
    assert cells.columns == reports.ANNOTATION and len(cells.columns) == 16
    first = cells.where("read_id = 'r1'").first()
    assert tuple(first)[1:9] == ("G1,*", "N1,*", "forward,reverse", "1-10;81-90;", "11-60;55-80;", "0.980000,1.000000", "1011-1060;2055-2080;", "0.500000,0.000000")
    assert tuple(first)[9:] == ("0,1", "11-80;", "1,0", "1011-1030,1040-1060;2055-2080", "T1(fsm/ism=>1>2>),*", "reverse,forward", "12,9999")
    reports.write_cells(cells, str(tmp_path / "a"))
    back = reports.read_annotation(spark, str(tmp_path / "a"))
    assert sorted(back.collect(), key=lambda r: r.id) == sorted(rows.collect(), key=lambda r: r.id)
    reports.write_cells(cells, str(tmp_path / "a"), mode="append")
    assert reports.read_annotation(spark, str(tmp_path / "a")).count() == 4


def test_tables(spark, tmp_path):
    (tmp_path / "m").write_text("x_AC\t10\tg\t-1\t3\th\t4\nx_AC\t-1\tg\t2\t3\th\t4\n")
    assert [tuple(r) for r in reports.read_mapping(spark, str(tmp_path / "m")).collect()] == [("x", 0, 2, 3, 4)]
    (tmp_path / "i").write_text("sequence_id\tlocus\tv_identity\tj_identity\ns1\tIGH\t91.5\tNA\ns2\tNA\tx\t80\n")
    rows = reports.read_igblast(spark, str(tmp_path / "i")).collect()
    assert [(r.locus, r.v_identity, r.j_identity) for r in rows] == [("IGH", 91.5, None), (None, None, 80.0)] and reports.read_igblast(spark, str(tmp_path / "i"), rows=1).count() == 1
    (tmp_path / "c").write_text("c1\ta\t7\tb\tc\td\tYes\n")
    assert tuple(reports.read_clone_summary(spark, str(tmp_path / "c")).first()) == ("c1", 7, "Yes") and reports.read_clone_reads(spark, str(tmp_path / "c")).first().reads == "Yes"


def test_status_report(spark, tmp_path):
    reads = spark.createDataFrame([("a", "GA" + "A" * 13 + R1 + "CC"), ("b", "ACGT")], "id string, seq string")
    reports.write_cells(adapters.census(reads), str(tmp_path / "s"), header=True)
    lines = [r.value for r in spark.read.text(str(tmp_path / "s")).collect()]
    assert sum(x.startswith("read_id\tlength\tnum_polya\tnum_polyt\tnum_r1") for x in lines) >= 1
    assert "b\t4\t0\t0\t0\t*\t*\t0\t*\t*" in lines and any(x.startswith("a\t39\t1\t0\t1\t14\t1\t") for x in lines)


def test_stream_equals_batch(spark, tmp_path):
    white = spark.createDataFrame([(1, "AAAACCCCGGGGTTTT"), (2, "ACGTACGTACGTACGA")], "ordinal int, barcode string")
    (tmp_path / "in").mkdir()
    for i, b in enumerate(["AAAACCCCGGGGTTTT", "ACGTACGTACGTACGA", "GGGGGGGGGGGGGGGG"]):
        (tmp_path / "in" / f"{i}.fastq").write_text(f"@r{i}\nTT{b}GG\n+\n{'I' * 20}\n")
    call = lambda part: barcode.exact_matches(barcode.read_kmers(part, 16), white)
    for _ in range(2):  # the second run finds nothing new
        stream.write_once(stream.fastq_stream(spark, str(tmp_path / "in")), call, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    want = call(text.read_fastq(spark, str(tmp_path / "in")))
    assert sorted(got.collect()) == sorted(want.collect()) and got.select("id").distinct().count() == 2
    assert stream.not_done(text.read_fastq(spark, str(tmp_path / "in")), got).select("id").collect()[0].id == "r2"
    (tmp_path / "in" / "00.fastq").write_text(f"@late\nAAAACCCCGGGGTTTT\n+\n{'I' * 16}\n")  # a name before those read already
    stream.write_once(stream.fastq_stream(spark, str(tmp_path / "in")), call, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).select("id").distinct().count() == 3



def test_flush_on_change(spark, tmp_path):
    """A read's alignments are folded when the next read of the file begins, over the borders of batches; a null key ends the file."""
    import pandas as pd

    schema = "file string, qname string, ord int"
    batches = [[("f", "a", 1), ("f", "a", 2), ("g", "x", 1)], [("f", "a", 3), ("f", "b", 4), ("g", "y", 2)], [("f", None, 9), ("g", "y", 3), ("g", None, 9)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
        fold = lambda part: pd.DataFrame({"qname": [part["qname"].iloc[0]], "n": [len(part)]})
        found = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
        stream.write_once(stream.flush_on_change(found, fold, "qname string, n long"), lambda df: df, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert {(r.qname, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 3), ("b", 1), ("x", 1), ("y", 2)}
