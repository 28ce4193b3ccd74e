"""Queries on adapters, barcodes and calls of reads whose adapters have edits; their SQL finds everything from the sequences alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import codec as C
from helixframe.functions import distance as D
from helixframe.functions import sequence as S
from helixframe.operators import adapters, annotate, barcode, calls, clones
from helixframe.operators.chemistry import R1, TSO, Chemistry, reverse_complement
from helixframe.plans import fixtures as X
from helixframe.plans.registry import query
from helixframe.sources import reports

WITHIN = 60


def tail_free(a: str, b: str, n: int, m: int, k: int) -> str:
    """End-free distance of two words of n and m letters in SQL."""
    ways = [f"levenshtein({a}, {b})"] + [f"levenshtein(left({a}, {n - t}), {b})" for t in range(1, k + 1)] + [f"levenshtein({a}, left({b}, {m - t}))" for t in range(1, k + 1)]
    return f"least({', '.join(ways)})"


def near(word: str, k: int, seq: str = "substring(seq, p, {n})") -> str:
    n = len(word)
    return tail_free(seq.format(n=n), f"'{word}'", n, n, k)


def end_ctes(name: str, word: str, k: int, source: str = "noisy", within: int = WITHIN) -> str:
    """name_l and name_r (id, pos, dist): the best place of a word in the first bases, and of its reverse complement in the last."""
    n, back = len(word), reverse_complement(word)
    last = f"least({within}, length(seq)) - {n - 2}"
    return (
        f", {name}_l AS (SELECT id, pos, dist FROM (SELECT id, p AS pos, {near(word, k)} AS dist, row_number() OVER (PARTITION BY id ORDER BY {near(word, k)}, CASE WHEN {near(word, k)} = 0 THEN p ELSE -p END) AS r FROM {source}, unnest(range(1, {last})) AS t(p)) WHERE r = 1 AND dist <= {k})"
        f", {name}_r AS (SELECT id, pos, dist FROM (SELECT id, p AS pos, {near(back, k)} AS dist, row_number() OVER (PARTITION BY id ORDER BY {near(back, k)}, p DESC) AS r FROM {source}, unnest(range(greatest(length(seq) - {within}, 0) + 1, length(seq) - {n - 2})) AS t(p)) WHERE r = 1 AND dist <= {k})"
    )


LOCAL_SQL = f""", w AS (SELECT id, p AS pos, {near(TSO, 3)} AS dist FROM noisy, unnest(range(1, length(seq) - {len(TSO) - 2})) AS t(p)),
b AS (SELECT id, pos, dist, row_number() OVER (PARTITION BY id ORDER BY dist, pos DESC) AS r FROM w WHERE dist <= 3)
SELECT noisy.id, CAST(b.pos AS INT) AS pos, CAST(b.dist AS INT) AS dist FROM noisy LEFT JOIN b ON b.id = noisy.id AND b.r = 1"""


@query(X.sql("noisy").rstrip() + LOCAL_SQL)
def local_align(spark: SparkSession, d: str) -> DataFrame:
    return X.frame(spark, d, "noisy").select("id", D.best_place(TSO, F.col("seq"), 3).alias("b")).select("id", "b.pos", "b.dist")


@query(X.sql("noisy").rstrip() + end_ctes("r1", R1, 6) + " SELECT noisy.id, CAST(r1_l.pos AS INT) AS left_pos, CAST(r1_r.pos AS INT) AS right_pos FROM noisy LEFT JOIN r1_l ON r1_l.id = noisy.id LEFT JOIN r1_r ON r1_r.id = noisy.id")
def adapter_ends(spark: SparkSession, d: str) -> DataFrame:
    rows = X.frame(spark, d, "noisy").select("id", adapters.ends(F.col("seq"), R1, WITHIN, 6).alias("e"))
    return rows.select("id", F.col("e.left").alias("left_pos"), F.col("e.right").alias("right_pos"))


def scan_ctes(word: str, k: int, source: str = "noisy") -> str:
    """hit (id, pos, strand, dist): both strands at once, by the closest so far and the next that counts."""
    n, back = len(word), reverse_complement(word)
    return f""", sw AS (SELECT id, p AS pos, {near(word, k)} AS fd, {near(back, k)} AS bd FROM {source}, unnest(range(1, length(seq) - {n - 2})) AS t(p)),
sn AS (SELECT id, pos, least(fd, bd) AS dist, CASE WHEN bd < fd THEN 3 ELSE 0 END AS strand FROM sw WHERE least(fd, bd) <= {k}),
sc AS (SELECT *, min(dist) OVER (PARTITION BY id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS closest FROM sn),
sl AS (SELECT *, lead(pos) OVER (PARTITION BY id ORDER BY pos) AS nxt FROM sc WHERE dist <= closest),
hit AS (SELECT id, pos, strand, dist FROM sl WHERE nxt IS NULL OR nxt - pos >= {n})"""


@query(X.sql("noisy").rstrip() + scan_ctes(R1, 4) + " SELECT id, CAST(strand AS INT) AS strand, CAST(pos AS INT) AS pos, CAST(dist AS INT) AS dist FROM hit")
def adapter_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = X.frame(spark, d, "noisy").select("id", F.explode(adapters.scan(F.col("seq"), R1, 4)).alias("h"))
    return rows.select("id", "h.strand", "h.pos", "h.dist")


SUMMARY_SQL = """, s AS (SELECT id, string_agg(CAST(pos AS STRING), ',' ORDER BY pos) AS p, string_agg(CASE WHEN strand = 0 THEN 'forward' ELSE 'reverse' END, ',' ORDER BY pos) AS t, string_agg(CAST(dist AS STRING), ',' ORDER BY pos) AS e FROM hit GROUP BY id)
SELECT noisy.id, coalesce(p || ':' || t || ':' || e, '*') AS places FROM noisy LEFT JOIN s USING (id)"""


@query(X.sql("noisy").rstrip() + scan_ctes(R1, 2) + SUMMARY_SQL)
def adapter_summary(spark: SparkSession, d: str) -> DataFrame:
    """Places, strands and edits of all adapters of a read, as one text."""
    return X.frame(spark, d, "noisy").select("id", C.adapter_text(adapters.scan(F.col("seq"), R1, 2)).alias("places"))


def jump_ctes(name: str, word: str, k: int) -> str:
    """name (id, n, places, strands): windows near to a word or its reverse complement, going on behind each."""
    n, back = len(word), reverse_complement(word)
    return f""", {name}_w AS (SELECT id, p, CASE WHEN {near(word, k)} <= {k} THEN 1 WHEN {near(back, k)} <= {k} THEN -1 END AS way FROM noisy, unnest(range(1, length(seq) - {n - 2})) AS t(p)),
{name}_n AS (SELECT id, list(struct_pack(p := p, way := way) ORDER BY p) AS xs FROM {name}_w WHERE way IS NOT NULL GROUP BY id),
{name}_j(id, xs, p, way, i) AS (SELECT id, xs, xs[1].p, xs[1].way, 1 FROM {name}_n UNION ALL
 SELECT j.id, j.xs, list_filter(j.xs, lambda x: x.p >= j.p + {n})[1].p, list_filter(j.xs, lambda x: x.p >= j.p + {n})[1].way, j.i + 1 FROM {name}_j j WHERE list_filter(j.xs, lambda x: x.p >= j.p + {n})[1].p IS NOT NULL),
{name} AS (SELECT id, count(*) AS n, string_agg(CAST(p AS STRING), ',' ORDER BY i) AS places, string_agg(CAST(way AS STRING), ',' ORDER BY i) AS strands FROM {name}_j GROUP BY id)"""


CENSUS_SQL = """ SELECT noisy.id AS read_id, CAST(length(seq) AS INT) AS length, CAST(len(regexp_extract_all(seq, '[GCT]A{13}')) AS INT) AS num_polya, CAST(len(regexp_extract_all(seq, '[GCA]T{13}')) AS INT) AS num_polyt,
CAST(coalesce(r.n, 0) AS INT) AS num_r1, coalesce(r.places, '*') AS r1_indices, coalesce(r.strands, '*') AS r1_strand, CAST(coalesce(s.n, 0) AS INT) AS num_tso, coalesce(s.places, '*') AS tso_indices, coalesce(s.strands, '*') AS tso_strand
FROM noisy LEFT JOIN r USING (id) LEFT JOIN s ON s.id = noisy.id"""


@query(X.sql("noisy").rstrip().replace("WITH", "WITH RECURSIVE", 1) + jump_ctes("r", R1, 2) + jump_ctes("s", TSO, 1) + CENSUS_SQL)
def read_census(spark: SparkSession, d: str) -> DataFrame:
    """The read status report: runs of A and T, R1 within two edits and the template-switch oligo within one, on both strands."""
    return adapters.census(X.frame(spark, d, "noisy"))


def side_ctes(source: str = "noisy", x: str = "") -> str:
    """The call's tables, their names begun by x: places at both ends, the side, and f with the first place of the window of twelve k-mers (f0)."""
    return (
        end_ctes(f"{x}r1", R1, 7, source)
        + end_ctes(f"{x}ts", TSO, 2, source)
        + f""", {x}e AS (SELECT a.id, seq, length(seq) AS n, CASE WHEN seq LIKE '%AAAAAAAAAA%' AND seq NOT LIKE '%TTTTTTTTTT%' THEN 'left' WHEN seq LIKE '%TTTTTTTTTT%' AND seq NOT LIKE '%AAAAAAAAAA%' THEN 'right' END AS known,
 {x}r1_l.pos AS ol, {x}r1_r.pos AS orr, {x}ts_l.pos AS il, {x}ts_r.pos AS ir FROM {source} a LEFT JOIN {x}r1_l ON {x}r1_l.id = a.id LEFT JOIN {x}r1_r ON {x}r1_r.id = a.id LEFT JOIN {x}ts_l ON {x}ts_l.id = a.id LEFT JOIN {x}ts_r ON {x}ts_r.id = a.id),
{x}c AS (SELECT *, concat(CASE WHEN il IS NULL THEN '0' ELSE '1' END, CASE WHEN ol IS NULL THEN '0' ELSE '1' END, CASE WHEN ir IS NULL THEN '0' ELSE '1' END, CASE WHEN orr IS NULL THEN '0' ELSE '1' END) AS code FROM {x}e),
{x}d AS (SELECT *, CASE WHEN known = 'left' THEN CASE WHEN ol IS NULL AND il IS NULL THEN 'none' WHEN ol > il THEN 'wrong' ELSE 'left' END WHEN known = 'right' THEN CASE WHEN orr IS NULL AND ir IS NULL THEN 'none' WHEN ir > orr THEN 'wrong' ELSE 'right' END
 WHEN code = '0000' THEN 'none' WHEN code IN ('0101', '1001', '0110', '1010') THEN 'both' WHEN code IN ('0100', '1000') THEN 'left' WHEN code IN ('0001', '0010') THEN 'right'
 WHEN code IN ('1100', '1101', '1110') THEN CASE WHEN ol <= il THEN 'left' ELSE 'wrong' END WHEN code IN ('0011', '0111', '1011') THEN CASE WHEN ir <= orr THEN 'right' ELSE 'wrong' END
 WHEN il < ol AND ir < orr THEN 'right' WHEN il > ol AND ir > orr THEN 'left' ELSE 'both' END AS side FROM {x}c),
{x}s AS (SELECT *, CASE side WHEN 'left' THEN 0 WHEN 'right' THEN 3 END AS strand, CASE side WHEN 'left' THEN ol WHEN 'right' THEN orr END AS outer_, CASE side WHEN 'left' THEN il WHEN 'right' THEN ir END AS inner_ FROM {x}d),
{x}f AS (SELECT *, CASE WHEN outer_ IS NOT NULL THEN CASE WHEN strand = 0 THEN outer_ + 16 ELSE outer_ - 22 END WHEN strand = 0 THEN CASE WHEN inner_ - 32 >= 1 THEN inner_ - 32 END WHEN inner_ + 44 <= n THEN inner_ + 17 END AS f0 FROM {x}s)"""
    )


WORDS = ", words AS (SELECT ordinal, barcode, 0 AS w_strand, barcode AS word FROM whitelist UNION ALL SELECT ordinal, barcode, 3, translate(reverse(barcode), 'ACGT', 'TGCA') FROM whitelist)"


def kmer_ctes(x: str = "") -> str:
    """k (id, strand, pos, kmer), and x with those that equal a word of their strand."""
    return f""", {x}k AS (SELECT id, strand, t.p AS pos, substring(seq, t.p, 16) AS kmer FROM {x}f, unnest(range(greatest(f0, 1), least(f0 + 11, n - 15) + 1)) AS t(p) WHERE f0 IS NOT NULL),
{x}x AS (SELECT id, pos, strand, ordinal, barcode FROM {x}k JOIN words ON kmer = word AND strand = w_strand)"""


SEED = ((1, 6), (7, 5), (12, 5))


def fuzzy_ctes(name: str, kmers: str) -> str:
    """name (id, pos, strand, ordinal, barcode, edits) of k-mers that share a segment with a word and are within two edits of it."""
    pairs = " UNION ".join(f"SELECT id, pos, kmer, ordinal, barcode, strand, word FROM {kmers} JOIN words ON strand = w_strand AND substring(kmer, {s}, {n}) = substring(word, {s}, {n})" for s, n in SEED)
    return f", {name}_c AS ({pairs}), {name} AS (SELECT * FROM (SELECT id, pos, strand, ordinal, barcode, {tail_free('kmer', 'word', 16, 16, 2)} AS edits FROM {name}_c) WHERE edits <= 2)"


WINDOWS = X.sql("noisy", "whitelist").rstrip() + side_ctes() + WORDS + kmer_ctes()


def window_kmers(spark: SparkSession, d: str) -> DataFrame:
    rows = calls.windows(calls.located(X.frame(spark, d, "noisy"), within=WITHIN)).where("window is not null")
    kmers = rows.select("id", "strand", F.col("pos").alias("first"), F.explode(S.kmers(F.col("window"), 16)).alias("w"))
    return kmers.select("id", "strand", (F.col("first") + F.col("w.pos") - 1).cast("int").alias("pos"), "w.kmer")


@query(WINDOWS + " SELECT id, CAST(pos AS INT) AS pos, CAST(strand AS INT) AS strand, ordinal, barcode FROM x")
def barcode_exact(spark: SparkSession, d: str) -> DataFrame:
    return barcode.exact_matches(window_kmers(spark, d), barcode.checked_whitelist(X.frame(spark, d, "whitelist")))


@query(WINDOWS + fuzzy_ctes("z", "k") + " SELECT id, CAST(pos AS INT) AS pos, CAST(strand AS INT) AS strand, ordinal, barcode, CAST(edits AS INT) AS edits FROM z")
def barcode_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return barcode.fuzzy_matches(window_kmers(spark, d), barcode.checked_whitelist(X.frame(spark, d, "whitelist")), 16, 2)


def match_ctes(x: str = "") -> str:
    """b: exact matches, and fuzzy ones of reads that have none, each barcode of a read once, numbered by n; bl: their lists."""
    return f", {x}l AS (SELECT * FROM {x}k WHERE id NOT IN (SELECT id FROM {x}x))" + fuzzy_ctes(f"{x}z", f"{x}l") + best_ctes(f"SELECT *, 0 AS edits FROM {x}x UNION ALL SELECT id, pos, strand, ordinal, barcode, edits FROM {x}z", x)


def best_ctes(matches: str, x: str = "") -> str:
    return f""", {x}m AS ({matches}),
{x}o AS (SELECT *, row_number() OVER (PARTITION BY id, barcode ORDER BY edits, pos, ordinal) AS n_own FROM {x}m),
{x}b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY edits, pos, ordinal) AS n FROM {x}o WHERE n_own = 1),
{x}bl AS (SELECT id, count(*) AS n_barcodes, string_agg(barcode, ',' ORDER BY n) AS barcodes FROM {x}b GROUP BY id)"""


MATCHED = match_ctes()


def matched(spark: SparkSession, d: str) -> DataFrame:
    rows = calls.windows(calls.located(X.frame(spark, d, "noisy"), within=WITHIN))
    return barcode.match(rows, X.frame(spark, d, "whitelist"))


@query(WINDOWS + MATCHED + " SELECT b.id, barcode, CAST(pos AS INT) AS pos, CAST(strand AS INT) AS strand, CAST(edits AS INT) AS edits, CAST(n_barcodes AS INT) AS n_barcodes FROM b JOIN bl USING (id) WHERE n = 1")
def barcode_best(spark: SparkSession, d: str) -> DataFrame:
    best = F.get("found", F.lit(0))
    rows = matched(spark, d).where(F.size("found") > 0)
    return rows.select("id", best["barcode"].alias("barcode"), best["pos"].alias("pos"), "strand", best["edits"].alias("edits"), F.size("found").alias("n_barcodes"))


@query(WINDOWS + MATCHED + " SELECT barcode, count(*) AS n_reads FROM b WHERE n = 1 GROUP BY barcode")
def counts(spark: SparkSession, d: str) -> DataFrame:
    return barcode.barcode_counts(matched(spark, d).where(F.size("found") > 0).select(F.get("found", F.lit(0))["barcode"].alias("barcode")))


@query(X.sql("noisy").rstrip() + side_ctes() + " SELECT id, known IS NOT NULL AS polyat, side, CAST(strand AS INT) AS strand, CAST(outer_ AS INT) AS outer, CAST(inner_ AS INT) AS inner FROM s".replace("AS outer", 'AS "outer"').replace("AS inner", 'AS "inner"'))
def read_sides(spark: SparkSession, d: str) -> DataFrame:
    """Each read's side with the adapters found there."""
    return calls.located(X.frame(spark, d, "noisy"), within=WITHIN).select("id", "polyat", "side", "strand", "outer", "inner")


@query(X.sql("noisy").rstrip() + side_ctes() + " SELECT id, CAST(greatest(f0, 1) AS INT) AS pos, substring(seq, greatest(f0, 1), least(f0 + 11, n - 15) - greatest(f0, 1) + 16) AS window_ FROM f WHERE f0 IS NOT NULL AND greatest(f0, 1) <= least(f0 + 11, n - 15)".replace("window_", '"window"'))
def window_cases(spark: SparkSession, d: str) -> DataFrame:
    """The bases in which each read's barcode is sought, by its adapters' places."""
    return calls.windows(calls.located(X.frame(spark, d, "noisy"), within=WITHIN)).where("window is not null").select("id", "pos", "window")


SCORES = "CASE edits WHEN 0 THEN 0 WHEN 1 THEN 20 ELSE 28 END"
CALL_SQL = f""", q AS (SELECT f.*, CASE WHEN n >= 100000 THEN 'Read_too_long' WHEN n <= {2 * WITHIN} THEN 'Read_too_short' WHEN side = 'none' THEN 'ICS_R1_missing' WHEN side = 'both' THEN 'Dual_header' WHEN side = 'wrong' THEN 'ICS_R1_wrongly_oriented'
 WHEN f0 IS NULL OR greatest(f0, 1) > least(f0 + 11, n - 15) THEN 'Read_too_short' END AS st FROM f)
SELECT q.id, coalesce(st, CASE WHEN b.barcode IS NULL THEN 'Barcode_missing' ELSE 'fine' END) AS status, side, CASE WHEN st IS NULL THEN b.barcode END AS barcode, CASE WHEN st IS NULL THEN CAST(b.pos AS INT) END AS barcode_start,
CASE WHEN st IS NULL AND b.barcode IS NOT NULL THEN CASE WHEN q.strand = 0 THEN 'forward' ELSE 'reverse' END END AS barcode_strand, CASE WHEN st IS NULL THEN CAST(edits AS INT) END AS barcode_mismatch, CASE WHEN st IS NULL THEN CAST(coalesce(n_barcodes, 0) AS INT) ELSE 0 END AS n_barcodes,
CASE WHEN st IS NULL THEN barcodes END AS barcodes, CASE WHEN st IS NULL AND b.barcode IS NOT NULL THEN CAST({SCORES} AS INT) END AS barcode_score FROM q LEFT JOIN b ON b.id = q.id AND b.n = 1 LEFT JOIN bl ON bl.id = q.id"""


@query(WINDOWS + MATCHED + CALL_SQL)
def barcode_call(spark: SparkSession, d: str) -> DataFrame:
    """Each read with its status, barcode and score, called without annotation."""
    rows = calls.call(X.frame(spark, d, "noisy"), X.frame(spark, d, "whitelist"), within=WITHIN)
    text = F.when(F.size("barcodes") > 0, F.array_join("barcodes", ","))
    return rows.select("id", "status", "side", "barcode", "barcode_start", "barcode_strand", "barcode_mismatch", "n_barcodes", text.alias("barcodes"), "barcode_score")


PIPELINE = (
    X.sql("noisy", "whitelist", "hits").rstrip()
    + side_ctes()
    + WORDS
    + kmer_ctes()
    + MATCHED
    + """, g0 AS (SELECT id, min(quantity) AS best FROM hits GROUP BY id), g AS (SELECT h.id, min('G' || partkey) AS gene FROM hits h JOIN g0 ON g0.id = h.id AND quantity = best GROUP BY h.id HAVING count(*) = 1)
SELECT barcode, gene, count(*) AS n FROM b JOIN g USING (id) WHERE b.n = 1 GROUP BY barcode, gene"""
)


@query(PIPELINE)
def pipeline_counts(spark: SparkSession, d: str) -> DataFrame:
    """Reads to barcodes by adapter and exact, else fuzzy match, to genes by their best hit, counted."""
    hits = X.frame(spark, d, "hits").select("id", F.concat(F.lit("G"), F.col("partkey")).alias("gene"), F.col("quantity").alias("score"))
    genes = annotate.best_hit(hits).where("gene <> 'Ambiguous_mapping'").select(F.col("id").alias("g_id"), "gene")
    called = matched(spark, d).where(F.size("found") > 0).select("id", F.get("found", F.lit(0))["barcode"].alias("barcode"))
    return clones.gene_counts(called.join(genes, F.col("id") == F.col("g_id")))


TRIM_SQL = X.sql("noisy", "whitelist").rstrip() + side_ctes() + WORDS + kmer_ctes() + MATCHED + """, u AS (SELECT b.id, b.strand, seq, CAST(pos AS INT) AS p FROM b JOIN noisy USING (id) WHERE n = 1)
SELECT id, CASE WHEN strand = 0 THEN substring(seq, p + 16, 10) ELSE translate(reverse(substring(seq, greatest(p - 10, 1), least(10, p - 1))), 'ACGT', 'TGCA') END AS umi,
CASE WHEN strand = 0 THEN substring(seq, p + 26, length(seq)) ELSE translate(reverse(substring(seq, 1, greatest(p - 11, 0))), 'ACGT', 'TGCA') END AS seq,
CASE WHEN strand = 0 THEN substring(translate(seq, 'ACGT', '!5?I'), p + 26, length(seq)) ELSE reverse(substring(translate(seq, 'ACGT', '!5?I'), 1, greatest(p - 11, 0))) END AS qual FROM u"""


@query(TRIM_SQL)
def trimmed_reads(spark: SparkSession, d: str) -> DataFrame:
    """UMI, sequence and quality of each called read beyond its barcode."""
    rows = matched(spark, d).where(F.size("found") > 0)
    cut = S.trimmed(F.col("seq"), F.translate("seq", "ACGT", "!5?I"), F.get("found", F.lit(0))["pos"], F.col("strand"), F.lit(Chemistry().barcode))
    return rows.select("id", cut.alias("t")).select("id", "t.umi", "t.seq", "t.qual")


LISTS = """, bt AS (SELECT id, string_agg(barcode || ',', '' ORDER BY n) AS names, string_agg(pos || ',', '' ORDER BY n) AS starts, string_agg(edits || ',', '' ORDER BY n) AS edits FROM b GROUP BY id)"""
REPORT_SQL = CALL_SQL.split("\nSELECT")[0] + """ SELECT CAST(q.id AS STRING) AS read_id, coalesce(st, CASE WHEN b.barcode IS NULL THEN 'Barcode_missing' ELSE 'fine' END) AS status, CAST(coalesce(outer_, -1) AS STRING) AS "outer", CASE WHEN st IS NULL AND b.barcode IS NOT NULL THEN b.barcode ELSE '*' END AS barcode,
CASE WHEN st IS NULL AND b.barcode IS NOT NULL THEN CAST(b.pos AS STRING) ELSE '-1' END AS barcode_start, CAST(coalesce(inner_, -1) AS STRING) AS "inner", CASE WHEN st IS NULL AND b.barcode IS NOT NULL THEN CASE WHEN q.strand = 0 THEN 'forward' ELSE 'reverse' END ELSE '*' END AS barcode_strand,
CASE WHEN st IS NULL AND b.barcode IS NOT NULL THEN CAST(b.edits AS STRING) ELSE '-1' END AS barcode_mismatch, CASE WHEN known IS NULL THEN '0' ELSE '1' END AS polyat, CASE WHEN st IS NULL THEN CAST(coalesce(n_barcodes, 0) AS STRING) ELSE '0' END AS n_barcodes,
CASE WHEN st IS NULL THEN coalesce(bt.names, '*') ELSE '*' END AS barcodes, CASE WHEN st IS NULL THEN coalesce(bt.starts, '*') ELSE '*' END AS barcode_starts, CASE WHEN st IS NULL THEN coalesce(bt.edits, '*') ELSE '*' END AS barcode_mismatches
FROM q LEFT JOIN b ON b.id = q.id AND b.n = 1 LEFT JOIN bl ON bl.id = q.id LEFT JOIN bt ON bt.id = q.id"""


@query(WINDOWS + MATCHED + LISTS + REPORT_SQL)
def summary_report(spark: SparkSession, d: str) -> DataFrame:
    """The read summary's cells in the layout of thirteen columns."""
    return reports.summary(calls.call(X.frame(spark, d, "noisy"), X.frame(spark, d, "whitelist"), within=WITHIN), 2)
