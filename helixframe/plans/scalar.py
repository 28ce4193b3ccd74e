"""Queries on single sequences, pairs of sequences and text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import codec as C
from helixframe.functions import distance as D
from helixframe.functions import interval as I
from helixframe.functions import sequence as S
from helixframe.operators import adapters, annotate, barcode, dtw
from helixframe.operators.chemistry import R1
from helixframe.plans import fixtures as X
from helixframe.plans.registry import query



def rc(x: str) -> str:
    return f"translate(reverse({x}), 'ACGT', 'TGCA')"


@query(X.sql("reads") + f"SELECT id, reverse(seq) AS reversed, translate(seq, 'ACGT', 'TGCA') AS complemented, {rc('seq')} AS reverse_complemented FROM reads")
def revcomp(spark: SparkSession, d: str) -> DataFrame:
    return X.frame(spark, d, "reads").select("id", S.reverse(F.col("seq")).alias("reversed"), S.complement(F.col("seq")).alias("complemented"), S.reverse_complement(F.col("seq")).alias("reverse_complemented"))


@query("SELECT p_partkey AS id, translate(reverse(regexp_replace(upper(p_name), '[^ACGT]', 'N', 'g')), 'ACGT', 'TGCA') AS folded FROM part")
def folded_revcomp(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), S.folded_reverse_complement(F.col("p_name")).alias("folded"))


@query(X.sql("whitelist") + "SELECT ordinal, CAST(p AS INT) AS pos, substring(barcode, p, 6) AS kmer FROM whitelist, unnest(range(1, 12)) AS t(p)")
def kmers(spark: SparkSession, d: str) -> DataFrame:
    rows = X.frame(spark, d, "whitelist").select("ordinal", F.explode(S.kmers(F.col("barcode"), 6)).alias("w"))
    return rows.select("ordinal", "w.pos", "w.kmer")


WINDOW_SQL = """
, w AS (SELECT id, seq, greatest(CAST(id % 40 AS INT) - 1, 0) + 1 AS first, CASE WHEN id % 150 > length(seq) - 16 THEN length(seq) - 16 ELSE id % 150 - 16 END + 1 AS last FROM reads)
SELECT w.id, CAST(t.p AS INT) AS pos, substring(w.seq, t.p, 16) AS kmer FROM w, unnest(range(w.first, least(w.last, length(w.seq) - 15) + 1)) AS t(p)"""


@query(X.sql("reads").rstrip() + WINDOW_SQL)
def kmer_window(spark: SparkSession, d: str) -> DataFrame:
    rows = X.frame(spark, d, "reads").select("id", "seq")
    first, last = S.window_bounds(F.col("seq"), 16, (F.col("id") % 40).cast("int"), (F.col("id") % 150).cast("int"))
    return barcode.read_kmers(rows, 16, first, last)


@query(X.sql("whitelist") + "SELECT ordinal, CAST(i AS INT) AS no, CASE i WHEN 0 THEN substring(barcode, 1, 6) WHEN 1 THEN substring(barcode, 7, 5) ELSE substring(barcode, 12, 5) END AS segment FROM whitelist, unnest(range(0, 3)) AS t(i)")
def segments(spark: SparkSession, d: str) -> DataFrame:
    rows = X.frame(spark, d, "whitelist").select("ordinal", F.explode(S.segments(F.col("barcode"), S.segment_lengths(16, 3))).alias("s"))
    return rows.select("ordinal", "s.no", "s.segment")


@query(X.sql("reads") + "SELECT id, CASE WHEN seq LIKE '%AAAAAAAAAA%' AND seq NOT LIKE '%TTTTTTTTTT%' THEN 0 WHEN seq LIKE '%TTTTTTTTTT%' AND seq NOT LIKE '%AAAAAAAAAA%' THEN 3 ELSE -1 END AS tail FROM reads")
def poly_at(spark: SparkSession, d: str) -> DataFrame:
    return X.frame(spark, d, "reads").select("id", S.poly_tail(F.col("seq")).alias("tail"))


@query(X.sql("reads") + "SELECT id, CAST(len(regexp_extract_all(seq, '[GCT]A{13}')) AS INT) AS n_a, CAST(len(regexp_extract_all(seq, '[GCA]T{13}')) AS INT) AS n_t FROM reads")
def motif_counts(spark: SparkSession, d: str) -> DataFrame:
    return X.frame(spark, d, "reads").select("id", S.motif_count(F.col("seq"), "[GCT]A{13}").alias("n_a"), S.motif_count(F.col("seq"), "[GCA]T{13}").alias("n_t"))


@query(X.sql("reads") + "SELECT id, CAST(t.p - 1 AS INT) AS site FROM reads, unnest(range(1, length(seq) - 4)) AS t(p) WHERE regexp_matches(substring(seq, t.p, 6), '^[^A]A{5}')")
def tail_sites(spark: SparkSession, d: str) -> DataFrame:
    return X.frame(spark, d, "reads").select("id", F.explode(S.tail_sites(F.col("seq"), "^[^A]A{5}", 6)).alias("site"))


UMI_SQL = f""", s AS (SELECT id, strand, seq, CAST(CASE WHEN strand = 0 THEN 1 + id % 13 + 22 ELSE length(seq) - (id % 13 + 22 + 16) + 1 END AS INT) AS b FROM reads)
SELECT id, CASE WHEN strand = 0 THEN substring(seq, b + 16, 10) ELSE {rc('substring(seq, greatest(b - 10, 1), least(10, b - 1))')} END AS umi,
 CASE WHEN strand = 0 THEN substring(seq, b + 16 + 23, length(seq)) ELSE {rc('substring(seq, 1, greatest(b - 1 - 23, 0))')} END AS insert_ FROM s"""


@query(X.sql("reads").rstrip() + UMI_SQL)
def umi_trim(spark: SparkSession, d: str) -> DataFrame:
    start = F.when(F.col("strand") == 0, 1 + F.col("id") % 13 + 22).otherwise(F.length("seq") - (F.col("id") % 13 + 22 + 16) + 1).cast("int")
    umi, rest = S.umi_and_insert(F.col("seq"), start, F.col("strand"), F.lit(16))
    return X.frame(spark, d, "reads").select("id", umi.alias("umi"), rest.alias("insert_"))


@query(X.sql("whitelist") + "SELECT ordinal, CAST(" + " + ".join(f"(strpos('ACGT', substring(barcode, {i + 1}, 1)) - 1) * {4 ** (5 - i)}" for i in range(6)) + " AS INT) AS code FROM whitelist")
def kmer_codes(spark: SparkSession, d: str) -> DataFrame:
    return X.frame(spark, d, "whitelist").select("ordinal", S.kmer_code(F.substring("barcode", 1, 6)).alias("code"))


QUAL = "upper(md5(cast(ordinal as string)))"


@query(X.sql("whitelist") + f", q AS (SELECT ordinal, {QUAL} AS q FROM whitelist) SELECT ordinal, CAST(p AS INT) AS pos, CAST(CASE WHEN p > 27 THEN 35 ELSE list_sum(list_transform(range(p, p + 6), lambda i: ascii(substring(q, i, 1)))) // 6 END AS INT) AS mean FROM q, unnest(range(1, 33)) AS t(p)".replace("WITH ", "WITH ", 1))
def moving_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = X.frame(spark, d, "whitelist").select("ordinal", F.posexplode(S.mean_quality(F.expr(QUAL))).alias("p", "mean"))
    return rows.select("ordinal", (F.col("p") + 1).alias("pos"), "mean")


PAIRS = ("ordinal", "barcode as a", f"{X.mutated('barcode', '1 + ordinal % 16')} as b", "concat(substring(barcode, 1, cast(ordinal % 15 as int)), substring(barcode, cast(ordinal % 15 as int) + 2, 15), 'A') as c")
PAIRS_SQL = f", p AS (SELECT {', '.join(PAIRS)} FROM whitelist) "


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return X.frame(spark, d, "whitelist").selectExpr(*PAIRS)


def semiglobal_sql(a: str, b: str, k: int) -> str:
    return f"CAST(list_min(list_concat(list_transform(range(0, {k + 1}), lambda t: levenshtein(left({a}, length({a}) - t), {b})), list_transform(range(0, {k + 1}), lambda t: levenshtein({a}, left({b}, length({b}) - t))))) AS INT)"


@query(X.sql("whitelist").rstrip() + PAIRS_SQL + f"SELECT ordinal, {semiglobal_sql('a', 'b', 1)} AS one, {semiglobal_sql('a', 'c', 2)} AS two FROM p")
def edit_semiglobal(spark: SparkSession, d: str) -> DataFrame:
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return pairs(spark, d).select("ordinal", D.semiglobal_distance(a, b, 1, 16, 16).alias("one"), D.semiglobal_distance(a, c, 2, 16, 16).alias("two"))


@query(X.sql("whitelist").rstrip() + PAIRS_SQL + "SELECT ordinal, CAST(levenshtein(a, c) AS INT) AS edits, CAST(hamming(a, b) AS INT) AS differing, a = b AS same FROM p")
def edit_plain(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("ordinal", F.levenshtein("a", "c").alias("edits"), D.hamming(F.col("a"), F.col("b")).alias("differing"), (F.col("a") == F.col("b")).alias("same"))


LCS_SQL = X.sql("whitelist").rstrip().replace("WITH", "WITH RECURSIVE", 1) + PAIRS_SQL.rstrip() + """, r(ordinal, a, c, i, cells) AS (SELECT ordinal, a, c, 0, list_transform(range(0, 17), lambda x: 0) FROM p UNION ALL
SELECT ordinal, a, c, i + 1, list_transform(range(1, 18), lambda j: CASE WHEN j = 1 THEN 0 ELSE greatest(cells[j], coalesce(list_max(list_transform(list_filter(range(2, j + 1), lambda q: substring(c, q - 1, 1) = substring(a, i + 1, 1)), lambda q: cells[q - 1] + 1)), 0)) END) FROM r WHERE i < 16)
SELECT ordinal, CAST(list_max(cells) AS INT) AS score FROM r WHERE i = 16"""


@query(LCS_SQL)
def longest_common(spark: SparkSession, d: str) -> DataFrame:
    return pairs(spark, d).select("ordinal", D.longest_common(F.col("a"), F.col("c")).alias("score"))


PLACES = tuple(f"case when (o_orderkey // {2 ** i}) % 2 = 1 then cast({a} as int) end as {n}" for i, (n, a) in enumerate({"ol": "10 + o_custkey % 40", "il": "12 + o_orderkey % 40", "orr": "70 + o_custkey % 30", "ir": "65 + o_orderkey % 40"}.items()))
SIDE_SQL = f"""WITH p AS (SELECT o_orderkey AS id, {', '.join(PLACES)} FROM orders),
c AS (SELECT *, concat(CASE WHEN il IS NULL THEN '0' ELSE '1' END, CASE WHEN ol IS NULL THEN '0' ELSE '1' END, CASE WHEN ir IS NULL THEN '0' ELSE '1' END, CASE WHEN orr IS NULL THEN '0' ELSE '1' END) AS code FROM p)
SELECT id, code, CASE WHEN code = '0000' THEN 'none' WHEN code IN ('0101', '1001', '0110', '1010') THEN 'both' WHEN code IN ('0100', '1000') THEN 'left' WHEN code IN ('0001', '0010') THEN 'right'
 WHEN code IN ('1100', '1101', '1110') THEN CASE WHEN ol <= il THEN 'left' ELSE 'wrong' END WHEN code IN ('0011', '0111', '1011') THEN CASE WHEN ir <= orr THEN 'right' ELSE 'wrong' END
 WHEN il < ol AND ir < orr THEN 'right' WHEN il > ol AND ir > orr THEN 'left' ELSE 'both' END AS side FROM c"""


@query(SIDE_SQL)
def adapter_table(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey as id", *(p.replace("//", "div") for p in PLACES))
    code = F.concat(*(F.when(F.col(c).isNull(), "0").otherwise("1") for c in ("il", "ol", "ir", "orr")))
    return rows.select("id", code.alias("code"), adapters.side(F.col("ol"), F.col("il"), F.col("orr"), F.col("ir")).alias("side"))


STATUS_SQL = """SELECT o_orderkey AS id, CASE WHEN l >= 100000 THEN 'Read_too_long' WHEN l <= 200 THEN 'Read_too_short' WHEN o_orderkey % 5 = 0 THEN 'Read_unmapped' WHEN o_orderkey % 7 = 0 THEN 'R1a_missing'
 WHEN o_orderkey % 11 = 0 THEN 'Barcode_missing' ELSE 'fine' END AS status FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS INT) % 120000 AS l FROM orders)"""


@query(STATUS_SQL)
def status_flags(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/orders.parquet")
    k = F.col("o_orderkey")
    status = adapters.read_status(F.floor("o_totalprice").cast("int") % 120000, k % 7 != 0, k % 11 != 0, k % 5 != 0)
    return rows.select(k.alias("id"), status.alias("status"))


COMPLEX = "cast(10 + l_quantity * 3 as int)"
COMPLEX_SQL = f"""WITH a AS (SELECT l_orderkey AS id, list(struct_pack(pos := {COMPLEX} + l_linenumber * 40, strand := CASE WHEN (l_partkey + l_linenumber) % 2 = 0 THEN 0 ELSE 3 END) ORDER BY l_linenumber) AS x FROM lineitem GROUP BY l_orderkey),
b AS (SELECT id, list_sort(x) AS x FROM a) SELECT id, CASE WHEN len(x) = 2 THEN CASE WHEN x[1].strand = x[2].strand THEN CASE WHEN x[2].pos - x[1].pos > 50 THEN 'Chimera' ELSE 'R1a_duplication' END
 WHEN x[1].strand = 0 THEN CASE WHEN x[2].pos - x[1].pos > 100 THEN 'Dual_header' ELSE 'Others' END ELSE CASE WHEN x[2].pos - x[1].pos < 100 THEN 'Anti_dual_header' ELSE 'Others' END END
 WHEN len(x) > 2 THEN CASE WHEN len(list_distinct(list_transform(x, lambda e: e.strand))) = 1 THEN 'Chimera' ELSE 'Others' END END AS class FROM b"""


@query(COMPLEX_SQL)
def complex_class(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct((F.expr(COMPLEX) + F.col("l_linenumber") * 40).alias("pos"), F.when((F.col("l_partkey") + F.col("l_linenumber")) % 2 == 0, 0).otherwise(3).alias("strand"))
    rows = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(one)).alias("a"))
    return rows.select("id", adapters.complex_class(F.col("a")).alias("class"))


@query("SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 20 WHEN 2 THEN 28 WHEN 3 THEN 44 WHEN 4 THEN 75 ELSE 999999 END AS score FROM customer")
def barcode_score(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), barcode.barcode_score((F.col("c_custkey") % 7).cast("int")).alias("score"))


CIGAR = X.cigar("p_partkey")
CLIP_SQL = f"""WITH c AS (SELECT p_partkey AS id, {CIGAR} AS cigar FROM part) SELECT id, cigar, CASE WHEN len(regexp_extract_all(cigar, '[A-Z]')) > 1 AND regexp_matches(cigar, '^\\d+[SH]') THEN CAST(regexp_extract(cigar, '^(\\d+)[SH]', 1) AS INT) ELSE -1 END AS clip_left,
 CASE WHEN len(regexp_extract_all(cigar, '[A-Z]')) > 1 AND regexp_matches(cigar, '\\d+[SH]$') THEN CAST(regexp_extract(cigar, '(\\d+)[SH]$', 1) AS INT) ELSE -1 END AS clip_right FROM c"""


@query(CLIP_SQL)
def clip_parse(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("cigar")
    return spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey as id", f"{CIGAR} as cigar").select("id", "cigar", C.clip(c, "left").alias("clip_left"), C.clip(c, "right").alias("clip_right"))


SEGMENT_SQL = f"""WITH c AS (SELECT p_partkey AS id, {CIGAR} AS cigar FROM part), o AS (SELECT id, cigar, t.i, regexp_extract_all(cigar, '\\d+[A-Z]')[t.i] AS x FROM c, unnest(range(1, len(regexp_extract_all(cigar, '\\d+[A-Z]')) + 1)) AS t(i)),
n AS (SELECT id, i, CAST(x[1:-2] AS INT) AS n, x[-1:] AS op FROM o),
s AS (SELECT id, i, n, op, id * 100 + coalesce(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN n END) OVER w, 0) AS a_, coalesce(sum(CASE WHEN op = 'N' THEN 1 ELSE 0 END) OVER w, 0) AS island FROM n WINDOW w AS (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT id, CAST(min(a_) AS INT) AS start, CAST(max(a_ + n) - 1 AS INT) AS "end" FROM s WHERE op IN ('M', 'D', '=', 'X') GROUP BY id, island"""


@query(SEGMENT_SQL)
def cigar_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey as id", f"{CIGAR} as cigar")
    return rows.select("id", F.explode(C.cigar_segments(F.col("cigar"), (F.col("id") * 100).cast("int"))).alias("s")).select("id", "s.start", "s.end")


def cigar_sum(kinds: str) -> str:
    return f"coalesce(list_sum(list_transform(regexp_extract_all(cigar, '\\d+[{kinds}]'), lambda x: CAST(x[1:-2] AS INT))), 0)"


@query(f"WITH c AS (SELECT p_partkey AS id, {CIGAR} AS cigar FROM part) SELECT id, CAST(coalesce(try_cast(regexp_extract(cigar, '^(\\d+)[SH]', 1) AS INT), 0) + 1 AS INT) AS q_start, CAST(coalesce(try_cast(regexp_extract(cigar, '^(\\d+)[SH]', 1) AS INT), 0) + {cigar_sum('MI')} AS INT) AS q_end, CAST({cigar_sum('MISH')} AS INT) AS read_length FROM c")
def cigar_span(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey as id", f"{CIGAR} as cigar").select("id", C.query_span(F.col("cigar")).alias("s"))
    return rows.select("id", F.col("s.start").alias("q_start"), F.col("s.end").alias("q_end"), F.col("s.length").alias("read_length"))


TAG = "concat('NM:i:1 SA:Z:chr', p_partkey % 5, ',', p_partkey * 7, ',', case when p_partkey % 2 = 0 then '+' else '-' end, ',', " + CIGAR + ", ',60,0;')"


@query(f"SELECT p_partkey AS id, concat('chr', p_partkey % 5) AS ref, CAST(p_partkey * 7 AS INT) AS pos, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand, {CIGAR} AS cigar FROM part")
def supplementary_tags(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").selectExpr("p_partkey as id", f"{TAG} as tags").select("id", C.supplementary(F.col("tags")).alias("s")).select("id", "s.*")


CODEC_SQL = X.sql("hits").rstrip() + """, g AS (SELECT id, list(struct_pack(ord := ord, s := start, e := end_) ORDER BY ord, start, end_) AS x FROM hits GROUP BY id)
SELECT id, array_to_string(list_transform(x, lambda r: concat(r.s, '-', r.e)), ',') AS regions, concat('>', array_to_string(list_transform(x, lambda r: CAST(r.ord AS STRING)), '>'), '>') AS chain, CAST(list_sum(list_transform(x, lambda r: r.e - r.s)) AS INT) AS spans FROM g"""


@query(CODEC_SQL)
def text_codecs(spark: SparkSession, d: str) -> DataFrame:
    rows = X.frame(spark, d, "hits").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("ord", "start", "end"))).alias("x"))
    text = rows.select("id", C.regions_text(F.col("x")).alias("regions"), C.joined(F.transform("x", lambda r: r["ord"]), ">", ends=True).alias("chain"))
    spans = F.aggregate(C.regions(F.col("regions")), F.lit(0), lambda a, r: a + r["end"] - r["start"])
    return text.select("id", "regions", "chain", spans.alias("spans"))


@query("SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'forward' WHEN 1 THEN 'reversed' WHEN 2 THEN 'complement' WHEN 3 THEN 'reverse' ELSE '*' END AS strand, CAST(CASE WHEN c_custkey % 5 = 4 THEN -1 ELSE c_custkey % 5 END AS INT) AS code FROM customer")
def strand_codecs(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id"), C.strand_text((F.col("c_custkey") % 5).cast("int")).alias("strand"))
    return rows.select("id", "strand", C.strand_code(F.col("strand")).alias("code"))


COV = "(SELECT hit, start AS s1, end_ AS e1, start + 20 AS s2, end_ + quantity - 20 AS e2, strand FROM hits)"


@query(X.sql("hits") + f"SELECT hit, round(greatest(0, least(e1, e2) - greatest(s1, s2) + 1) / (e1 - s1 + 1), 6) AS covered, s2 >= s1 AND e2 <= e1 AS inside FROM {COV}")
def interval_cov(spark: SparkSession, d: str) -> DataFrame:
    s1, e1, s2, e2 = F.col("start"), F.col("end"), F.col("start") + 20, F.col("end") + F.col("quantity") - 20
    return X.frame(spark, d, "hits").select("hit", F.round(I.coverage(s1, e1, s2, e2), 6).alias("covered"), I.contains(s2, e2, s1, e1).alias("inside"))


@query(X.sql("hits") + f"SELECT hit, CAST(CASE WHEN least(e1, e2) < greatest(s1, s2) THEN 99999 WHEN strand = '+' THEN abs(s1 - s2) ELSE abs(e1 - e2) END AS INT) AS five, CAST(CASE WHEN least(e1, e2) < greatest(s1, s2) THEN 99999 WHEN strand = '+' THEN abs(e1 - e2) ELSE abs(s1 - s2) END AS INT) AS three FROM {COV}")
def overhang(spark: SparkSession, d: str) -> DataFrame:
    at = (F.col("start"), F.col("end"), F.col("start") + 20, F.col("end") + F.col("quantity") - 20, F.col("strand") == "+")
    return X.frame(spark, d, "hits").select("hit", I.overhang(*at, 5).alias("five"), I.overhang(*at, 3).alias("three"))


SCORE_SQL = """WITH t AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'unspliced' WHEN 1 THEN 'G(fsm/ism=>1>2>3>)' WHEN 2 THEN 'G(novel=>1>-1>3>)' ELSE 'G(novel=>-1>-1>)' END AS tag, CAST(p_size * 97 AS INT) AS s, p_partkey % 6 + 1 AS hits FROM part)
SELECT id, CAST(CASE WHEN hits = 1 THEN 0 WHEN tag = 'unspliced' THEN s ELSE least(floor((s + 1) / CASE tag WHEN 'G(fsm/ism=>1>2>3>)' THEN 1000 WHEN 'G(novel=>1>-1>3>)' THEN 10 ELSE 0.01 END), 999999) END AS INT) AS score FROM t"""


@query(SCORE_SQL)
def annotation_score(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    tag = F.when(k % 4 == 0, "unspliced").when(k % 4 == 1, "G(fsm/ism=>1>2>3>)").when(k % 4 == 2, "G(novel=>1>-1>3>)").otherwise("G(novel=>-1>-1>)")
    return spark.read.parquet(f"{d}/part.parquet").select(k.alias("id"), annotate.annotation_score(tag, (F.col("p_size") * 97).cast("int"), k % 6 + 1).alias("score"))


ENVELOPE_SQL = """WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, value FROM events)
SELECT user_id, CAST(pos AS INT) AS pos, min(value) OVER w AS lower, max(value) OVER w AS upper FROM e WINDOW w AS (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"""


@query(ENVELOPE_SQL)
def envelope(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"].cast("double")).alias("values"))
    both = dtw.envelopes(rows, "values").select("user_id", F.posexplode(F.arrays_zip("lower", "upper")).alias("p", "e"))
    return both.select("user_id", (F.col("p") + 1).alias("pos"), "e.lower", "e.upper")


@query(X.sql("whitelist") + "SELECT ordinal, CAST(p AS INT) AS pos, CAST(" + " + ".join(f"(strpos('ACGT', substring(barcode, p + {i}, 1)) - 1) * {4 ** (5 - i)}" for i in range(6)) + " AS INT) % 97 - CAST(48.5 AS DOUBLE) AS level FROM whitelist, unnest(range(1, 12)) AS t(p)")
def level_series(spark: SparkSession, d: str) -> DataFrame:
    rows = dtw.levels(X.frame(spark, d, "whitelist"), "barcode", dtw.demo_model())
    return rows.select("ordinal", F.posexplode("levels").alias("p", "level")).select("ordinal", (F.col("p") + 1).alias("pos"), F.col("level").cast("double").alias("level"))


@query()
def dtw_rescue(spark: SparkSession, d: str) -> DataFrame:
    """Of reads whose barcode no exact match gives. A recursion over pairs of levels in a band, which the tests hold against a plain one."""
    reads, whitelist = X.frame(spark, d, "reads"), X.frame(spark, d, "whitelist")
    exact = barcode.exact_matches(barcode.read_kmers(reads, 16), whitelist)
    return dtw.rescue(X.spread(reads.join(exact, "id", "left_anti")), whitelist, dtw.demo_model())


@query(X.sql("whitelist") + f", q AS (SELECT ordinal, {QUAL} AS q FROM whitelist) SELECT ordinal, CAST(p AS INT) AS pos, CAST(ascii(substring(q, p + 5, 1)) AS INT) AS code FROM q, unnest(range(1, 28)) AS t(p)")
def kmer_quality(spark: SparkSession, d: str) -> DataFrame:
    rows = X.frame(spark, d, "whitelist").select("ordinal", F.posexplode(S.last_quality(F.expr(QUAL))).alias("p", "code"))
    return rows.select("ordinal", (F.col("p") + 1).alias("pos"), "code")


CELLS = ("concat(case when quantity % 3 = 0 then '-' else '' end, '0.', quantity, ',1,', ord)", "concat(ord, ',', quantity, ';', quantity + 1, ',', ord)")
CELLS_SQL = f"""SELECT hit, round(CASE WHEN quantity % 3 = 0 THEN 0 ELSE CAST('0.' || quantity AS DOUBLE) END + 1 + ord, 6) AS covered, CAST(2 * ord + 2 * quantity + 1 AS INT) AS total, CAST(2 AS INT) AS n_groups, concat(ord, ',', quantity, ';', quantity + 1, ',', ord) AS groups_text FROM hits"""


@query(X.sql("hits") + CELLS_SQL)
def list_codecs(spark: SparkSession, d: str) -> DataFrame:
    """Coverages, whole numbers and groups of hits, read from their cells and summed."""
    rows = X.frame(spark, d, "hits").selectExpr("hit", f"{CELLS[0]} as covs", f"{CELLS[1]} as cell")
    rows = rows.select("hit", C.coverages(F.col("covs")).alias("covs"), C.hit_groups(F.col("cell")).alias("g"), C.integers(F.regexp_replace("cell", ";", ",")).alias("ints"))
    add = lambda c, zero: F.aggregate(c, zero, lambda a, x: a + x)
    return rows.select("hit", F.round(add("covs", F.lit(0.0)), 6).alias("covered"), add("ints", F.lit(0)).alias("total"), F.size("g").alias("n_groups"), C.hit_groups_text(F.col("g")).alias("groups_text"))


LEVEL_SQL = X.sql("whitelist").rstrip() + f""", w AS (SELECT ordinal, barcode, 0 AS strand, '{R1}' || barcode AS word FROM whitelist UNION ALL SELECT ordinal, barcode, 3, {rc(f"('{R1}' || barcode)")} FROM whitelist),
l AS (SELECT ordinal, barcode, strand, CAST(p AS INT) AS pos, (""" + " + ".join(f"(strpos('ACGT', substring(word, p + {i}, 1)) - 1) * {4 ** (5 - i)}" for i in range(6)) + """) % 97 - CAST(48.5 AS DOUBLE) AS level FROM w, unnest(range(1, 34)) AS t(p))
SELECT ordinal, barcode, CAST(strand AS INT) AS strand, pos, level, min(level) OVER n AS lower, max(level) OVER n AS upper, CAST(row_number() OVER (PARTITION BY ordinal, barcode, strand ORDER BY abs(level) DESC, pos) AS INT) AS rank FROM l WINDOW n AS (PARTITION BY ordinal, barcode, strand ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"""


@query(LEVEL_SQL)
def whitelist_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels, envelope and order by magnitude of each barcode behind the adapter, on both strands."""
    rows = dtw.whitelist_levels(X.frame(spark, d, "whitelist"), dtw.demo_model())
    ranks = F.transform("levels", lambda _, i: F.array_position("by_magnitude", i))
    rows = rows.select("ordinal", "barcode", "strand", F.posexplode(F.arrays_zip("levels", "lower", "upper", ranks.alias("rank"))).alias("p", "z"))
    return rows.select("ordinal", "barcode", "strand", (F.col("p") + 1).alias("pos"), F.col("z.levels").alias("level"), "z.lower", "z.upper", F.col("z.rank").cast("int").alias("rank"))
