"""Queries on intervals, genes, isoforms and chimeric reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import interval as I
from helixframe.functions.sequence import once
from helixframe.operators import annotate, chimera, regions
from helixframe.plans import fixtures as X
from helixframe.plans.registry import query

MERGED = """, m0 AS (SELECT id, q_start AS s, q_end AS e, max(q_end) OVER (PARTITION BY id ORDER BY q_start, q_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM hits),
m1 AS (SELECT id, s, e, sum(CASE WHEN upto IS NULL OR s > upto THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m0),
merged AS (SELECT id, min(s) AS s, max(e) AS e, count(*) AS members, string_agg(CAST(s AS STRING), ',' ORDER BY s) AS grp FROM m1 GROUP BY id, island)"""


def spans(spark: SparkSession, d: str) -> DataFrame:
    return X.frame(spark, d, "hits").select("id", F.col("q_start").alias("start"), F.col("q_end").alias("end"))


@query(X.sql("hits").rstrip() + MERGED + ' SELECT id, s AS start, e AS "end", members, grp AS "group" FROM merged')
def interval_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = regions.merge(spans(spark, d).withColumn("place", F.col("start")), member="place")
    return rows.withColumn("group", F.array_join(F.col("group").cast("array<string>"), ","))


FREE = (
    X.sql("hits").rstrip()
    + MERGED
    + """, g AS (SELECT id, coalesce(lag(e) OVER (PARTITION BY id ORDER BY s), 0) + 1 AS s, s - 1 AS e FROM merged UNION ALL SELECT id, max(e) + 1, 700 FROM merged GROUP BY id)
SELECT id, CAST(s AS INT) AS start, CAST(e AS INT) AS "end" FROM g WHERE s <= e"""
)


@query(FREE)
def free_regions(spark: SparkSession, d: str) -> DataFrame:
    return regions.free(regions.merge(spans(spark, d)), F.lit(700))


OVERLAP = ", o AS (SELECT * FROM hits JOIN genes USING (chrom) WHERE start <= g_end AND g_start <= end_)"


def overlaps(spark: SparkSession, d: str, bin_size: int = 20_000) -> DataFrame:
    genes = X.frame(spark, d, "genes").withColumnRenamed("chrom", "g_chrom")
    return regions.overlap_join(X.frame(spark, d, "hits"), genes, bin_size)


@query(X.sql("hits", "genes").rstrip() + OVERLAP + " SELECT hit, gene, chrom FROM o")
def gene_overlap(spark: SparkSession, d: str) -> DataFrame:
    return overlaps(spark, d).select("hit", "gene", "chrom")


ANNOTATE = (
    X.sql("hits", "genes").rstrip()
    + OVERLAP
    + """ SELECT hit, gene, strand = g_strand AS sense, round((least(end_, g_end) - greatest(start, g_start) + 1) / (end_ - start + 1), 6) AS hit_coverage, round((least(end_, g_end) - greatest(start, g_start) + 1) / (g_end - g_start + 1), 6) AS gene_coverage,
CAST(floor(CASE WHEN g_strand = '+' THEN abs(start - g_start) ELSE abs(end_ - g_end) END / 10) AS INT) AS score, row_number() OVER (PARTITION BY hit ORDER BY g_end, gene) = 1 AS is_primary FROM o"""
)


@query(ANNOTATE)
def hit_annotation(spark: SparkSession, d: str) -> DataFrame:
    return annotate.annotate_hits(overlaps(spark, d)).select("hit", "gene", "sense", "hit_coverage", "gene_coverage", "score", "is_primary")


NEAREST = (
    X.sql("hits")
    + """, a AS (SELECT id, CAST(id % 500 AS INT) AS pos, id % 2 = 0 AS f FROM hits GROUP BY id), c AS (SELECT a.id, CASE WHEN f THEN q_start - pos ELSE pos - q_end END AS dist, q_start, q_end FROM a JOIN hits USING (id)),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, q_start, q_end) AS n FROM c WHERE dist >= 0) SELECT a.id, r.dist, r.q_start AS start, r.q_end AS "end" FROM a LEFT JOIN r ON r.id = a.id AND n = 1"""
).replace("WITH", "WITH", 1)


@query(NEAREST)
def nearest_region(spark: SparkSession, d: str) -> DataFrame:
    rows = spans(spark, d).groupBy("id").agg(F.collect_list(F.struct("start", "end")).alias("r"))
    at = regions.nearest_region((F.col("id") % 500).cast("int"), F.col("id") % 2 == 0, F.col("r"))
    return rows.select("id", at.alias("n")).select("id", "n.dist", "n.start", "n.end")




def exon_rows(spark: SparkSession, d: str) -> DataFrame:
    """gene, ordinal, start, end, plus: one to five exons of each gene, and a row of equal midpoint for the first."""
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("gene"), (F.col("p_partkey") % 2 == 0).alias("plus"), F.explode(F.sequence(F.lit(0), F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(F.col("p_partkey") % 4 + 2).cast("int"))).alias("i"))
    start = F.when(F.col("i") == 0, F.col("gene") * 100 + 1).otherwise(F.col("gene") * 100 + (F.col("i") - 1) * 60)
    end = F.when(F.col("i") == 0, F.col("gene") * 100 + 39).otherwise(start + 40)
    return part.select("gene", (10 - F.col("i")).alias("ordinal"), start.cast("int").alias("start"), end.cast("int").alias("end"), "plus")


EXON_SQL = """WITH exon_rows AS (SELECT p_partkey AS gene, p_partkey % 2 = 0 AS plus, CAST(10 - i AS INT) AS ordinal, CAST(CASE WHEN i = 0 THEN p_partkey * 100 + 1 ELSE p_partkey * 100 + (i - 1) * 60 END AS INT) AS start,
CAST(CASE WHEN i = 0 THEN p_partkey * 100 + 39 ELSE p_partkey * 100 + (i - 1) * 60 + 40 END AS INT) AS end_ FROM part, unnest(range(0, CASE WHEN p_partkey % 7 = 0 THEN 2 ELSE p_partkey % 4 + 3 END)) AS t(i)),
f AS (SELECT *, row_number() OVER (PARTITION BY gene, (start + end_) // 2 ORDER BY ordinal, start, end_) AS n FROM exon_rows),
exons AS (SELECT gene, start, end_, CAST(dense_rank() OVER (PARTITION BY gene ORDER BY ordinal) - 1 AS INT) AS exon FROM f WHERE n = 1)"""


@query(EXON_SQL + ' SELECT gene, start, end_ AS "end", exon FROM exons')
def exon_ids(spark: SparkSession, d: str) -> DataFrame:
    return regions.exon_ids(exon_rows(spark, d))


SEGMENT_SQL = EXON_SQL + """, segs AS (SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', cast(l_quantity as int)) AS hit, l_partkey AS gene, l_partkey % 2 = 0 AS plus, CAST(k + 1 AS INT) AS segment, CAST(l_partkey * 100 + (l_linenumber % 3 + k) * 60 + l_suppkey % 3 AS INT) AS start, CAST(l_partkey * 100 + (l_linenumber % 3 + k) * 60 + 40 - l_orderkey % 4 AS INT) AS end_
FROM lineitem, unnest(range(0, l_linenumber % 2 + 1)) AS t(k)),
mm AS (SELECT segs.hit, segs.gene, segs.plus, segs.segment, segs.start, segs.end_, exon, least(segs.end_, x.end_) - greatest(segs.start, x.start) + 1 AS ov FROM segs LEFT JOIN exons x ON x.gene = segs.gene
 AND greatest(0, least(segs.end_, x.end_) - greatest(segs.start, x.start) + 1) / (segs.end_ - segs.start + 1) > 0.9 AND greatest(0, least(segs.end_, x.end_) - greatest(segs.start, x.start) + 1) / (x.end_ - x.start + 1) > 0.9),
matched AS (SELECT hit, gene, plus, segment, start, end_, exon FROM (SELECT *, row_number() OVER (PARTITION BY hit, segment ORDER BY ov DESC, exon) AS n FROM mm) WHERE n = 1)"""


def segment_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet")
    k = F.explode(F.sequence(F.lit(0), F.col("l_linenumber") % 2)).alias("k")
    at = F.col("l_partkey") * 100 + (F.col("l_linenumber") % 3 + F.col("k")) * 60
    return rows.select("*", k).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int")).alias("hit"),
        F.col("l_partkey").alias("gene"),
        (F.col("l_partkey") % 2 == 0).alias("plus"),
        (F.col("k") + 1).cast("int").alias("segment"),
        (at + F.col("l_suppkey") % 3).cast("int").alias("start"),
        (at + 40 - F.col("l_orderkey") % 4).cast("int").alias("end"),
    )


@query(SEGMENT_SQL + ' SELECT hit, gene, segment, start, end_ AS "end", exon FROM matched')
def exon_match(spark: SparkSession, d: str) -> DataFrame:
    return regions.exon_match(segment_rows(spark, d), regions.exon_ids(exon_rows(spark, d))).drop("plus")


TRANSCRIPT_SQL = """, tr AS (SELECT gene, concat('T', gene, '-', v) AS transcript, list(exon ORDER BY CASE WHEN gene % 2 = 0 THEN start ELSE -start END) AS ids FROM exons, unnest(range(0, 2)) AS t(v) WHERE v = 0 OR exon > 1 GROUP BY gene, v),
tt AS (SELECT gene, transcript, concat('>', array_to_string(list_transform(ids, lambda x: CAST(x AS STRING)), '>'), '>') AS t_text FROM tr),
hx AS (SELECT hit, gene, list(coalesce(exon, -1) ORDER BY CASE WHEN plus THEN segment ELSE -segment END) AS ids FROM matched GROUP BY hit, gene, plus),
ht AS (SELECT hit, gene, list_contains(ids, -1) AS novel, concat('>', array_to_string(list_transform(ids, lambda x: CAST(x AS STRING)), '>'), '>') AS text FROM hx),
j AS (SELECT hit, ht.gene, text, count(transcript) AS n, min(transcript) AS one FROM ht LEFT JOIN tt ON tt.gene = ht.gene AND NOT novel AND contains(t_text, text) GROUP BY hit, ht.gene, text)
SELECT hit, gene, CASE WHEN n = 1 THEN concat(one, '(fsm/ism=', text, ')') ELSE concat(gene, CASE WHEN n > 1 THEN '(ambiguous=' ELSE '(novel=' END, text, ')') END AS tag FROM j"""


@query(SEGMENT_SQL + TRANSCRIPT_SQL)
def isoform_class(spark: SparkSession, d: str) -> DataFrame:
    exons = regions.exon_ids(exon_rows(spark, d))
    order = F.sort_array(F.collect_list(F.struct(F.when(F.col("gene") % 2 == 0, F.col("start")).otherwise(-F.col("start")).alias("o"), "exon")))
    kinds = exons.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("v")).where((F.col("v") == 0) | (F.col("exon") > 1))
    transcripts = kinds.groupBy("gene", "v").agg(F.transform(order, lambda x: x["exon"]).alias("exons"))
    transcripts = transcripts.select("gene", F.concat(F.lit("T"), F.col("gene"), F.lit("-"), F.col("v")).alias("transcript"), "exons")
    matched = regions.exon_match(segment_rows(spark, d), exons)
    return annotate.isoform_tags(matched, transcripts)


CHOICE_SQL = X.sql("hits") + """, b AS (SELECT id, list(struct_pack(s := q_start, e := q_end, gene := concat('G', partkey), score := quantity % 5) ORDER BY q_start, q_end, concat('G', partkey), quantity % 5) AS x FROM hits WHERE strand = '+' GROUP BY id),
p AS (SELECT b.id, a.i, c.j, x[a.i] AS l, x[c.j] AS r FROM b, unnest(range(1, len(x) + 1)) AS a(i), unnest(range(1, len(x) + 1)) AS c(j) WHERE a.i < c.j),
q AS (SELECT id, max(greatest(0, least(l.e, r.e) - greatest(l.s, r.s) + 1) / least(l.e - l.s + 1, r.e - r.s + 1)) AS worst FROM p GROUP BY id),
w AS (SELECT b.id, x, worst, list_min(list_transform(x, lambda h: h.score)) AS best FROM b LEFT JOIN q USING (id))
SELECT id, CASE WHEN len(x) = 1 THEN x[1].gene WHEN worst <= 0.4 THEN concat('Fusion: ', array_to_string(list_transform(x, lambda h: h.gene), '::')) WHEN len(list_filter(x, lambda h: h.score = best)) = 1 THEN list_filter(x, lambda h: h.score = best)[1].gene ELSE 'Ambiguous_mapping' END AS annotation FROM w"""


@query(CHOICE_SQL)
def annotation_choice(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct(F.col("q_start").alias("start"), F.col("q_end").alias("end"), F.concat(F.lit("G"), F.col("partkey")).alias("gene"), (F.col("quantity") % 5).alias("score"))
    rows = X.frame(spark, d, "hits").where("strand = '+'").groupBy("id").agg(F.sort_array(F.collect_list(one)).alias("h"))
    return rows.select("id", annotate.choose(F.col("h")).alias("annotation"))


TRIAGE = (
    "l_orderkey as read",
    "cast(l_linenumber as int) as ord",
    "cast(case when l_linenumber % 3 = 2 then 2048 else 0 end as int) as flag",
    "case when l_partkey % 9 = 0 then '*' else concat('t', l_partkey % 400) end as ref",
    X.cigar("l_suppkey") + " as cigar",
    "case when l_linenumber % 3 = 2 then concat('t', l_suppkey % 400) end as sa_ref",
    "case when l_linenumber % 3 = 2 then " + X.cigar("(l_suppkey + l_partkey)") + " end as sa_cigar",
)


CLIP_SQL_OF = "CASE WHEN len(regexp_extract_all({c}, '[A-Z]')) > 1 AND regexp_matches({c}, '^\\d+[SH]') THEN CAST(regexp_extract({c}, '^(\\d+)[SH]', 1) AS INT) ELSE -1 END AS {p}l, CASE WHEN len(regexp_extract_all({c}, '[A-Z]')) > 1 AND regexp_matches({c}, '\\d+[SH]$') THEN CAST(regexp_extract({c}, '(\\d+)[SH]$', 1) AS INT) ELSE -1 END AS {p}r"
TRIAGE_SQL = f"""WITH RECURSIVE records AS (SELECT {', '.join(TRIAGE)} FROM lineitem), names AS (SELECT concat('t', p_partkey) AS id, concat('G', p_partkey % 50) AS name FROM part WHERE p_partkey % 3 <> 0),
n AS (SELECT r.*, coalesce(a.name, ref) AS gene, coalesce(b.name, sa_ref) AS sa_gene, {CLIP_SQL_OF.format(c='cigar', p='')}, {CLIP_SQL_OF.format(c='sa_cigar', p='s')} FROM records r LEFT JOIN names a ON a.id = ref LEFT JOIN names b ON b.id = sa_ref),
o AS (SELECT *, row_number() OVER (PARTITION BY read ORDER BY ord, flag, ref, gene, sa_gene NULLS FIRST, l, r, sl, sr) AS i FROM n),
s AS (SELECT read, 0 AS i, CAST(NULL AS VARCHAR) AS gene, false AS chimeric FROM (SELECT DISTINCT read FROM o) UNION ALL
SELECT s.read, o.i, CASE WHEN s.chimeric OR o.ref = '*' THEN s.gene WHEN s.gene IS NULL THEN o.gene WHEN o.flag < 2048 OR o.sa_gene IS NULL THEN s.gene WHEN o.l >= o.sl AND o.r >= o.sr THEN o.sa_gene WHEN o.l <= o.sl AND o.r <= o.sr THEN o.gene END,
s.chimeric OR (o.ref <> '*' AND s.gene IS NOT NULL AND o.flag >= 2048 AND o.sa_gene IS NOT NULL AND NOT (o.l >= o.sl AND o.r >= o.sr) AND NOT (o.l <= o.sl AND o.r <= o.sr)) FROM s JOIN o ON o.read = s.read AND o.i = s.i + 1),
l AS (SELECT read, max(i) AS i FROM o GROUP BY read) SELECT s.read, s.gene, s.chimeric FROM s JOIN l USING (read, i) WHERE s.gene IS NOT NULL OR s.chimeric"""


@query(TRIAGE_SQL)
def chimera_triage(spark: SparkSession, d: str) -> DataFrame:
    records = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(*TRIAGE)
    names = spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 3 <> 0").selectExpr("concat('t', p_partkey) as id", "concat('G', p_partkey % 50) as name")
    return chimera.triage(records, names)


POLY_SQL = X.sql("reads") + f""", r AS (SELECT id, strand = 0 AS f, CASE WHEN id % 4 = 0 THEN seq ELSE concat(substring(seq, 1, 60), repeat(substring(seq, 1, 40), 5), CASE WHEN strand = 0 THEN 'CAAAAAAAAAAG' ELSE 'CTTTTTTTTTTG' END, repeat(substring(seq, 20, 40), 7)) END AS seq FROM reads),
a AS (SELECT id, min(p) - 1 AS site FROM r, unnest(range(1, length(seq) - 9)) AS t(p) WHERE f AND regexp_matches(substring(seq, p, 11), '^A{{10}}[^A]') GROUP BY id),
b AS (SELECT id, max(p) - 1 AS site FROM r, unnest(range(1, length(seq) - 9)) AS t(p) WHERE NOT f AND regexp_matches(substring(seq, p, 11), '^[^T]T{{10}}') GROUP BY id),
v AS (SELECT r.id, length(seq) AS n, f, CASE WHEN f THEN a.site + 10 ELSE b.site + 1 END AS cut FROM r LEFT JOIN a USING (id) LEFT JOIN b ON b.id = r.id),
w AS (SELECT id, n, cut, CASE WHEN n <= 200 THEN 'read_too_short' WHEN cut IS NULL OR (f AND cut > n - 200) OR (NOT f AND cut < 200) THEN 'fusion_gene_like' ELSE 'split' END AS verdict FROM v)
SELECT id, CAST(CASE WHEN verdict = 'split' THEN cut END AS INT) AS cut, verdict FROM w"""


def long_reads(spark: SparkSession, d: str) -> DataFrame:
    rows = X.frame(spark, d, "reads")
    long = F.expr("concat(substring(seq, 1, 60), repeat(substring(seq, 1, 40), 5), case when strand = 0 then 'CAAAAAAAAAAG' else 'CTTTTTTTTTTG' end, repeat(substring(seq, 20, 40), 7))")
    return rows.select("id", (F.col("strand") == 0).alias("f"), F.when(F.col("id") % 4 == 0, F.col("seq")).otherwise(long).alias("seq"))


@query(POLY_SQL)
def polytail_split(spark: SparkSession, d: str) -> DataFrame:
    return long_reads(spark, d).select("id", chimera.tail_cut(F.col("seq"), F.col("f")).alias("c")).select("id", "c.cut", "c.verdict")


@query(POLY_SQL.replace("SELECT id, CAST(CASE WHEN verdict = 'split' THEN cut END AS INT) AS cut, verdict FROM w", "SELECT concat(w.id, '-', k) AS id, w.id AS parent, CASE WHEN (k = 1) = f THEN substring(seq, 1, cut) ELSE substring(seq, cut + 1, length(seq)) END AS seq FROM w JOIN r USING (id), unnest([1, 2]) AS t(k) WHERE verdict = 'split'"))
def split_reads(spark: SparkSession, d: str) -> DataFrame:
    rows = long_reads(spark, d)
    return chimera.split(once(rows, "c", chimera.tail_cut(F.col("seq"), F.col("f"))).withColumn("cut", F.col("c.cut")), F.col("f"))


CLIPS = ("l_orderkey % 97", "l_partkey % 411", "l_suppkey % 89", "l_partkey % 307")
CLIP_SQL = f"""WITH c AS (SELECT concat(l_orderkey, '-', l_linenumber) AS id, 300 + l_partkey % 700 AS n, CAST(l_quantity AS INT) * 9 AS b, l_linenumber % 2 = 0 AS f, {CLIPS[0]} AS c0, {CLIPS[1]} AS c1, {CLIPS[2]} AS c2, {CLIPS[3]} AS c3 FROM lineitem),
m AS (SELECT *, CASE WHEN f THEN least(c0, c2) - b ELSE b - (n - least(c1, c3) - 1) END AS gap FROM c)
SELECT id, CAST(CASE WHEN gap >= 200 THEN NULL WHEN f THEN n - CASE WHEN c0 <= c2 THEN c1 ELSE c3 END ELSE CASE WHEN c1 <= c3 THEN c0 ELSE c2 END END AS INT) AS cut, CASE WHEN gap >= 200 THEN 'complex_fusion' ELSE 'split' END AS verdict FROM m"""


@query(CLIP_SQL)
def clip_split(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("concat(l_orderkey, '-', l_linenumber) as id", "cast(300 + l_partkey % 700 as int) as n", "cast(l_quantity as int) * 9 as b", "l_linenumber % 2 = 0 as f", *(f"cast({c} as int) as c{i}" for i, c in enumerate(CLIPS)))
    cut = chimera.clip_cut(F.col("n"), F.col("b"), F.col("f"), *(F.col(f"c{i}") for i in range(4)))
    return rows.select("id", cut.alias("c")).select("id", "c.cut", "c.verdict")


@query(X.sql("hits", "reads") + "SELECT id, strand FROM reads WHERE id IN (SELECT id FROM hits WHERE quantity > 45)")
def semi_join_chimera(spark: SparkSession, d: str) -> DataFrame:
    return chimera.of_reads(X.frame(spark, d, "reads"), X.frame(spark, d, "hits").where("quantity > 45")).select("id", "strand")


BEST_SQL = X.sql("hits") + """, m AS (SELECT id, min(quantity) AS best FROM hits GROUP BY id), t AS (SELECT id, best, count(*) AS n, min(concat('G', partkey)) AS gene FROM hits JOIN m USING (id) WHERE quantity = best GROUP BY id, best)
SELECT id, CASE WHEN n = 1 THEN gene ELSE 'Ambiguous_mapping' END AS gene, best FROM t"""


@query(BEST_SQL)
def best_hit(spark: SparkSession, d: str) -> DataFrame:
    return annotate.best_hit(X.frame(spark, d, "hits").select("id", F.concat(F.lit("G"), F.col("partkey")).alias("gene"), F.col("quantity").alias("score")))


LOOSE = EXON_SQL.split(",\nf AS")[0] + """, o AS (SELECT gene, start AS s, end_ AS e, max(end_) OVER (PARTITION BY gene ORDER BY start, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM exon_rows),
i AS (SELECT gene, s, e, sum(CASE WHEN upto IS NULL OR s > upto THEN 1 ELSE 0 END) OVER (PARTITION BY gene ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT gene, min(s) AS start, max(e) AS "end", count(*) AS members FROM i GROUP BY gene, island"""


@query(LOOSE)
def loose_exons(spark: SparkSession, d: str) -> DataFrame:
    return regions.merge(exon_rows(spark, d).select("gene", "start", "end"), "gene")


FEATURES = "[struct_pack(s := start - 10 - ord, e := end_, id := 'a'), struct_pack(s := start + quantity % 7, e := end_, id := 'b'), struct_pack(s := start - 50, e := end_ + quantity, id := 'c')]"
FEATURE_SQL = X.sql("hits") + f""", f AS (SELECT hit, start, end_, unnest({FEATURES}) AS f, unnest(range(0, 3)) AS i FROM hits), d AS (SELECT hit, f.id AS id, i, 1 - greatest(0, least(f.e, end_) - greatest(f.s, start) + 1) / CAST(f.e - f.s + 1 AS DOUBLE) AS left_ FROM f)
SELECT hit, id FROM (SELECT *, row_number() OVER (PARTITION BY hit ORDER BY left_, i) AS n FROM d) WHERE n = 1"""


@query(FEATURE_SQL)
def feature_choice(spark: SparkSession, d: str) -> DataFrame:
    """The one of several features at a hit's place of which the hit leaves least uncovered."""
    one = lambda s, e, n: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), F.lit(n).alias("id"))
    start, end = F.col("start"), F.col("end")
    features = F.array(one(start - 10 - F.col("ord"), end, "a"), one(start + F.col("quantity") % 7, end, "b"), one(start - 50, end + F.col("quantity"), "c"))
    return X.frame(spark, d, "hits").select("hit", annotate.choose_feature(start, end, features).alias("id"))


EXON_SETS = ("[ord, quantity % 3, 1]", "[quantity % 3, ord]")
EXON_SET_SQL = X.sql("hits") + f""", x AS (SELECT hit, {EXON_SETS[0]} AS a, {EXON_SETS[1]} AS b FROM hits)
SELECT hit, list_sort(a) = list_sort(b || [1]) AS same, list_sort(a) = list_sort(b) AS shorter, len(list_filter(b, lambda x: len(list_filter(a, lambda y: y = x)) < len(list_filter(b, lambda y: y = x)))) = 0 AS holds, len(list_filter(a, lambda x: len(list_filter(b, lambda y: y = x)) < len(list_filter(a, lambda y: y = x)))) = 0 AS held FROM x"""


@query(EXON_SET_SQL)
def exon_sets(spark: SparkSession, d: str) -> DataFrame:
    """Whether lists of exons hold the same ones, or one all of the other."""
    a, b = F.array("ord", F.col("quantity") % 3, F.lit(1)), F.array(F.col("quantity") % 3, F.col("ord"))
    return X.frame(spark, d, "hits").select("hit", I.same_exons(a, F.concat(b, F.array(F.lit(1)))).alias("same"), I.same_exons(a, b).alias("shorter"), I.contains_exons(a, b).alias("holds"), I.contains_exons(b, a).alias("held"))


REPORT_SQL = POLY_SQL.rsplit("SELECT id, CAST", 1)[0] + "SELECT CAST(id AS STRING) AS read_id, CASE verdict WHEN 'split' THEN concat(id, '-1,-2') ELSE CAST(id AS STRING) END AS children, CAST(id % 90 AS INT) AS barcode_start, CAST(CASE verdict WHEN 'split' THEN cut ELSE -1 END AS INT) AS cut, CASE verdict WHEN 'split' THEN 'splited' ELSE verdict END AS verdict FROM w"


@query(REPORT_SQL)
def split_report(spark: SparkSession, d: str) -> DataFrame:
    """The report on reads that are split at their tails."""
    rows = once(long_reads(spark, d), "c", chimera.tail_cut(F.col("seq"), F.col("f")))
    return chimera.split_report(rows.select("id", (F.col("id") % 90).cast("int").alias("barcode_start"), "c.cut", "c.verdict"))
