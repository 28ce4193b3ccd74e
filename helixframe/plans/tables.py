"""Queries on clones, sets and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators import annotate, calls, clones
from helixframe.plans import fixtures as X
from helixframe.plans.registry import query


MEMBERS = ", m AS (SELECT clone, string_split(read, '_')[2] AS barcode FROM clones)"
CLONES = [f"C{i}" for i in range(12)]


def members(spark: SparkSession, d: str) -> DataFrame:
    """Members of clones whose reads are listed comma by comma, as the reports give them; a list per clone and hour."""
    rows = X.frame(spark, d, "clones").withColumn("part", F.col("id") % 64)
    return clones.clone_reads(rows.groupBy("clone", "part").agg(F.array_join(F.collect_list("read"), ",").alias("reads")))


@query(X.sql("clones").rstrip() + MEMBERS + " SELECT clone, barcode, count(*) AS n FROM m GROUP BY clone, barcode")
def clone_counts(spark: SparkSession, d: str) -> DataFrame:
    return members(spark, d).groupBy("clone", "barcode").agg(F.count("*").alias("n"))


WIDE = ", ".join(f"count(CASE WHEN clone = '{c}' THEN 1 END) AS \"{c}\"" for c in CLONES)
MATRIX = X.sql("clones", "whitelist").rstrip() + MEMBERS + f", u AS (SELECT DISTINCT barcode FROM whitelist), wide AS (SELECT u.barcode, {WIDE} FROM u LEFT JOIN m USING (barcode) GROUP BY u.barcode)"


@query(MATRIX + " SELECT * FROM wide")
def clone_matrix(spark: SparkSession, d: str) -> DataFrame:
    return clones.clone_matrix(members(spark, d), CLONES, X.frame(spark, d, "whitelist"))


@query(MATRIX + " SELECT clone, CAST(sum(n) AS BIGINT) AS total, count(CASE WHEN n > 0 THEN 1 END) AS n_barcodes FROM (UNPIVOT wide ON COLUMNS(* EXCLUDE barcode) INTO NAME clone VALUE n) GROUP BY clone")
def clone_totals(spark: SparkSession, d: str) -> DataFrame:
    return clones.totals(clone_matrix(spark, d), CLONES)


THRESHOLDS = [60, 65, 70, 75, 80, 85, 90, 95]
IDENTITY = X.sql("clones") + """, i AS (SELECT id % 4000 AS id, id % 2 AS side, least(value % 101, (value * 7) % 101) AS level FROM clones), a AS (SELECT id, max(level) AS a FROM i WHERE side = 0 OR id % 3 = 0 GROUP BY id), b AS (SELECT id, max(level) AS b FROM i WHERE side = 1 OR id % 3 = 0 GROUP BY id),
f AS (SELECT coalesce(a, -1) AS a, coalesce(b, -1) AS b FROM a FULL JOIN b USING (id))"""


def identities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = X.frame(spark, d, "clones").select((F.col("id") % 4000).alias("id"), (F.col("id") % 2).alias("side"), (F.col("value") % 101).alias("v_identity"), ((F.col("value") * 7) % 101).alias("j_identity"))
    return rows.where("side = 0 or id % 3 = 0"), rows.where("side = 1 or id % 3 = 0")


@query(IDENTITY + f" SELECT CAST(t AS INT) AS threshold, count(CASE WHEN a > t AND b > t THEN 1 END) AS shared, count(CASE WHEN a > t AND NOT b > t THEN 1 END) AS only_a, count(CASE WHEN b > t AND NOT a > t THEN 1 END) AS only_b FROM f, unnest({THRESHOLDS}) AS u(t) GROUP BY t")
def identity_sweep(spark: SparkSession, d: str) -> DataFrame:
    return clones.identity_sweep(*identities(spark, d), THRESHOLDS)


SETS = X.sql("clones") + ", s AS (SELECT DISTINCT string_split(read, '_')[2] AS barcode, CASE WHEN value > 50 THEN locus END AS locus FROM clones)"


def set_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = X.frame(spark, d, "clones").select(F.split("read", "_")[1].alias("barcode"), F.when(F.col("value") > 50, F.col("locus")).alias("locus"))
    return rows.where("locus = 'click'").select("barcode"), rows.where("locus = 'purchase'").select("barcode")


@query(SETS + " SELECT barcode FROM s WHERE locus = 'click' INTERSECT SELECT barcode FROM s WHERE locus = 'purchase'")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    a, b = set_rows(spark, d)
    return a.intersect(b)


@query(SETS + " SELECT barcode FROM s WHERE locus = 'click' EXCEPT SELECT barcode FROM s WHERE locus = 'purchase'")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    a, b = set_rows(spark, d)
    return a.subtract(b)


@query(X.sql("clones") + ", n AS (SELECT clone, locus, count(*) AS n FROM clones GROUP BY clone, locus) SELECT clone, locus, n, round(n / sum(n) OVER (PARTITION BY clone), 6) AS share FROM n")
def locus_share(spark: SparkSession, d: str) -> DataFrame:
    return clones.shares(X.frame(spark, d, "clones"), "clone", "locus")


@query(X.sql("whitelist") + "SELECT ordinal AS name, CAST(p AS INT) AS pos, substring(barcode, p, 1) AS residue FROM whitelist, unnest(range(1, 17)) AS t(p)")
def msa_long(spark: SparkSession, d: str) -> DataFrame:
    return clones.alignment_long(X.frame(spark, d, "whitelist"), F.col("ordinal"), F.lower("barcode"))


@query(X.sql("hits") + "SELECT id, hit FROM (SELECT id, hit, row_number() OVER (PARTITION BY id ORDER BY ord DESC, hit) AS n FROM hits) WHERE n = 1")
def latest_wins(spark: SparkSession, d: str) -> DataFrame:
    return annotate.latest(X.frame(spark, d, "hits"), "id", "hit", "ord")


@query(X.sql("reads", "hits") + "SELECT reads.id, coalesce(min('G' || partkey), 'non-transcriptome') AS annotation, count(hit) AS n_hits FROM reads LEFT JOIN hits ON hits.id = reads.id AND hits.quantity > 25 GROUP BY reads.id")
def read_annotation_join(spark: SparkSession, d: str) -> DataFrame:
    hits = X.frame(spark, d, "hits").where("quantity > 25").select("id", F.concat(F.lit("G"), F.col("partkey")).alias("gene"))
    return calls.annotated(X.frame(spark, d, "reads").select("id"), hits)


@query(X.sql("clones") + "SELECT locus, count(*) AS n, count(CASE WHEN id % 3 > 0 THEN 1 END) AS productive FROM clones WHERE value % 101 > 40 AND (value * 7) % 101 > 40 GROUP BY locus")
def identity_filter(spark: SparkSession, d: str) -> DataFrame:
    """Sequences above an identity, and the productive ones among them, by locus."""
    rows = X.frame(spark, d, "clones").select("locus", (F.col("value") % 101).alias("v_identity"), ((F.col("value") * 7) % 101).alias("j_identity"), F.when(F.col("id") % 3 > 0, "Yes").otherwise("No").alias("productive"))
    every = clones.passing(rows, 40).groupBy("locus").agg(F.count("*").alias("n"))
    some = clones.passing(rows, 40, productive=True).groupBy(F.col("locus").alias("p_locus")).agg(F.count("*").alias("productive"))
    return every.join(some, F.col("locus").eqNullSafe(F.col("p_locus")), "left").select("locus", "n", F.coalesce("productive", F.lit(0)).alias("productive"))
