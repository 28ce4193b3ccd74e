"""Sequencing tables derived from the generic ones, by expressions that both SQL dialects read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.operators.chemistry import R1, TSO, reverse_complement


def dna(key: str) -> str:
    """32 bases of a key."""
    return f"translate(md5(cast({key} as string)), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def barcode(key: str) -> str:
    return f"substring({dna(f"concat('bc', {key})")}, 1, 16)"


def mutated(seq: str, place: str) -> str:
    """seq with the base at a 1-based place replaced by the next one."""
    return f"concat(substring({seq}, 1, cast({place} as int) - 1), translate(substring({seq}, cast({place} as int), 1), 'ACGT', 'CGTA'), substring({seq}, cast({place} as int) + 1, 99))"


K = "o_orderkey"
CORE = (
    f"concat(substring({dna(f"concat('pre', {K})")}, 1, cast({K} % 13 as int)), case when {K} % 7 = 0 then '' else '{R1}' end, "
    f"case when {K} % 5 = 0 then {mutated(barcode('o_custkey'), f'1 + {K} % 16')} else {barcode('o_custkey')} end, "
    f"substring({dna(f"concat('umi', {K})")}, 1, 10), case when {K} % 11 = 0 then '' else '{TSO}' end, {dna(f"concat('body', {K})")}, "
    f"case when {K} % 3 = 0 then 'AAAAAAAAAAAAAA' else 'AAAAA' end)"
)

def edited(seq: str, key: str) -> str:
    """A literal that is whole, or has a base replaced, left out or put in, by a key."""
    n = len(seq)
    cut = f"cast(1 + {key} % {n - 2} as int)"
    return (
        f"case cast({key} % 4 as int) when 0 then '{seq}' when 1 then {mutated(f"'{seq}'", f'1 + {key} % {n}')} "
        f"when 2 then concat(substring('{seq}', 1, {cut}), substring('{seq}', {cut} + 2, 99)) else concat(substring('{seq}', 1, {cut}), 'G', substring('{seq}', {cut} + 1, 99)) end"
    )


#: Reads whose adapters have edits, of which some have none, or one at either end.
NOISY = (
    f"concat(substring({dna(f"concat('pre', {K})")}, 1, cast({K} % 13 as int)), case when {K} % 7 = 0 then '' else {edited(R1, K)} end, "
    f"case when {K} % 5 = 0 then {mutated(barcode('o_custkey'), f'1 + {K} % 16')} else {barcode('o_custkey')} end, "
    f"substring({dna(f"concat('umi', {K})")}, 1, 10), case when {K} % 11 = 0 then '' else {edited(TSO, f'({K} + 1)')} end, {dna(f"concat('body', {K})")}, {dna(f"concat('more', {K})")}, {dna(f"concat('rest', {K})")}, "
    f"case when {K} % 3 = 0 then 'AAAAAAAAAAAAAA' else 'AAAAA' end, case when {K} % 17 = 0 then '{reverse_complement(R1)}' else '' end)"
)
#: (table, columns) by name.
TABLES = {
    "whitelist": ("customer", ["c_custkey as ordinal", f"{barcode('c_custkey')} as barcode"]),
    "reads": ("orders", [f"{K} as id", f"case when {K} % 2 = 1 then translate(reverse({CORE}), 'ACGT', 'TGCA') else {CORE} end as seq", f"cast({K} % 2 * 3 as int) as strand"]),
    "noisy": ("orders", [f"{K} as id", f"case when {K} % 2 = 1 then translate(reverse({NOISY}), 'ACGT', 'TGCA') else {NOISY} end as seq"]),
    "genes": (
        "part",
        ["p_partkey as gene", "concat('chr', p_partkey % 5) as chrom", "cast(p_partkey * 100 as int) as g_start", "cast(p_partkey * 100 + 200 + p_size * 20 as int) as g_end", "case when p_partkey % 2 = 0 then '+' else '-' end as g_strand", "p_name as gene_name"],
    ),
    "hits": (
        "lineitem",
        [
            "concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey, '-', cast(l_quantity as int), '-', cast(l_discount * 100 as int)) as hit",
            "l_orderkey as id",
            "concat('chr', l_suppkey % 5) as chrom",
            "cast(l_partkey * 100 + l_suppkey % 50 as int) as start",
            "cast(l_partkey * 100 + l_suppkey % 50 + 40 + l_quantity * 10 as int) as end_",
            "case when l_linenumber % 2 = 0 then '+' else '-' end as strand",
            "cast(l_linenumber as int) as ord",
            "cast(1 + l_linenumber * 60 + l_quantity as int) as q_start",
            "cast(1 + l_linenumber * 60 + l_quantity + 30 + l_discount * 1000 as int) as q_end",
            "l_partkey as partkey",
            "l_suppkey as suppkey",
            "cast(l_quantity as int) as quantity",
        ],
    ),
    "clones": ("events", ["concat('C', user_id % 12) as clone", f"concat(event_id, '_', {barcode('user_id')}) as read", "event_type as locus", "event_id as id", "cast(abs(value) as double) as value"]),
}


def cigar(n: str) -> str:
    """A CIGAR string that varies with a number."""
    return (
        f"concat(case when {n} % 3 = 0 then '' else concat(1 + {n} % 40, case when {n} % 2 = 0 then 'S' else 'H' end) end, 20 + {n} % 60, 'M', "
        f"case when {n} % 4 = 0 then concat(100 + {n} % 900, 'N', 10 + {n} % 30, 'M') else '' end, case when {n} % 5 = 0 then concat(1 + {n} % 7, 'D', 5 + {n} % 9, 'M') else '' end, "
        f"case when {n} % 7 < 3 then '' else concat(1 + {n} % 33, 'S') end)"
    )


def spread(df: DataFrame) -> DataFrame:
    """Keys of reads, dealt to twice as many tasks as there are cores: a small file of keys is one task, but its reads are long work."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


#: Columns of the tables that are spread before sequences are made of them.
READ_KEYS = {"noisy": (K, "o_custkey"), "reads": (K, "o_custkey")}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = TABLES[name]
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    out = (spread(rows.select(*READ_KEYS[name])) if name in READ_KEYS else rows).selectExpr(*columns)
    return out.withColumnRenamed("end_", "end") if "end_" in out.columns else out


def sql(*names: str) -> str:
    """A WITH clause that defines the tables for the other dialect."""
    parts = [f"{n} AS (SELECT {', '.join(TABLES[n][1])} FROM {TABLES[n][0]})" for n in names]
    return "WITH " + ", ".join(parts) + " "


R1_REVERSED, TSO_REVERSED = reverse_complement(R1), reverse_complement(TSO)
