"""The registered queries of this subpackage. Each applies an operator to a whole table and derives the columns asked for from its output."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import ann, bpe, chat, ctw, importance, packing, quality_rules, simhash, token_orc, tokens, warc
from helixframe.llm.common import new_path, table, texts, tidy


def op1_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.load()
        decimal = [str(i) for i in range(encoder.size)]
        for b in tokens.decode_batches(tokens.encode_batches(batches, encoder=encoder), encoder=encoder):
            ids = list(tokens.list_parts(b.column(b.schema.get_field_index("ids"))))
            decoded = b.column(b.schema.get_field_index("decoded")).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(",".join(map(decimal.__getitem__, x.tolist())).encode()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return texts(table(spark, sf_dir, "documents")).mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-orc")
    token_orc.write_token_orc(table(spark, sf_dir, "documents"), path, end=2)
    rows = packing.with_crc(token_orc.read_token_orc(spark, path))
    return rows.selectExpr("doc_id", "start", "cast(n_tokens as long) n_tokens", "ids_crc32")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.rate(table(spark, sf_dir, "documents"))
    asked = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select("doc_id", *(F.col(f"s.{c}").alias(c) for c in asked), F.col("failed").alias("base_failed"), "kept", "mahalanobis")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), length=2048, end=1, crc=True)


def op7_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ctw.score(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", both), (-7, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.format_turns(rows))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_records(warc.archive_pages(spark, table(spark, sf_dir, "pages")))


QUERIES = {
    "op1_importance": op1_importance,
    "op2_bpe": op2_bpe,
    "op3_simhash": op3_simhash,
    "op4_token_orc": op4_token_orc,
    "op5_quality_rules": op5_quality_rules,
    "op6_packing": op6_packing,
    "op7_ctw": op7_ctw,
    "op8_ann": op8_ann,
    "op9_chat": op9_chat,
    "op10_warc": op10_warc,
}
CONTROL_SQL = "|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]).replace("\\/", "/") for c in sorted(chat.CONTROL, key=len, reverse=True))
ESCAPES_SQL = f"len(regexp_extract_all(role, '{CONTROL_SQL}')) + len(regexp_extract_all(text, '{CONTROL_SQL}'))"
#: The other queries rest on vocabularies, XXH64, fitted models or approximate search, which SQL doesn't express; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op9_chat": f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
CAST(sum(length(role) + length(text) + {sum(map(len, chat.MARKS))} + {ESCAPES_SQL}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id""",
    "op10_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages), d AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest, max(page_id) OVER (PARTITION BY payload) AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {warc.LEAST_BYTES} AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN payload_bytes >= {warc.LEAST_BYTES} AND page_id <> kept THEN kept END AS refers_to FROM d""",
}
