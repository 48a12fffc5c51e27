"""One query for each operator, with its production parameters, over its whole table."""

from __future__ import annotations

import hashlib
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.llm import ann, chat, fingerprints, html_text, huffman, langid, negatives, packing, pieces, repair, secrets, simhash
from tallybrook.llm.suffix_dedup import dedup_substrings


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), width=100, keep=None).drop("kept")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_next(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(batches):
        for frame in batches:
            yield frame[["doc_id", "n_pieces", "ids_crc32"]].assign(decoded_sha256=[hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in frame["decoded"]])

    return pieces.round_trip(table(spark, sf_dir, "documents"), then=digest, schema="doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string")


def op4_huffman_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(batches):
        for frame in batches:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "start": frame["start"], "n_tokens": frame["n_tokens"], "ids_crc32": [zlib.crc32(x) for x in frame["ids"]]})

    files = huffman.encode_corpus(table(spark, sf_dir, "documents"))
    return huffman.decode_corpus(files, digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), capacity=1024)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where("vec_id % 20 = 0"), k=20)


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, k, role, "</s>[INST] ok [/INST]") for k, role in enumerate(("user", "assistant"))], rows.schema)
    return chat.digests(chat.format_conversations(rows.unionByName(odd)))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(*repair.damage(table(spark, sf_dir, "conversations")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.usable(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(rows, rows.where("vec_id % 100 = 0"))


def queries() -> dict:
    own = (
        op1_suffix_array_dedup,
        op2_document_fingerprints,
        op3_sentencepiece,
        op4_huffman_tokens,
        op5_best_fit_packing,
        op6_language_id,
        op7_simhash_near_dedup,
        op8_nearest_neighbours,
        op9_html_main_text,
        op10_secret_scan,
        op11_chat_format,
        op12_conversation_repair,
        op13_hard_negatives,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op11_chat_format": chat.oracle_sql(), "op13_hard_negatives": negatives.ORACLE_SQL}
