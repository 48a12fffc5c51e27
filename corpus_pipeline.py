"""The corpus pipeline: language ID, SimHash near-dedup, suffix-array dedup, secret scans, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return
the columns of documents; a stage that changes texts sets n_chars anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.llm import common as C
from tallybrook.llm import langid, packing, secrets, simhash, suffix_dedup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language ID rejects go: no letters, or far from every language learnt from rows that are not held out.

    A null text has no letters; null ids, repeated rows, texts of any length and columns of any name are as any other. If
    nothing can be learnt every document goes. An empty table stays empty.
    """
    models = langid.fit(docs.where(~langid.held_out()))
    return langid.found(docs, models).where("not found.rejected").select("own.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts (five-word shingles, similarity 0.8) stays: the one with the smallest id.

    Rows that repeat the id and text of a row go too; a null id is the smallest, a null text an empty one, and texts
    without words are alike. Rows are grouped by their texts only, so different texts of one id, or without an id, stay.
    """
    groups = simhash.similar_groups(docs, words=5, similarity=0.8)
    keep = groups.where("doc_id = component_id and text_hash = component_text").select("doc_id", "text_hash").distinct()
    own = docs.select(F.struct("*").alias("row"), C.id_column(), simhash.text_hash().alias("text_hash"))
    return own.join(keep, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"]).select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 100 bytes that stand earlier too are cut out; a character that is cut in two goes whole.

    Documents of which no more than white space is left go; others of any text, null and empty ones too, stay. Null
    ids come first; rows of one id keep their own results, and equal rows have equal ones.
    """
    removed = C.free_name(docs, "n_removed")
    left = suffix_dedup.without_repeats(docs, width=100, into=removed)
    cut = F.col(removed) > 0
    left = left.where(~cut | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; every document stays, with its other columns, be its text null, empty or long."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: a row per piece of each document. A null text is the end id alone; null and
    repeated ids are packed like any other."""
    return packing.pack_documents(docs, capacity=1024)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("best_fit_packing", pack),
]

#: SQL can't express these stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = C.materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if written is not None:
            C.discard(written)
        written = docs
    out = STAGES[-1][1](spark, docs, sf_dir)
    C.discard(written)  # the packed rows come from tables of their own
    return out
