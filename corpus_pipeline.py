"""From raw documents to token ids, stage by stage. Each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, decontaminate, simhash, suffix_dedup, toxicity
from tallyloom.llm.common import finished, materialize, release, table
from tallyloom.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. Null and empty texts stay, repeated rows are judged alike, an empty table stays empty, all columns are kept."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest doc_id, null behind all others. Rows equal in doc_id and text become one; null, empty and wordless texts are near copies of each other."""
    return simhash.keep_first(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its text without the strings of 200 bytes that stand elsewhere too. Null texts stay null; n_chars, if there is one, follows the text."""
    return suffix_dedup.rewrite_texts(docs, 200)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item. By row and not by doc_id, which may be null or stand for several texts; null and empty texts stay; an empty benchmark drops nothing."""
    keyed = docs.withColumn("__key", simhash.row_key())
    leaks = decontaminate.find_leaks(keyed.select(F.col("__key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return keyed.join(materialize(leaks.select(F.col("doc_id").alias("__key")).distinct()), "__key", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, and the SHA-256 of the text that they decode to; no other columns. Null and empty texts have no tokens, repeated rows and null ids stay, an empty table stays empty."""
    done = bpe.encode_documents(docs, vocabulary())
    return done.select("doc_id", "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("bpe", encode),
]

#: Kernels, graph components and byte-level cuts have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = finished(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir))
        if before is not None:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
