"""A corpus pipeline over documents(doc_id, text, lang, source, n_chars), each stage one of the operators.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs, with their columns; the last returns the
token-id digest of the documents kept. run() writes each stage's rows as Parquet to the shared folder and reads
them again as the next one's docs, so a lost executor costs no more than a part of one stage.

Every stage takes nulls in any column, empty and very long texts, repeated rows, extra columns of any name and tables without
rows; what it does with them is stated with the stage. Columns and types stay those of docs up to the last stage.

This module needs the subpackage deltaloom.llm and can't be imported without it; __spark_entry__.py can.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from deltaloom.llm import decontam, langid, mixing, simhash, tokenbin
from deltaloom.llm.common import materialise, tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a letter, or without a language more likely than all others together, go. Null and empty texts have no letter;
    repeated rows share their fate. Learns from the rows with a lang; without any, rows with a letter stay."""
    return langid.without_unknown(docs, tokenizer_path("piece_bpe_32k.model"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the row with the least doc_id stays.

    Decided by row: different texts of one doc_id both stay, of rows that repeat id and shingles one does. Rows without an id
    stay; null and empty texts with one are a group.
    """
    return simhash.keep_one(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark passage go. Null and empty texts hold none; repeated rows share their fate; without items all stay."""
    return decontam.without_leaks(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are sampled towards tempered source, language and topic weights. Nulls are a value of their own; texts without words stay
    once; rows that share id and cell share their draw."""
    return mixing.mixed(spark, docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the rows, written as binary shards and read back. Null texts are empty; null ids come
    first; repeated rows have a place each."""
    return tokenbin.digest(spark, docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("token_ids", token_ids),
]
#: Fitted language models, fingerprints and subword ids are beyond SQL. tests/llm holds the stages against brute force on a small
#: fixture, nulls, repeats and empty tables among it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(spark, docs, name)
    return docs
