"""Corpus preparation in five stages, each on all that the one before kept.

Language identification drops documents without a language, exact deduplication keeps one row of each text (the largest
id), the n-gram join keeps the smallest id of each component of near copies (five words, Jaccard 0.8), decontamination
drops documents that hold a benchmark item, and the tokenizer turns what is left into ids. Each stage's rows are written
as Parquet in the shared folder and read again by the next; a stage's folder goes when the next one is written.

Defined results: null texts and texts without a letter go in the first stage. Ids may be null or repeated: a stage
drops rows, not ids, so rows of one id with different texts are judged each; a null id counts as the largest where the
smallest stays and as the smallest where the largest stays. Columns other than doc_id, text and lang are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm import bpe, decontaminate, exact_dedup, langid, ngram_join
from platewise.llm.common import discard, materialize, table
from platewise.llm.queries import rank_file


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs, langid.train(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.distinct_texts(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each_component(docs, n=5, num=80, den=100)


def benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, rank_file()).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard", near_copies),
    ("decontamination", benchmark_copies),
    ("byte_bpe", token_ids),
]

#: No SQL: the stages learn models and follow links; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
        if written is not None:
            discard(written)
        written = docs
    return docs
