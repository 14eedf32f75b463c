"""From raw documents to token ids in five stages: clean, fold near copies, cut repeats, decontaminate, encode.

Every stage takes the rows that its predecessor kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrail.llm import bpe, lines, near_dups, substrings, templates
from voltrail.llm.common import column, stored, together


def _with_size(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, with n_chars (if there) of the text as it is now."""
    if "n_chars" in columns:
        df = df.withColumn("n_chars", F.length("text").cast("long"))
    return df.select(*map(column, columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail the rules go, then documents that fail the base rules or lost too much text."""
    one = docs.select("doc_id", "text", together([c for c in docs.columns if c not in ("doc_id", "text")]))
    kept = lines.clean_lines(one, carry=("rest",)).where("kept")
    return _with_size(kept.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns)), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar sets of five-word shingles, the one with the smallest id stays."""
    return near_dups.kept_documents(docs, near_dups.Join(shingle=5)).select(*map(column, docs.columns))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that documents of smaller ids hold too go. The window is a little under 50 words, so that a passage
    of over 50 is found even if words at its ends differ; lines that many documents share are shorter."""
    return _with_size(substrings.remove_repeats(docs, window=45, counts=()), docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold items of the benchmark go."""
    return templates.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*map(column, docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and tokens of each document."""
    carry = tuple(c for c in ("lang", "source") if c in docs.columns)
    coded = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, carry=carry)
    return coded.select("doc_id", *carry, F.size("tokens").cast("long").alias("n_tokens"), "tokens")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("decontaminate", decontaminate), ("encode", encode)]

#: Near duplicates and encoding are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
