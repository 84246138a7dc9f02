"""Token counts of whole texts.

An Arrow function gets batches of texts, cuts long ones at safe boundaries,
encodes pieces in batches balanced by bytes, one library call for each, and
returns lengths only; ids never leave the Python worker. There is no shuffle.

Null and empty texts count 0 tokens and 0 bytes. Extra columns of the input are
dropped; repeated rows stay. An empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.llm import bpe
from foliolake.llm.storage import plain, table

LIMIT = 1024


def token_count(text: Column, vocabulary: str = bpe.VOCABULARY) -> Column:
    """The number of tokens of each text, as a long."""

    @F.arrow_udf("long")
    def lengths(texts: pa.Array) -> pa.Array:
        return pa.array(bpe.encoder(vocabulary).counts(plain(texts)), pa.int64())

    return lengths(text)


def token_counts(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), token_count(text).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
