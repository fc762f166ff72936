"""Stages that turn the documents table into training data.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept:

1. toxicity: documents that the segment scorer predicts toxic go. It learns from the
   labels of documents outside the held-out fold, within the documents given.
2. near duplicates: of each component of the exact n-gram Jaccard join one document stays.
3. substring dedup: passages of 35 words or more that occur elsewhere go from the texts;
   n_chars follows the text.
4. mixing: documents are drawn so that sources, languages and topics meet tempered weights.
5. byte-level BPE: ids of every text, checked by decoding them.

All but the last return the columns of documents, and further ones as they are (the last replaces
ids and n_tokens). Null and empty texts are never toxic, link with nothing, lose nothing, are drawn
at the rate that MIX keeps, and have no ids; texts count whole, however long; rows with a null id
stay rows of their own; of rows equal in id and text the second stage keeps one, of other ties the
smallest hash of the text; an empty table passes every stage without a row. ORACLE_SQL is None: SQL cannot express
the learned scorer, the join's components or BPE; tests hold the stages against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from signalpanel.llm import bpe, common, jaccard, mixing, queries, substring, toxicity

#: Milder than the operator's defaults: four fifths of all tokens stay.
MIX = {"keep": 0.8, "powers": {"source": 0.8, "lang": 0.9, "topic": 0.9}}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, queries.toxicity_model(spark, sf_dir, docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.dedup_texts(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs, **MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.with_ids(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    common.checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            common.release(spark)
            if k:  # the stage before has served
                common.delete(spark, f"{folder}/{k - 1}")
    return docs
