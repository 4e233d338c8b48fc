"""The corpus pipeline: five stages, each a numbered operator at work on what its predecessor kept.

1. quality classifier: documents scored below 0.3 go;
2. exact dedup: one row of each group of equal texts stays;
3. n-gram Jaccard join: one document of each group stays, over five-word shingles at 80 % Jaccard;
4. mixing: sources come near their target weights, whole documents repeated or left out, in training order;
5. BPE: each text as token ids, with the digest of what they decode to.

Defined cases
    * without labels every document is kept by the first stage, whose score is then 0.5;
    * null texts count as empty: one of them stays, is similar to nothing, and is mixed in no times, having no words;
    * null ids are ids like any other, the largest where one has to stay; repeated rows are exact copies;
    * an empty table gives an empty result at every stage; further columns, whatever their names, pass through to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from navloom.llm import bpe, exact_dedup, mixing, ngram_join, quality


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def drop_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each_class(docs, words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", classify),
    ("exact dedup", drop_equal),
    ("n-gram Jaccard join", drop_similar),
    ("mixing sources to target weights", mix),
    ("BPE encoding and decoding", encode),
]

#: SQL can express neither the fitted rules nor the merges; the pipeline is tested against its operators and brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    from navloom.llm.common import shared_path

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
