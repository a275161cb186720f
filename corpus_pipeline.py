"""Documents to a training mix, in stages that are each written and read again."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, exact_dedup, langid, minhash, mixing
from plumbline.llm.common import remove, sha256, shared_folder


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents whose language the network tells as surely as those it was held out from; without a letter they go."""
    return langid.recognized(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: of equal texts the one with the largest doc_id."""
    return exact_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: one document of each component of near-duplicates, that of the smallest doc_id.

    Documents link at a similarity of 0.8 of their 5-word shingles or more: fingerprint links, completed and verified.
    """
    return minhash.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: documents as often as the mix of sources takes them, in the order of its schedule."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: the token ids of every document of the mix, and a check of their decoding."""
    done = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id", "lang", "source"], decoded="decoded")
    return done.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), sha256(F.col("decoded")).alias("decoded_sha256"))


STAGES = [
    ("language_id", in_a_language),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("source_mix", mixed),
    ("bpe", encoded),
]

#: SQL can express neither the network nor the near copies; tests/llm/test_pipeline.py has a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and reread."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if k:  # what the stage before has left isn't read again
            remove(spark, f"{folder}/{STAGES[k - 1][0]}")
    return docs
