"""The corpus pipeline: quality, exact copies, near copies, source mix, token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewake.llm import bpe, exact_dedup, mixing, quality, simhash
from tidewake.llm.common import Scratch, passing, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the top grade is a half or more stay; the model is fitted on the labelled documents."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash fingerprints the one with the smallest doc_id stays."""
    return simhash.drop_near_copies(docs)


def drop_near_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same where 5-word shingles of a Jaccard similarity of 0.8 link as well."""
    return simhash.drop_near_copies(docs, jaccard=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Half of the tokens, as the tokenizer counts them, shared out over domains, languages and sources by the production weights; one epoch, so no document comes twice."""
    return mixing.production_mix(docs, share_of_tokens=0.5, max_epochs=1, tokenizer=public_tokenizers.path(bpe.COUNTER)).select(*docs.columns)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return bpe.encode(docs, public_tokenizers.path(bpe.RANKS))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_texts),
    ("source mixing", mix_sources),
    ("byte bpe", encode_bytes),
]

#: SQL can't express the classifier, SimHash or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's own tables, and its input once it is passed, are dropped."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        with passing():
            docs = scratch.save(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            scratch.drop(f"stage{k - 1}")
    return docs
