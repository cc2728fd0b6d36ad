"""The corpus pipeline: documents in known languages, near-distinct, without personal data, mixed to target weights,
and packed into sequences. Each stage reads what the one before wrote."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import langid, minhash, mixing, packing, pii
from keyloom.llm.common import read_table, stage_table, staged, sweep


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the field knows; it learns from this corpus's own labels."""
    return langid.keep_identified(docs, langid.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five words, a similarity of 0.8 or more."""
    return minhash.near_distinct(docs, k=5, percent=80)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(docs, pii.key_of(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mixing schedule, over and within the written parts."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The language field is a trained model, which SQL can't express; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = read_table(spark, sf_dir, "documents"), staged()
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name, codec="snappy")
        sweep(spark, mark, docs)  # what the stage read and wrote on its way is not needed any more
    return STAGES[-1][1](spark, docs, sf_dir)
