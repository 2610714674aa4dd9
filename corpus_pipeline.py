"""From raw documents to packed sequences: five stages, each written down before the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexsift.llm import mixing, neartext, packing, pii, toxicity
from lexsift.llm.common import materialise, remove, scope


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not take for toxic."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of texts with a five-word similarity of 0.8 or more."""
    return neartext.keep_first(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample calibrated to the target margins of source, language and topic."""
    return mixing.sample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces dealt into sequences of at most 2048."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", one_of_near_copies),
    ("pii", mask_personal_data),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Trained classifiers and a tokenizer are beyond SQL; the tests rebuild the result plainly.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn.  What a stage wrote down is removed once its result is, as is the result that it read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    read: list[str] = []
    for at, (name, stage) in enumerate(STAGES):
        if at + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with scope() as made:
            docs = materialise(stage(spark, docs, sf_dir), name)
        remove(spark, [*read, *made[:-1]])
        read = made[-1:]
    return docs
