"""A training corpus from `documents`: language, near duplicates, repeated passages, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns what is left; `run` writes each stage's rows as Parquet in the
shared folder and reads them again as the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import language, mixing, near_dedup, packing, substring
from quern.llm.common import materialise, table


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn the languages from the documents that have one; those without a letter, null, or without a
    part that any language is known by (score 0) are rejected."""
    model = language.learn(docs)
    return docs.withColumn("__p", language.identify(docs, model)).where((F.col("__p.lang_pred") != language.UNKNOWN) & (F.col("__p.score") > 0)).drop("__p")


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document by id of each class of near duplicates stays."""
    return near_dedup.keep_first(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out; the documents stay, n_chars follows."""
    return substring.dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic and poor documents go until they have their target shares beside all good ones; a document that is wanted
    more than once is repeated."""
    labels = mixing.label_domains(table(spark, sf_dir, "labels"))
    mixed = mixing.mix(docs, labels, mixing.TARGETS, budget="good").where("copies > 0")
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in as few sequences of tokens as best fit finds."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", keep_one_of_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("mixing", mix_domains),
    ("packing", pack),
]

#: Shingle sketches, soft posteriors and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
