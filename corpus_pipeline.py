"""A training-data pipeline over ``documents``: language ID, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read
again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentinela.llm import common, language, mixing, near, packing, pii, queries


def _stage(run):
    """Each stage starts when the one before has been written, so that the driver need not keep anything of it."""

    @functools.wraps(run)
    def start(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.give_back(spark)
        return run(spark, docs, sf_dir)

    return start


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what language ID accepts; lang becomes the predicted language. Learns from the labelled rows of docs.

    A null text, or one without a letter, is rejected; null ids and repeated rows are predicted each; without labels
    nothing stays; an empty table gives an empty one.
    """
    model = language.train(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    out = language.predict(docs, model).filter("not lang_rejected")
    return out.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (words in fives, 0.8 or more) stays: the one with the least id, null last.

    Rows without words are in no group and stay; of repeated rows one stays; an empty table gives an empty one.
    """
    row, key = common.unused(docs, "_row", "_row_key")
    rows = common.materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near.near_duplicates(rows, width=5, threshold=80, row=row)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))["row_key"]
    stay = found.filter("group is not null").groupBy("group").agg(first.alias(key)).select(key)
    stay = stay.union(found.filter("group is null").select("row_key"))
    return rows.withColumn(key, near.row_bytes(F.col(row))).join(stay, key).select(*docs.columns)


@_stage
def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its text pseudonymised; a null text stays null, with n_chars null."""
    out = pii.pseudonymise(docs.select("*"), queries.PII_KEY)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: runs of blocks of the documents, repeats as repeated rows; rows without words go."""
    out = mixing.mixed_texts(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, packed; null ids are kept and repeated rows packed once each."""
    return packing.pack_documents(docs, queries.vocabulary_path())


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL cannot express language ID, tokenizing or the keyed draws; tests/llm/test_pipeline.py holds stages against known results on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
