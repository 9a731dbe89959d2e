"""A corpus from raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, folder of the tables) and returns rows with the columns of ``documents``, the last one the
pieces of packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import language, mixing, neardup, packing, pii
from tallyloom.llm.queries import KEY
from tallyloom.session import prepare, work_folder

#: An ambiguous text goes if its best language isn't at least this likely.
LEAST_SCORE = 0.6
#: Texts that share this many hundredths of their five-word shingles are near duplicates.
SIMILAR = 80
#: Seed of the hashes that choose the documents of the mix.
SEED = 17


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts of no language: null, without a letter, or ambiguous between languages."""
    found = language.identify(docs, language.train(language.sample(docs)))
    unsure = F.col("language.ambiguous") & (F.col("language.score") < LEAST_SCORE)
    return found.where((F.col("language.lang_pred") != language.UNKNOWN) & ~unsure).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return neardup.deduplicate(docs, SIMILAR)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to pseudonyms, and n_chars follows the text."""
    return pii.protect(docs, KEY).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.mix(docs, SEED)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and where they are in which sequence. A document that the mix repeats is there as often."""
    pieces, places = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    digest = pieces.select("row_id", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return digest.join(places, ["row_id", "piece"]).drop("row_id")


STAGES = [
    ("language", known_language), ("near_duplicates", one_of_each), ("pseudonyms", pseudonyms), ("mix", mixed), ("pack", packed),
]
#: Learned models and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
