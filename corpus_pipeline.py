"""The corpus pipeline: language ID, quality rules, exact dedup, MinHash near-dedup, packing.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame, which is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of ``docs``, whatever other columns there
are besides doc_id, text and lang, and whatever their names; an empty table gives an empty table in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella import storage
from tessella.llm import exact_dedup, language, minhash, packing, quality


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the model is learned from ``docs`` itself.

    Texts without a letter go, null and empty ones too, and all texts if no row has both text and language. Very long texts
    are scored whole, repeated rows alike; of equally likely languages, a posterior of a half is enough to stay.
    """
    return language.accepted(docs, language.op3_model(docs))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are near a language's histograms, which are learned from ``docs``.

    Texts of fewer than 50 words go, null and empty ones too. Rows without a language are judged like all others, but not
    learned from. Very long texts are judged whole, repeated rows alike.
    """
    return quality.accepted(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one document: that of smallest id, before all that have none.

    Null texts equal empty ones. Of rows that also share their id, one stays. Very long texts are compared whole.
    """
    return exact_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with a similarity of 0.8 or more in five-word shingles, that of smallest id.

    Blank texts are similar to none. Rows without an id stay; of rows with the same id, that of least text stays, and
    their texts link it to others. Very long texts are compared whole.
    """
    return minhash.deduplicated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences.

    A null or empty text has its end id alone; rows that share an id, or have none, are documents of their own; very long
    texts fill sequences of their own and are cut where these end.
    """
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("minhash_dedup", near_duplicates),
    ("packing", packed),
]

#: The stages hold learned models and signatures, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``.

    The tables between them lie in the shared folder; each is removed once the next is written, the last when the driver
    ends.
    """
    folder = storage.scratch(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, apply in STAGES:
        to = f"{folder}/{name}"
        apply(spark, docs, sf_dir).write.parquet(to)
        docs = spark.read.parquet(to)
        if before:
            storage.remove(spark, before)
        before = to
    return docs
