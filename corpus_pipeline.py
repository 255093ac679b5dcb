"""From raw documents to packed sequences: five stages, each written and read again.

Toxic documents go, then near duplicates (one document of each group stays),
then repeated passages, then documents that leak the benchmark; the rest is
packed.  Every stage works on all that the one before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import decontaminate, near_dups, packing, repeats, toxicity
from tablewright.llm.common import corpus, text_or_empty, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones, doesn't call toxic."""
    score = toxicity.toxicity(spark, toxicity.fit(docs, corpus(spark, sf_dir, "labels")))
    return docs.withColumn("_score", score(text_or_empty())).where("_score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; documents without an id stay."""
    found = near_dups.near_duplicates(docs.select("doc_id", "text"))
    gone = found.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the passages that stand elsewhere too; an empty one stays, a null text stays null."""
    out = repeats.remove_repeats(docs.select(*COLUMNS), whole_characters=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept").cast("string"))
    return out.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; told by their text, so that null and repeated ids are no matter."""
    keyed = docs.withColumn("_text_key", F.xxhash64(text_or_empty()))
    leaks = decontaminate.find_leaks(keyed, corpus(spark, sf_dir, "benchmark"), id="_text_key").where("contaminated")
    return keyed.join(leaks.select("_text_key").distinct(), "_text_key", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("repeats", cut_repeats), ("benchmark_leaks", drop_leaks), ("packing", pack),
]

#: No stage but the join of their results can be said in SQL: training, hashing to candidates and tokenizing can't.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
