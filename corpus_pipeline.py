"""A corpus pipeline of five operators: toxicity, near-duplicates, repeated passages, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's
``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import common, decontaminate, minhash, packing, suffix, toxicity


#: Bytes of a passage that is cut where it repeats. A passage of over 50 words is longer (318 bytes on average in the test data, down to
#: about 230); license lines and other single sentences are shorter.
REPEAT = 200


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon rejects go. Null and empty texts stay."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id; rows without an id stay."""
    return minhash.one_of_each(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of ``REPEAT`` bytes that start elsewhere too are cut from the texts; no row goes. ``n_chars`` follows the text."""
    return suffix.without_repeats(docs, REPEAT).withColumn("n_chars", F.char_length("text").cast("long"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold three quarters of a benchmark item's shingles go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a training sequence."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeats_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Sketches, suffix sorting and a learned lexicon have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, scratch, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), common.Scratch(spark, "pipeline"), common.now()
    for name, stage in STAGES:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir), name)
        common.release_all(since=mark)  # scratch tables of this stage; those of results from before the run stay
        if before is not None and hasattr(before, "_codeloom_at"):
            scratch.drop(before)
    return docs
