"""From raw documents to a training mix: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.common import quoted, shared_folder, table
from thicket.llm.decontaminate import decontaminate
from thicket.llm.mixing import mixed_documents
from thicket.llm.quality import keep_good
from thicket.llm.simhash import deduplicate
from thicket.llm.suffix import BYTES, Scheme, remove_repeats

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Words of a repeated passage that goes.
PASSAGE = 51


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: texts whose five-word shingles have a Jaccard similarity of 0.8 or more.
    SimHash fingerprints of these shingles give candidates, verified on whole texts; an exact search follows for the links that 64 bits lose."""
    return deduplicate(docs, SHINGLE_WORDS, SIMILARITY)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of 400 bytes and repeated passages of over 50 words go; documents stay, with what is left of their text. n_chars follows the text."""
    left = remove_repeats(docs, schemes=(BYTES, Scheme(PASSAGE, words=True)))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*map(quoted, docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with the number of words it takes from each."""
    return mixed_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: The learnt classifier is no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, on documents. Intermediate tables go to the shared checkpoint folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
