"""From raw documents to packed sequences: five stages, each on all that the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import decontamination, language_id, packing, simhash, toxicity
from lattica.llm.common import shared_checkpoint, table, text_crc32_mod

#: Documents that score this or more are rejected.
TOXIC = 0.7
#: Documents whose likeliest language has a smaller mean probability are rejected: a little over chance for four languages.
#: At 0.5 one document in 700 of the check's would go, most of them texts in a language; the least sure of 51,282 has 0.32.
LEAST_LANGUAGE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under TOXIC, learnt from the labels outside the held-out third."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs.select("doc_id", "text"), labels, text_crc32_mod("doc_id", 3) != 1)
    return toxicity.score_texts(docs, model, keep=TOXIC)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network is sure enough to be in one of the languages that tagged documents name; texts without a
    letter (und), and those in no such language as far as it can tell, are rejected."""
    model = language_id.fit(docs.select("doc_id", "text", "lang"), text_crc32_mod("doc_id", 4) != 2)
    return language_id.identify(docs, model, keep=set(model.languages), least=LEAST_LANGUAGE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class linked by five-word shingle similarity of 0.8 or more."""
    return simhash.drop_near_copies(docs, k=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an eight-word window of any benchmark item."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), k=8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents left, placed in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack),
]

#: SQL cannot express the learnt stages.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each stage's rows are written to the shared folder and read again.

    Rows with a null or empty text are in no language and go in the second stage; of repeated rows one stays; an empty table
    gives no rows. Every run has a folder of its own, in which only the rows that the last stage reads are left.
    """
    shared_checkpoint(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _delete(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
