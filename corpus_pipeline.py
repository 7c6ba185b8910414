"""The corpus pipeline: five stages over ``documents``, each one operator of
``tidemark.llm``. Every stage reads what the one before wrote as Parquet.

1. toxicity: drops documents that the model predicts toxic (score 0.5 or more);
2. simhash: keeps one document of each group of near copies, the smallest id;
3. suffix_array: cuts passages of over 50 words, or of 400 bytes, that also
   stand elsewhere out of the texts;
4. decontaminate: drops documents that hold a benchmark window;
5. pack: length buckets and token-budget batches.

All stages but the last return the columns of ``documents``; a cut text keeps
its row (bytes of a cut character go with it, n_chars follows). Nulls: rows
with null texts pass as empty texts do; the ids of rows decide nothing but
which copy stays (null ids only if no other has one). Rows that repeat wholly
count as copies. Empty tables pass as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontam, packing, simhash, suffix_dedup, toxicity
from tidemark.llm.common import stored, table

# A passage is over 50 words; so many have more than 240 bytes (of 22,600 shared
# runs of 51 words or more in check_s, all but 2 in 100).
PASSAGE_WORDS = 50
REPEAT_BYTES = 240


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic, by a model of the labelled rows of ``docs``."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of fingerprints at most two bits apart."""
    return simhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages: of the runs that repeated strings of
    REPEAT_BYTES cover, those of over PASSAGE_WORDS words or of 400 bytes."""
    return suffix_dedup.cut_repeats(docs, chars_col="n_chars", length=REPEAT_BYTES, whole=suffix_dedup.LENGTH,
                                    words=PASSAGE_WORDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of the benchmark."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of every remaining document."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix_array", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("pack", pack),
]

# The model, the components and the bucket program are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
