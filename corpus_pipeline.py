"""Corpus pipeline: stages over `documents`, each one of the training-data operators.

Every stage works on all rows that the one before kept; all but the last return the columns of documents, whatever other
columns there are.  An empty table passes through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import decontaminate, langid, mixing, nearcopies, sharding
from millrace.llm.common import shared_folder, table
from millrace.sources.files import Files


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undetermined or predicted below the calibrated bound.

    Null, empty and letterless texts go, as no language fits them; without any labelled document all go; very long texts are
    read whole; repeated rows go or stay together; columns of clashing names are kept.
    """
    return langid.identify(docs, langid.fit(docs), docs.columns, only_accepted=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of every group of near copies (five words, similarity 0.8).

    Null and word-free texts are groups of their own; rows without a doc_id stay; of rows that repeat a doc_id one stays;
    columns of clashing names are kept.
    """
    return nearcopies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of any benchmark item.

    Null and word-free texts hold none and stay; an empty benchmark drops nothing; repeated rows go or stay together; columns
    of clashing names are kept.
    """
    return decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), docs.columns, below=1)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's words: a row for each pass over a document, cut to the words that the mix takes.

    Null and empty texts give no words and no row; a null source is one of its own; repeated rows are taken each for itself;
    very long texts are taken block by block; n_chars follows the text and all other columns are kept.
    """
    return mixing.mixed_texts(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of the mix.

    Null doc_ids share a shard, null texts weigh 8 bytes, repeated rows get slots of their own; no other column is read.
    """
    return sharding.shard_documents(docs)


STAGES = [
    ("language", identify_language), ("near_copies", drop_near_copies), ("decontaminate", drop_contaminated),
    ("mix_sources", mix_sources), ("shard", shard),
]

#: The classifier, the signatures and the mix are not expressible in SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written to the shared folder and read again.

    A stage's rows are deleted once the next stage's are written; those that the last stage reads stay for its result.
    """
    files = Files(spark, f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}")
    docs, last = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(files.at(name))
            docs = spark.read.parquet(files.at(name))
            if last:
                files.delete(files.at(last))
            last = name
    return docs
