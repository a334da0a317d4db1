"""The corpus pipeline: raw documents to token ids, each stage over all that its predecessor kept.

Every stage works on the table that the stage before it has written, whole texts of all rows. Null
ids, null texts and null columns are values like others; rows are told apart by id and text. Stages
but the last return the columns of documents, whatever these are, and an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from auditloom.llm import bpe, exact_dedup, mixing, near_dedup, weak_rules
from auditloom.llm.common import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality rules keep (operator 7).

    A row goes if its text fails the base rules or its posterior probability of being good is too
    small. Null and empty texts have no words and go. Equal texts are judged alike, so repeated rows
    stay or go together; ids and other columns play no part.
    """
    return weak_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text (operator 4): the one with the smallest id, a null id last.

    Of rows that repeat that id and text one stays, the one with the least hash of its columns.
    Texts that differ in runs of white space only are equal, and all empty and null texts are one.
    """
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies (operator 6): the one with the smallest id, a null id last.

    Ties (one id on several texts of a class) go to the smallest digest of the text, repeated rows
    to the least hash of their columns. Texts without words are one class.
    """
    return near_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows as the mix of sources takes them (operator 5): each none, one or two times.

    A null source is a source. The place of a row in its source's order depends on its id alone, so
    rows that share an id and a source (null ids too) are taken alike.
    """
    return mixing.repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row (operator 9).

    A null text counts as empty and has no ids; repeated rows give repeated results.
    """
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("tokens", tokens)]

#: Consistent weighted sampling and expectation-maximisation are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of a stage by the file system that it is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what a stage returns is written as Parquet to the shared folder and read again.

    A stage's table is deleted once the next one is written, and all of them if a stage fails; the
    last one is what the result reads.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                _remove(spark, f"{folder}/{k - 1}")
    except BaseException:
        _remove(spark, folder)
        raise
    return docs
