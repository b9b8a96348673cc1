"""From raw documents to packed training sequences: language, near copies, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns the rows that stay, with the columns of documents; the last returns the packed pieces. A
stage's rows are written as Parquet and read again before the next one begins.

Columns beyond id and text go with their rows, whatever their names; an empty table gives no rows at any stage; very long texts are taken whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import jaccard, language, packing, secrets
from graphloom.llm.common import crc_remainder, stash


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those whose language the network can't tell, go.

    Null and empty texts have no letter; a null id or language only keeps a row from being learnt from; repeated rows are judged each, and alike; of
    languages that are equally likely the first in order of names is told."""
    return language.keep_known(docs, language.fit(docs, crc_remainder("doc_id", 4) != 2))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of least id: five-word shingles, a Jaccard similarity of 0.8 or more.

    Texts that are null or without words are copies of nothing, and stay; of rows that repeat an id and a text one stays; unrelated texts that share an
    id stay; rows without an id are held against each other, and of each group one stays beside the one with an id."""
    return jaccard.one_of_each(docs, n=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are taken out of the texts; all documents stay.

    Null and empty texts stay as they are; repeated rows are treated alike; of spans that overlap the whole stretch goes."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens.

    A null or empty text is its end id alone; rows that repeat an id, or have none, are packed each; which of several equally long pieces
    lies where follows the order of the input's parts."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("near_copies", near_copies), ("secret_scan", secret_scan), ("best_fit_packing", pack)]
#: A trained network decides, so SQL can't express it; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
