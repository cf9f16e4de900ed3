"""From raw documents to token ids: language ID, near-dedup, decontamination, encoding.

Each stage takes ``(spark, docs, folder)`` and returns what the next one reads; :func:`run` writes every stage's result as
parquet under the shared folder and reads it back, so a lost executor repeats one stage's tasks and no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import materialize, read_table
from ledgerlake.llm.queries import model_path


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose language is known: no text, no letter or an ambiguous codeword are rejected."""
    from ledgerlake.llm.language import accepted_documents

    return accepted_documents(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of linked fingerprints: that of the smallest id."""
    from ledgerlake.llm.simhash import keep_first_of_groups

    return keep_first_of_groups(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    from ledgerlake.llm.decontam import clean_documents

    return clean_documents(docs, read_table(spark, folder, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids with the end id, and the text they decode to."""
    from ledgerlake.llm.pieces import encode_pieces

    coded = encode_pieces(docs, model_path())
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece coding", encode),
]

#: The classifier, the latent space and the merges are not expressible in SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, folder), f"pipeline-{number}")
    return docs
