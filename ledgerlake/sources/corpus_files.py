"""Script files and manifests from a folder."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.operators import corpus


def _whole_files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    path = F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    return files.select(path.alias("path"), F.col("value").alias("content"))


def read_scripts(spark: SparkSession, folder: str, suffixes: Sequence[str] = corpus.SCRIPT_SUFFIXES) -> DataFrame:
    """Script files (by suffix) below a folder, whole and in no order: sort what is made of them, such as path and checksum."""
    return corpus.scripts(_whole_files(spark, folder), suffixes=suffixes, ordered=False)


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """``.txt`` manifests below a folder."""
    files = _whole_files(spark, folder).where(F.endswith("path", F.lit(".txt")))
    return files.withColumnRenamed("path", "manifest")
