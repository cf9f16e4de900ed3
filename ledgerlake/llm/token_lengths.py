"""Exact length histogram: documents by encoded length, with sums from each length upwards.

From one row per length every context limit can be answered: documents and tokens in all, those that are too long, the
quantile of a length, and the tokens that remain when each text is cut at the limit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlake.llm.common import materialize

#: Lengths summed in one window group. The histogram has at most as many rows as the longest text has tokens.
BLOCK = 4096


def length_histogram(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """One row per length that occurs: ``n_tokens, docs, tokens, docs_from, tokens_from, docs_upto, quantile, truncated_total``.

    ``docs_from`` and ``tokens_from`` count documents of this length or more, ``docs_upto`` those of this length or less,
    ``quantile`` is their share of all, ``truncated_total`` the tokens of all documents with each cut to this length. Rows are
    counted per task before the shuffle, so a common length costs one row per task. Sums are made per block of lengths, then
    over blocks. Null lengths are left out; an empty table gives an empty result.
    """
    counts = (
        lengths.where(F.col(length).isNotNull())
        .groupBy(F.col(length).cast("long").alias("n_tokens"))
        .agg(F.count("*").alias("docs"))
        .withColumn("tokens", F.col("n_tokens") * F.col("docs"))
        .withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    )
    counts = materialize(counts, "length-counts")
    # one row per 4,096 lengths: a few rows even for texts of millions of tokens
    upwards = Window.partitionBy(F.lit(0)).orderBy(F.col("block").desc())
    blocks = (
        counts.groupBy("block")
        .agg(F.sum("docs").alias("docs_block"), F.sum("tokens").alias("tokens_block"))
        .select(
            "block",
            (F.sum("docs_block").over(upwards) - F.col("docs_block")).alias("docs_above"),
            (F.sum("tokens_block").over(upwards) - F.col("tokens_block")).alias("tokens_above"),
            F.sum("docs_block").over(Window.partitionBy(F.lit(0))).alias("docs_all"),
            F.sum("tokens_block").over(Window.partitionBy(F.lit(0))).alias("tokens_all"),
        )
    )
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    summed = counts.join(blocks, "block").select(
        "n_tokens",
        "docs",
        "tokens",
        (F.sum("docs").over(inside) + F.col("docs_above")).alias("docs_from"),
        (F.sum("tokens").over(inside) + F.col("tokens_above")).alias("tokens_from"),
        "docs_all",
        "tokens_all",
    )
    upto = F.col("docs_all") - F.col("docs_from") + F.col("docs")
    return summed.select(
        "n_tokens",
        "docs",
        "tokens",
        "docs_from",
        "tokens_from",
        upto.alias("docs_upto"),
        (upto / F.col("docs_all")).alias("quantile"),
        (F.col("tokens_all") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("truncated_total"),
    )
