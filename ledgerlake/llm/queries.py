"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import read_table


def model_path() -> str:
    """The vocabulary file of the registered queries; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def byte_level_path() -> str:
    """The byte-level vocabulary that is aligned with the pieces."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerlake.llm.sharding import shard_documents

    return shard_documents(read_table(spark, folder, "documents"))


def op2_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerlake.llm.prefix_hash import neighbour_fingerprints

    return neighbour_fingerprints(read_table(spark, folder, "documents"))


def op3_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerlake.llm.html_blocks import extract_main_text

    return extract_main_text(read_table(spark, folder, "pages").select("page_id", "url", "html"))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerlake.llm.simhash import near_duplicate_classes

    return near_duplicate_classes(read_table(spark, folder, "documents"))


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerlake.llm.language import predict_languages

    return predict_languages(read_table(spark, folder, "documents"))


def op6_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerlake.llm.neural_lm import score_documents

    return score_documents(read_table(spark, folder, "documents"))


def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerlake.llm.pieces import piece_digests

    return piece_digests(read_table(spark, folder, "documents"), model_path())


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerlake.llm.pieces import piece_lengths
    from ledgerlake.llm.token_lengths import length_histogram

    return length_histogram(piece_lengths(read_table(spark, folder, "documents"), model_path()))


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerlake.llm.url_trie import judge_urls

    return judge_urls(read_table(spark, folder, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerlake.llm.decontam import contaminated

    return contaminated(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op11_secrets(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerlake.llm.secrets import secret_digests

    return secret_digests(read_table(spark, folder, "documents"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerlake.llm.whitening import whiten

    made = whiten(read_table(spark, folder, "embeddings"))
    return made.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))  # null where it does not fit


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    from ledgerlake.llm.alignment import align_tokenizers

    return align_tokenizers(read_table(spark, folder, "documents"), byte_level_path(), model_path())


OP9_SQL = """
WITH cut AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
  END AS rule
  FROM cut
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_fingerprints": op2_fingerprints,
    "op3_html_extraction": op3_html_extraction,
    "op4_simhash": op4_simhash,
    "op5_language": op5_language,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_token_counts": op8_token_counts,
    "op9_url_filter": op9_url_filter,
    "op10_decontamination": op10_decontamination,
    "op11_secrets": op11_secrets,
    "op12_whitening": op12_whitening,
    "op13_alignment": op13_alignment,
}

SQL: dict[str, str] = {"op9_url_filter": OP9_SQL}
