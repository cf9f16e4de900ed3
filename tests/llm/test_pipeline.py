"""The pipeline: every stage by the brute force of its operator, and whole."""

from __future__ import annotations

import corpus_pipeline
import sentencepiece
from ledgerlake.llm.decontam import words_of
from ledgerlake.llm.queries import QUERIES, SQL, model_path
from test_simhash import classes, plain

FOLDER = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = {r["doc_id"]: r for r in documents.collect()}
    accepted = corpus_pipeline.identify_language(spark, documents, FOLDER)
    assert accepted.columns == documents.columns
    kept = {r["doc_id"] for r in accepted.collect()}
    assert len(kept) >= len(rows) - 2 and all(any(c.isalpha() for c in rows[i]["text"]) for i in kept)
    first = set(classes({i: plain(rows[i]["text"]) for i in kept}).values())
    after = corpus_pipeline.drop_near_duplicates(spark, documents.where(documents["doc_id"].isin(sorted(kept))), FOLDER)
    assert {r["doc_id"] for r in after.collect()} == first
    items = [" ".join(words_of(r["text"])) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = {i for i in first if not any(f" {item} " in f" {' '.join(words_of(rows[i]['text']))} " for item in items)}
    result = {r["doc_id"]: r for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(result) == clean
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    for i, row in result.items():
        assert row["ids"] == library.encode(rows[i]["text"]) + [2] and row["decoded"] == rows[i]["text"] and row["n_tokens"] == len(row["ids"])


def test_registered():
    assert {int(n.split("_")[0][2:]) for n in QUERIES} == set(range(1, 14)) and set(SQL) <= set(QUERIES)
    assert len(corpus_pipeline.STAGES) == 4
