"""A corpus pipeline: language, quality, near duplicates, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir), with docs the rows its predecessor kept, and returns the rows it
keeps with their columns; the last one returns token ids. Models are learned from rows that their
operators may learn from, of the tables in sf_dir and of docs.

A stage keeps: language ID, documents with a letter whose best language is likelier than not; the
quality classifier, those with a score of at least 0.5; the Jaccard join, one of each class of near
duplicates; decontamination, those that no benchmark item contaminates. The last stage decodes its token ids again, by their
offsets too, and returns the digest of what they give beside them.

Defined results: a null, empty or letterless text goes at the first stage; a very long text is judged whole; repeated rows
go on as they are up to the Jaccard join, which leaves one of them; a null doc_id is kept there, as it is not
compared; of a class of near duplicates, the row with the least doc_id stays, and of rows with that doc_id the one
with the least text hash; a score or share at its limit passes in the first two stages and contaminates in the fourth; an
empty table of documents, or one without any lang, gives no rows, and an empty benchmark removes none; without labels of both
kinds, quality keeps all if half or more of the labels (or none at all) are 1, else none; further columns are kept by
all stages but the last, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import bpe, decontamination, jaccard_join, language_id, quality_gam
from strandloom.llm.text import give_back, slices
from strandloom.storage import materialize, spread


def _filter(docs: DataFrame, keep, limit: int, rows: int) -> DataFrame:
    """The rows of docs for whose texts ``keep`` (texts to booleans) holds, in place."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            ok = [np.zeros(0, bool), *(keep(texts) for _, _, texts in slices(batch.column(at), limit, rows))]
            yield batch.filter(pa.array(np.concatenate(ok)))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    model = language_id.fit(docs.where(~language_id.held_out()))
    if model is None:
        return docs.limit(0)

    def keep(texts):
        logits, letters = model.scores(texts)
        return (letters > 0) & (model.probabilities(logits).max(1) >= least)

    return _filter(docs, keep, 1 << 19, language_id.ROWS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality_gam.held_out())
    model = quality_gam.fit_on_sample(docs, labels)
    return _filter(docs, lambda texts: model.score(quality_gam.dense_features(texts).astype(float)) >= 0.5, 1 << 21, 1 << 30)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(docs, bpe.ranks_path())


STAGES = [
    ("language ID", language),
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("byte-level BPE", token_ids),
]

# The stages hold trained models, MinHash and tokenisation, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written before the next reads them."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
