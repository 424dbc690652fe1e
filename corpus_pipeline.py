"""A corpus pipeline: five stages over `documents`, each one of the training-data operators.

Toxic documents go, then low quality; one document of each group of near copies stays, secrets that look
live are masked, and what is left is packed into sequences.

Null texts count as empty in every stage and fail the quality rules. Repeated rows are scored and judged each; one
of them is left after the near copies have gone. Ties of score or distance stay as the stage's own rule says (at the
threshold a document is toxic; at the cut-off it is kept). An empty table passes through all stages. Further
columns are carried along, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallowmere.llm import jaccard, packing, quality, secrets, toxicity
from tallowmere.llm.common import discard, keep, table

TOXIC, CAPACITY, END_ID = 0.7, 1024, 2
#: Trained scores, robust estimates and token ids are not for SQL; tests hold each stage against plain code.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold, by a model that the table of labels trains."""
    return toxicity.below(docs, table(spark, sf_dir, "labels"), TOXIC)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and aren't outliers of their language and source."""
    return quality.accepted(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by similar shingles."""
    return jaccard.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets that aren't widely copied examples masked and n_chars counted anew."""
    masked = secrets.redact(docs, F.to_json(F.struct("source", "lang")), F.col("source"))
    return masked.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, END_ID), CAPACITY)


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_low_quality), ("ngram_jaccard_join", drop_near_copies), ("secret_scans", mask_secrets), ("best_fit_packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)  # nothing reads it any more
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
