"""Queries over tokens: 1 (SentencePiece), 7 (counts), 8 (packing)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallowmere.llm import sentencepiece_viterbi
from tallowmere.llm.common import table
from tallowmere.llm.packing import pack, pieces
from tallowmere.llm.token_counts import count_tokens

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
CAPACITY, END_ID, TOKEN_LIMIT = 1024, 2, 512


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and the text decoded from them. Null texts are empty."""
    return sentencepiece_viterbi.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document. Null texts are empty and have none."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), TOKEN_LIMIT)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences. A null or empty text is its end id alone."""
    return pack(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), CAPACITY, END_ID), CAPACITY)


QUERIES = {"op1_sentencepiece": op1_sentencepiece, "op7_token_counts": op7_token_counts, "op8_best_fit_packing": op8_best_fit_packing}
ORACLE: dict[str, str] = {}
