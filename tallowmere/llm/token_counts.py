"""Token counts by a map-side two-tier lookup.

A bounded sample of documents gives the most frequent words; their token lengths go to every worker as
one compact table (a text blob and an array of lengths). A worker adds up the lengths of a text's words
from that table, and encodes what it misses once, into a cache of its own with a fixed number of places.
The corpus is read once more for the count itself and nothing of it is shuffled. The table and the caches
only save work; every count is what the tokenizer gives for the whole text.

Nulls count as empty texts (0 tokens); an empty table gives an empty table; repeated rows are counted
each on their own; further columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowmere.llm.bpe_words import WordEncoder
from tallowmere.llm.common import text_or_empty

TABLE_WORDS = 16_384
SAMPLE_DOCS = 2_000


def frequent_words(docs: DataFrame, text_col: str, sample_docs: int, table_words: int) -> list[str]:
    """The most frequent words that follow a space, over about `sample_docs` documents spread by a hash of their text."""
    total = docs.count()
    share = min(1.0, sample_docs / max(1, total))
    sample = docs.select(text_or_empty(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    words = sample.select(F.explode(F.slice(F.split(F.translate("text", "\n", " "), " "), 2, 1 << 30)).alias("word")).where("length(word) between 1 and 64")
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(table_words)
    return [r.word for r in top.select("word").collect()]  # table_words rows at most


def compact(words: list[str], path: str) -> tuple[bytes, bytes]:
    """The words and their token lengths as two byte strings; words that don't stand for themselves are left out."""
    encoder = WordEncoder(path, len, sum)
    lengths = {w: len(ids) for w in words if "\n" not in w and (ids := encoder.word(" ", w)) is not None}
    return "\n".join(lengths).encode(), np.array([*lengths.values()], "<u2").tobytes()


@functools.lru_cache(maxsize=2)
def _counter(path: str, blob: bytes, lengths: bytes, cache_words: int) -> WordEncoder:
    known = dict(zip(blob.decode().split("\n"), np.frombuffer(lengths, "<u2").tolist()))
    return WordEncoder(path, len, sum, known, cache_words)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, table_words: int = TABLE_WORDS, cache_words: int = 200_000) -> DataFrame:
    """`id_col`, n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(compact(frequent_words(docs, text_col, sample_docs, table_words), tokenizer_path))

    def counts(batches):
        encoder = _counter(tokenizer_path, *shared.value, cache_words)
        for b in batches:
            n = list(encoder.encode(b.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    out = texts.mapInArrow(counts, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
