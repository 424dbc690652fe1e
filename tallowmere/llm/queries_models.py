"""Queries of the models: 9 (nearest neighbours) and 10 (toxicity)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallowmere.llm import neighbours, toxicity
from tallowmere.llm.common import table

QUERY_EVERY, NEAREST = 20, 20


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector. Null, zero and broken vectors and rows without an id take no part; ties go to the smaller id."""
    found = neighbours.search(table(spark, sf_dir, "embeddings"), F.col("id") % QUERY_EVERY == 0, NEAREST)
    return found.select("query_id", "rank", "vec_id", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score and a prediction for every document, null texts as empty ones; without labels of both classes all get the base rate."""
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Every vector is double precision in DuckDB too; its sums run in component order.
ORACLE = {
    "op9_nearest_neighbours": f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % {QUERY_EVERY} = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= {NEAREST}
"""
}
QUERIES = {"op9_nearest_neighbours": op9_nearest_neighbours, "op10_toxicity": op10_toxicity}
