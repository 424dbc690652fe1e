"""Query of the similarity join: 4 (n-gram Jaccard join)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallowmere.llm import jaccard
from tallowmere.llm.common import table


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and class of every document. Null and wordless texts stand alone; rows with equal sets are one class."""
    return jaccard.join(table(spark, sf_dir, "documents"))


QUERIES = {"op4_ngram_jaccard_join": op4_ngram_jaccard_join}
#: Every pair of sets that shares a shingle, compared by its counts, and whatever links reach.
ORACLE = {
    "op4_ngram_jaccard_join": r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s
  FROM worded
), classes AS MATERIALIZED (
  SELECT min(doc_id) AS id, len(s) AS n, s FROM sets WHERE len(s) > 0 GROUP BY s
), shingles AS MATERIALIZED (
  SELECT id, n, unnest(s) AS g FROM classes
), links AS MATERIALIZED (
  SELECT a.id AS a, b.id AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.id < b.id
    AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS MATERIALIZED (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT id AS a, id AS b FROM classes UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a
), lowest AS (
  SELECT a AS id, min(b) AS component_id FROM reached GROUP BY a
)
SELECT d.doc_id, cast(len(d.s) AS bigint) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id, coalesce(c.id, d.doc_id) AS class_id
FROM sets d LEFT JOIN classes c ON c.s = d.s LEFT JOIN lowest l ON l.id = c.id
""",
}
