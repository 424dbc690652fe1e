"""Queries over the corpus's texts: 11 (fill-in-middle), 12 (suffix-array dedup) and 13 (filter interaction audit)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallowmere.llm import fill_middle, filter_audit, suffix_repeats
from tallowmere.llm.common import table


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of every document, by digests of the output and of the text that it gives back. Null texts are empty."""
    out = fill_middle.samples(table(spark, sf_dir, "documents"))
    restored = fill_middle.restore(F.col("form"), F.col("output"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes of strings of 200 bytes that occur elsewhere. Null texts are empty."""
    return suffix_repeats.judge(table(spark, sf_dir, "documents")).drop("spans")


def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of each language, in all their orders. Null texts and languages are empty."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op11_fill_in_middle": op11_fill_in_middle, "op12_suffix_array_dedup": op12_suffix_array_dedup, "op13_filter_interaction_audit": op13_filter_interaction_audit}
ORACLE = {
    "op11_fill_in_middle": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS units, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
""",
    "op13_filter_interaction_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), e AS (
  SELECT t AS same, min(doc_id) AS first FROM d GROUP BY t
), l AS (
  SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, CASE WHEN len(w) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN first < d.doc_id THEN 'E' ELSE '' END AS fails, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM d JOIN e ON d.t = e.same LEFT JOIN l ON l.doc_id = d.doc_id
), s AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails
), x AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || g.x || h.x AS filter_order FROM x a, x b, x c, x g, x h WHERE len(list_distinct([a.x, b.x, c.x, g.x, h.x])) = 5
), k AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS letter, filter_order[1:step - 1] AS earlier FROM o, range(1, 6) AS r(step)
), c AS (
  SELECT part, filter_order, step, letter, n, good, toxic, fails, contains(fails, letter) AS it, fails <> '' AND earlier <> '' AND regexp_matches(fails, '[' || earlier || 'z]') AS gone FROM s, k
), a AS (
  SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT it AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (it AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (it AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = letter), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (it AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (it AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM c GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM a
""",
}
