"""Queries of the native filters: 2 (quality rules), 3 (secret scans) and 5 (URL filters)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallowmere.llm import secrets, urls
from tallowmere.llm.common import table
from tallowmere.llm.quality import judge

#: (verdict, host, start of the path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document. A null text has no words and fails; nulls of lang or source are a group of their own; repeated rows count each."""
    return judge(table(spark, sf_dir, "documents"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document. A source owns what it holds; its repositories are its parts by language. Null texts are empty, null sources one owner."""
    docs = table(spark, sf_dir, "documents")
    repo = F.to_json(F.struct("source", "lang"))
    return secrets.scan(docs.select("doc_id", "text", "source", repo.alias("repo")), repo_col="repo", owner_col="source")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page. A null url has neither host nor path and is allowed; repeated rows are judged alike."""
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, RULES, urls.tracked(pages))


QUERIES = {"op2_quality_rules": op2_quality_rules, "op3_secret_scans": op3_secret_scans, "op5_url_filters": op5_url_filters}
_HOST = "translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
ORACLE = {
    "op5_url_filters": f"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS url, {_HOST} AS host, {_PATH} AS path FROM pages
), keyed AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, ':[0-9]*$', ''), '^(www|m)\\.', '')
    || regexp_replace(regexp_replace(path, '\\.html?$', ''), '/+$', '') END AS key,
  CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/'
  END AS rule FROM parts
), listed AS (
  SELECT DISTINCT key FROM keyed WHERE key IS NOT NULL AND regexp_matches(url, '[?&]utm_source=')
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN listed.key IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM keyed LEFT JOIN listed ON keyed.key = listed.key
"""
}
