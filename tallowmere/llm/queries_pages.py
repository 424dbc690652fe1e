"""Query of the pages: 6 (HTML extraction)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallowmere.llm import html_text
from tallowmere.llm.common import table


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page. A null html is empty and gives an empty text; repeated pages are extracted alike."""
    return html_text.extract(table(spark, sf_dir, "pages"))


QUERIES = {"op6_html_extraction": op6_html_extraction}
ORACLE: dict[str, str] = {}
