"""Connected components of links as joins and grouped minima (alternating large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowmere.llm.common import discard, keep


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected `links` (a, b): component is the smallest node reachable.

    Each step hangs neighbours on the smallest one known. Grouped minima are combined before their shuffle and
    written, so that the joins back may be split where a node has very many links. Steps grow with the
    logarithm of the longest chain; each is written to the shared folder.
    """
    down = links.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct()
    down = keep(down, "links")
    while True:
        before = down
        both = down.unionByName(down.selectExpr("v AS u", "u AS v"))
        least = keep(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        down = both.where("v > u").join(least, "u").selectExpr("v AS u", "m AS v").distinct()
        lower = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(lower, "u")
        down = joined.where("v <> m").selectExpr("v AS u", "m AS v").unionByName(joined.selectExpr("u", "m AS v")).distinct()
        down = keep(down, "links")
        discard(before, least)
        if down.selectExpr("v AS u").join(down, "u", "left_semi").isEmpty():
            break
    # Every node now hangs on a root, perhaps through several links to the same one.
    hung = down.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    out = keep(hung.unionByName(down.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
    discard(down)
    return out


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` (node, component) with the components that new `links` (a, b) join; nodes without a label stand for themselves."""
    ends = links.select("a", "b").join(labels.toDF("a", "ca"), "a", "left").join(labels.toDF("b", "cb"), "b", "left")
    new = components(ends.selectExpr("coalesce(ca, a) AS a", "coalesce(cb, b) AS b"))
    moved = new.select(F.col("node").alias("component"), F.col("component").alias("to"))
    old = labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    out = keep(old.unionByName(new.join(labels, "node", "left_anti").select("node", "component")), "labels")
    discard(new)
    return out
