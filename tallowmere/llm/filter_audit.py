"""How filters interact: what each removes in every order, by an existential self-join and counts of failure sets.

1. The filters on a text alone are bits of one number a row.
2. A copy fails: a left-semi join on hash, exact text and a smaller id marks it. Only texts whose hash occurs
   again take part, and the side that is looked for is one row a text with its smallest id, combined before
   the shuffle, so that a text that very many rows share is one row there and its rows may be dealt over tasks.
3. The marked ids are united with the other failures, a row's bits are joined together, and rows are counted by
   part and set of bits: at most 2^filters rows a part.
4. Every order of the filters is worked out from these counts.

Null texts count as empty (and are copies of each other), a null part as the empty string. A row without an id is
no copy and has no copies, and bears no label. Repeated rows count each; rows of one id aren't copies of each
other. Labels that repeat count once, a 1 over a 0. Texts are taken whole. An empty table gives an empty table.
Further columns are ignored.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallowmere.llm.common import bounded, text_or_empty

#: Hashes of repeated texts up to this many are broadcast; beyond, they meet the texts by a shuffle.
BROADCAST_HASHES = 500_000
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 100, 80, 10, "[#$%&*|]"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]


def text_filters(words: Column, text: Column) -> dict[str, Column]:
    """Failures that a text shows by itself, by letter."""
    capitals = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * DISTINCT_PERCENT,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * CAPITAL_PERCENT,
        "D": text.rlike(SYMBOLS),
    }


def later_copies(rows: DataFrame) -> DataFrame:
    """Rows (id, hash, text and others) whose text a smaller id has too."""
    repeated = rows.groupBy("hash").count().where("count > 1").select("hash")
    several = rows.join(bounded(repeated, BROADCAST_HASHES), "hash", "left_semi")
    first = several.groupBy("hash", "text").agg(F.min("id").alias("first"))
    a, b = several.alias("a"), first.alias("b")
    return a.join(b, (F.col("a.hash") == F.col("b.hash")) & (F.col("a.text") == F.col("b.text")) & (F.col("b.first") < F.col("a.id")), "left_semi")


def failures(docs: DataFrame, copies: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> tuple[DataFrame, str]:
    """(id, part, bits, n): the filters that n rows fail together, bit k for the k-th letter; and the letters."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text_or_empty(f"`{text_col}`").alias("text"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    own = text_filters(F.col("words"), F.col("text"))
    letters = "".join(own) + copies
    bits = sum((F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(own.values())), F.lit(0))
    hashed = F.unhex(F.sha2("text", 256)).alias("hash")
    base = rows.withColumn("words", words).select("id", "part", hashed, bits.alias("bits"), F.lit(1).alias("n"))
    marked = later_copies(rows.select("id", "part", hashed, "text")).select("id", "part", "hash", F.lit(1 << len(own)).alias("bits"), F.lit(0).alias("n"))
    whole = base.unionByName(marked).groupBy("id", "part", "hash").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
    return whole.select("id", "part", "bits", "n"), letters


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, filter_order and step: the counts, and the filter's removals summed over all orders (shapley)."""
    fails, letters = failures(docs, id_col=id_col, text_col=text_col, part_col=part_col)
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    sets = fails.join(marks, "id", "left").groupBy("part", "bits").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("quality") == 1, F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"))
    bit = {x: 1 << k for k, x in enumerate(letters)}
    steps = [{"o": "".join(o), "s": k + 1, "b": bit[x], "e": sum(bit[y] for y in o[:k])} for o in itertools.permutations(letters) for k, x in enumerate(o)]
    steps = F.from_json(F.lit(json.dumps(steps)), "array<struct<o:string,s:int,b:int,e:int>>")
    each = sets.select("*", F.explode(steps).alias("t")).select("part", "bits", "n", "good", "toxic", F.col("t.o").alias("filter_order"), F.col("t.s").alias("step"), F.col("t.b").alias("bit"), F.col("t.e").alias("earlier"))
    fails_it, gone = F.col("bits").bitwiseAND(F.col("bit")) > 0, F.col("bits").bitwiseAND(F.col("earlier")) > 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0))
    out = each.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails_it & ~gone).alias("kept"), total(fails_it & ~gone).alias("removed"), total(fails_it & gone).alias("redundant"),
        total(F.col("bits") == F.col("bit")).alias("unique_fails"), total(fails_it & ~gone, "good").alias("good_lost"), total(fails_it & ~gone, "toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "bit"))).select("part", "filter_order", "step", *COUNTS, "shapley")
