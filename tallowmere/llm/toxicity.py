"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

1. A bounded sample of labelled rows (at most `MAX_LABELLED`, those with the smallest hash of their id)
   is the only thing learned from. Its rows whose second hash falls in one part of five calibrate.
2. Lexicon: over the learning rows, words and their first four to six letters that documents labelled
   toxic hold far above their rate elsewhere (a normal test of their support), in two tiers of
   certainty. Near copies would lend support to each of their words; rows that share the smallest hash of
   their long words count once. Words are compared without marks between letters and with digits read as the letters that
   they stand for, so disguised ones count too. At most `MAX_TERMS` terms, so that they fit a broadcast.
3. Dense features of every text: lexicon densities and counts, second-person words near a lexicon word,
   capitals, punctuation, obfuscation rates, length.
4. `GBTClassifier` on the features, `IsotonicRegression` from its probability to the label.

Words are scanned once per row in Arrow batches; training is Spark ML. The corpus itself is never shuffled.
Only `crc32(doc_id) mod 3 <> 1` rows are learned from; labels, language, source and id are no features.

Null and empty texts have the features of an empty text and are scored. Null ids are never learned from. Null
labels are ignored, repeated labels of one row count once (a toxic one wins). Without labels of both
classes every score is the share of toxic labels (0.0 if there are none).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallowmere.llm.common import keep, text_or_empty

#: Tasks that the labelled rows are dealt to for the trees.
PARTS = 8
MAX_LABELLED, MAX_TERMS, TREES, DEPTH = 100_000, 4_096, 20, 4
STEMS = (4, 5, 6)
#: Of a lexicon's terms: documents at least, standard deviations at least; letters of the words that tell copies.
LEAST, LIFT, LONG = 4, 6.0, 8
#: Second-person words of the four languages.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deinen ihr euch tu toi te ton ta tes vous votre vos tú ti tu tus usted ustedes vosotros".split())
#: Digits and signs that stand for letters.
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
TOKEN = re.compile(r"\S+")
EDGES = ".,;:!?\"'()[]{}<>|«»¿¡…-–—_*#%&$~`^/\\"
FEATURES = ["sure_density", "sure_count", "likely_density", "likely_count", "sure_distinct", "near_you", "you_density", "capitals", "shouted", "punctuation", "exclaimed", "disguised", "digits", "log_words", "word_length"]
NEAR = 5


def plain(token: str) -> tuple[str, bool]:
    """The word that a token stands for, and whether it was disguised (marks or digits between letters)."""
    core = token.strip(EDGES).lower()
    if not core or core.isalpha():
        return core, False
    if any(c.isalpha() for c in core) and not core.isdigit():
        bare = "".join(c for c in core.translate(DISGUISES) if c.isalpha())
        return bare, len(core) <= 24
    return core, False


def terms_of(word: str):
    yield word
    for n in STEMS:
        if len(word) > n:
            yield word[:n] + "*"


def features(text: str, sure: frozenset, likely: frozenset) -> list[float]:
    """The dense features of one text."""
    tokens = text.split()
    n = len(tokens)
    found, maybe, you, distinct = [], 0, [], set()
    disguised = shouted = chars = 0
    for k, token in enumerate(tokens):
        chars += len(token)
        word, hidden = (token, False) if token.isalpha() and token.islower() else plain(token)
        disguised += hidden
        shouted += len(token) > 2 and token.isupper()
        if word in SECOND_PERSON:
            you.append(k)
        if word in sure or word[:4] + "*" in sure or word[:5] + "*" in sure or word[:6] + "*" in sure:
            found.append(k)
            distinct.add(word)
        elif word in likely or word[:4] + "*" in likely or word[:5] + "*" in likely or word[:6] + "*" in likely:
            maybe += 1
    near = int(np.sum(np.searchsorted(you, np.array(found) + NEAR, "right") > np.searchsorted(you, np.array(found) - NEAR))) if you and found else 0
    per, size = max(1, n), max(1, len(text))
    upper = sum(map(str.isupper, text)) if not text.islower() else 0
    marks = size - sum(map(str.isalnum, text)) - text.count(" ") - text.count("\n")
    return [len(found) / per, len(found), maybe / per, maybe, len(distinct), near / per, len(you) / per, upper / size, shouted / per, marks / size, text.count("!") / size, disguised / per, sum(map(str.isdigit, text)) / size, math.log1p(n), chars / per]


def _labelled(labels: DataFrame, id_col: str, label_col: str, max_labelled: int) -> DataFrame:
    """At most `max_labelled` rows (id, label, part), all open to learning."""
    key = F.col(id_col).cast("string")
    open_ = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.pmod(F.crc32(key), F.lit(3)) != 1))
    one = open_.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    return one.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "_id"), F.lit(5)).cast("int"))


def learn_lexicon(rows: DataFrame, max_terms: int) -> tuple[frozenset, frozenset]:
    """Terms of (text, label) rows by certainty: hardly ever seen in clean texts, and well above their rate there."""
    long_words = F.filter(F.split("text", " "), lambda w: F.length(w) >= LONG)
    rows = rows.withColumn("copy", F.coalesce(F.array_min(F.transform(long_words, lambda w: F.xxhash64(w))), F.xxhash64("text"))).groupBy("copy", "label").agg(F.min("text").alias("text"))

    def terms(batches):
        for b in batches:
            toxic, clean = Counter(), Counter()
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist()):
                words = {plain(t)[0] for t in TOKEN.findall(text)}
                (toxic if label else clean).update({t for w in words if w for t in terms_of(w)})
            both = [*(toxic.keys() | clean.keys())]
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([toxic[t] for t in both], pa.int64()), pa.array([clean[t] for t in both], pa.int64())], ["term", "toxic", "clean"])

    totals = rows.agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c")).first()
    n_toxic, n_clean = int(totals.t or 0), int(totals.c or 0)
    if not n_toxic or not n_clean:
        return frozenset(), frozenset()
    counts = rows.select("text", "label").mapInArrow(terms, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    share = n_toxic / (n_toxic + n_clean)
    expected = (F.col("toxic") + F.col("clean")) * share
    counts = counts.withColumn("z", (F.col("toxic") - expected) / F.sqrt(expected * (1 - share)))
    ranked = counts.where((F.col("toxic") >= LEAST) & (F.col("z") >= LIFT)).orderBy(F.desc("z"), "term").limit(max_terms).collect()  # max_terms rows at most
    sure = frozenset(r.term for r in ranked if r.clean * n_toxic <= 0.01 * r.toxic * n_clean)
    return sure, frozenset(r.term for r in ranked) - sure


def featured(rows: DataFrame, lexicon: tuple[frozenset, frozenset], also: list[str]) -> DataFrame:
    """The `also` columns of every row with its features as the array column `dense`."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def scan(batches):
        sure, likely = shared.value
        for b in batches:
            dense = [features(t, sure, likely) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in also), pa.array(dense, pa.list_(pa.float64()))], [*also, "dense"])

    schema = T.StructType([*(rows.schema[c] for c in also), T.StructField("dense", T.ArrayType(T.DoubleType()))])
    return rows.select(*also, "text").mapInArrow(scan, schema)


def _assembled(rows: DataFrame) -> DataFrame:
    wide = rows.select("*", *[F.col("dense")[k].alias(name) for k, name in enumerate(FEATURES)])
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(wide).drop(*FEATURES, "dense")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED):
    """(lexicon, trees, calibration, base rate); trees and calibration are None where a class is missing."""
    sample = F.broadcast(_labelled(labels, id_col, label_col, max_labelled))  # max_labelled rows of some 20 bytes at most
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("text")).join(sample, "_id")
    rows = keep(rows.select("_id", "text", "label", "part"), "labelled")
    lexicon = learn_lexicon(rows.where("part > 0"), MAX_TERMS)
    known = keep(featured(rows, lexicon, ["_id", "label", "part"]), "features")
    share = known.agg(F.avg("label")).first()[0] or 0.0
    split = {(r.fit, r.label) for r in known.select((F.col("part") > 0).alias("fit"), "label").distinct().collect()}
    if len(split) < 4:
        return lexicon, None, None, share
    # Trees sample rows by their place, so rows are dealt by id and sorted: the same trees however the tables are laid out.
    dealt = known.repartition(PARTS, "_id").sortWithinPartitions("_id", "dense")
    vectors = _assembled(dealt).drop("_id")
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=10, subsamplingRate=0.8, stepSize=0.2).fit(vectors.where("part > 0"))
    held = trees.transform(vectors.where("part = 0")).select(vector_to_array("probability")[1].alias("p"), F.col("label").cast("double").alias("label"))
    calibration = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="calibrated").fit(held)
    return lexicon, trees, calibration, share


def score(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and a calibrated score from 0 to 1 for every row. `id_col` may be a struct of columns to carry along."""
    lexicon, trees, calibration, share = model
    rows = docs.select(F.col(id_col).alias("_key"), text_or_empty(text_col).alias("text"))
    if trees is None:
        return rows.select(F.col("_key").alias(id_col), F.lit(float(share)).alias("score"))
    scored = trees.transform(_assembled(featured(rows, lexicon, ["_key"]))).withColumn("p", vector_to_array("probability")[1])
    calibrated = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("calibrated")))
    # The calibrated value steps; a hundredth of the raw one orders texts within a step.
    return calibration.transform(scored).select(F.col("_key").alias(id_col), (0.99 * calibrated + 0.01 * F.col("p")).alias("score"))


def below(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that score less than `threshold`."""
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_whole"))
    return score(carried, train(docs, labels, id_col, text_col), "_row", "_whole").where(F.col("score") < threshold).select("_row.*")


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score and predicted of every row."""
    scored = score(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    held = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))
    return scored.select(id_col, held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
