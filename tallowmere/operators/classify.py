"""Merchants, categories and natures: rules, learned rules, corrections; a model only where a caller plugs one in."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallowmere.schema import CATEGORY_LEAST, CATEGORY_RULES, MERCHANT_LEAST, MERCHANTS, NATURE_LEAST, NATURES, RULE_CONFIDENCE


def _first(cases: list[tuple[Column, Column]]) -> Column:
    out = F.lit(None)
    for when, then in reversed(cases):
        out = F.when(when, then).otherwise(out)
    return out


def merchant(narration: Column) -> Column:
    """struct(name, rule) of the first rule whose text the narration contains, or null."""
    upper = F.upper(narration)
    return _first([(upper.contains(text), F.struct(F.lit(name).alias("name"), F.lit(rule).alias("rule"))) for text, name, rule in MERCHANTS])


def with_merchant(rows: DataFrame) -> DataFrame:
    m = merchant(F.col("narration"))
    return rows.withColumns({"merchant": m["name"], "merchant_rule": m["rule"], "merchant_confidence": F.when(m.isNotNull(), F.lit(RULE_CONFIDENCE))})


def learned_rules(corrections: DataFrame) -> DataFrame:
    """The last correction's category for each user and merchant."""
    return corrections.where("merchant IS NOT NULL").groupBy("user_id", "merchant").agg(F.max_by("category", "seq").alias("learned"))


def with_category(rows: DataFrame, learned: DataFrame) -> DataFrame:
    """category and category_rule: learned rule first, then the exact merchant rules; null goes to review."""
    upper = F.upper("merchant")
    rule = _first([(upper == name, F.struct(F.lit(category).alias("category"), F.lit(key).alias("rule"))) for name, category, key in CATEGORY_RULES])
    out = rows.join(learned, ["user_id", "merchant"], "left")
    known = F.col("learned").isNotNull()
    return out.withColumns({"category": F.when(known, F.col("learned")).otherwise(rule["category"]), "category_rule": F.when(known, F.concat(F.lit("learned:"), F.col("merchant"))).otherwise(rule["rule"])}).drop("learned")


def effective_category(decided: DataFrame, corrections: DataFrame) -> DataFrame:
    """(user_id, hash, category): the last correction, else the last decision, even if that came later."""
    system = decided.groupBy("user_id", "txn").agg(F.max_by("category", "seq").alias("system"))
    person = corrections.groupBy("user_id", "txn").agg(F.max_by("category", "seq").alias("person"))
    return system.join(person, ["user_id", "txn"], "full").select("user_id", "txn", F.coalesce("person", "system").alias("category")).where("category IS NOT NULL")


def nature(category: Column) -> Column:
    return _first([(category == c, F.lit(n)) for c, n in NATURES.items()])


def corrected(decided: DataFrame, asked: DataFrame) -> DataFrame:
    """Corrections as events: `asked` (user_id, txn, category, seq) with the category and merchant that `decided` has."""
    before = decided.select("user_id", "txn", F.col("category").alias("prior_category"), "merchant")
    out = asked.join(before, ["user_id", "txn"], "left")
    return out.select("user_id", "seq", "txn", "merchant", "category", "prior_category", F.lit("CategoryCorrected").alias("event_type"), F.col("user_id").cast("string").alias("corrected_by"))


def look_up(asked: DataFrame, effective: DataFrame, out: str = "category") -> DataFrame:
    """`out` of every asked (user_id, txn), and error where nothing was ever decided about it."""
    found = asked.join(effective.select("user_id", "txn", out), ["user_id", "txn"], "left")
    return found.withColumn("error", F.when(F.col(out).isNull(), F.lit(f"no_{out}_events")))


def tag_nature(rows: DataFrame, corrections: DataFrame, model: Callable[[list[str]], list[tuple[str, int]]] | None = None) -> DataFrame:
    """nature, nature_rule and error of (user_id, txn, category, merchant, transaction_type) rows.

    The row's own last correction, then the category's rule, then a model, if one is given. Rows that aren't
    expenses get an error and no nature.
    """
    mine = corrections.groupBy("user_id", "txn").agg(F.max_by("nature", "seq").alias("_mine"))
    spent = F.coalesce(F.col("transaction_type") == "expense", F.lit(False))
    by_rule = nature(F.col("category"))
    own = F.when(F.col("_mine").isNotNull(), F.concat(F.lit("learned:"), F.col("txn").cast("string")))
    out = rows.join(mine, ["user_id", "txn"], "left").withColumns({
        "nature": F.when(spent, F.coalesce("_mine", by_rule)),
        "nature_rule": F.when(spent, F.coalesce(own, F.when(by_rule.isNotNull(), F.concat(F.lit("rule:"), F.col("category"))))),
        "error": F.when(~spent, F.lit("nature_on_non_expense")),
    }).drop("_mine")
    if model is None:
        return out
    text = F.when(spent, F.concat_ws(". ", F.concat(F.lit("Category: "), "category"), F.concat(F.lit("Merchant: "), "merchant")))
    return with_model(out.withColumn("_ask", text), model, "_ask", "nature", NATURE_LEAST).drop("_ask")


def effective_nature(tagged: DataFrame, corrections: DataFrame) -> DataFrame:
    """(user_id, txn, nature): the row's last correction, else its last tag."""
    system = tagged.groupBy("user_id", "txn").agg(F.max_by("nature", "seq").alias("system"))
    person = corrections.groupBy("user_id", "txn").agg(F.max_by("nature", "seq").alias("person"))
    return system.join(person, ["user_id", "txn"], "full").select("user_id", "txn", F.coalesce("person", "system").alias("nature")).where("nature IS NOT NULL")


def with_model(rows: DataFrame, model: Callable[[list[str]], list[tuple[str, int]]], text: str, out: str, least: int = CATEGORY_LEAST) -> DataFrame:
    """`out` and `out`_confidence from a model (texts to names with basis points) where `out` is null; unsure ones stay null.

    The answers are decisions: callers store them, and don't ask again.
    """

    def ask(batches):
        for pdf in batches:
            open_ = pdf[out].isna() & pdf[text].notna()
            if open_.any():
                answers = model(pdf.loc[open_, text].tolist())
                pdf.loc[open_, out] = [name if sure >= least else None for name, sure in answers]
                pdf.loc[open_, f"{out}_confidence"] = pd.array([sure for _, sure in answers], "Int32")
            yield pdf

    rows = rows.withColumn(f"{out}_confidence", F.when(F.col(out).isNotNull(), F.lit(RULE_CONFIDENCE)).cast("int"))
    return rows.mapInPandas(ask, rows.schema)


def stub_model(first: str, sure: int = 8000) -> Callable[[list[str]], list[tuple[str, int]]]:
    """A model that always gives the same answer, for tests."""
    return lambda texts: [(first, sure)] * len(texts)



ANSWER = "kind string, text string, name string, confidence int, model string, prompt_version string"


def ask_once(texts: DataFrame, stored: DataFrame, model: Callable[[list[str]], list[tuple[str, int]]], kind: str, version: str, batch: int = 64) -> DataFrame:
    """New answers (kind, text, name, confidence, model, prompt_version) for the different texts that `stored` doesn't answer.

    Texts are asked for by their content, whoever has them, some at a time. The caller stores what comes back before
    asking again; answers of another version are no answers.
    """
    known = stored.where((F.col("kind") == kind) & (F.col("prompt_version") == version)).select("text")
    open_ = texts.where("text IS NOT NULL").select("text").distinct().join(known, "text", "left_anti")
    name = getattr(model, "__name__", "model")

    def ask(batches):
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                asked = pdf["text"].iloc[k : k + batch].tolist()
                yield pd.DataFrame([(kind, t, n, sure, name, version) for t, (n, sure) in zip(asked, model(asked), strict=True)], columns=["kind", "text", "name", "confidence", "model", "prompt_version"])

    return open_.mapInPandas(ask, ANSWER)


def with_answers(rows: DataFrame, stored: DataFrame, text: str, out: str, kind: str, version: str, least: int) -> DataFrame:
    """`out`, `out`_confidence and `out`_review: stored answers where `out` is null, the unsure ones for review instead."""
    mine = stored.where((F.col("kind") == kind) & (F.col("prompt_version") == version)).groupBy(F.col("text").alias("_text")).agg(F.max_by(F.struct("name", "confidence"), "confidence").alias("_a"))
    met = rows.join(mine, F.col(text) == F.col("_text"), "left")
    open_, sure = F.col(out).isNull(), F.col("_a.confidence") >= least
    return met.withColumns({out: F.when(open_ & sure, F.col("_a.name")).otherwise(F.col(out)), f"{out}_confidence": F.when(open_, F.col("_a.confidence")).otherwise(RULE_CONFIDENCE), f"{out}_review": open_ & ~F.coalesce(sure, F.lit(False))}).drop("_a", "_text")
