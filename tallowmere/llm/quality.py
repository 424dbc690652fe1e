"""Quality rules: base rules over words and lines, then robust multivariate outliers.

Each text gives a few counts. Transformed to a vector, they are judged against a minimum-covariance-
determinant estimate of the text's language and source: the mean and covariance of the rows, at least
`SUPPORT` of them, that lie closest together. From two starts (coordinate medians with their median
deviations, and all rows) every concentration step keeps the nearest rows and estimates anew; the start
that ends with the smaller determinant counts. A row whose squared Mahalanobis distance exceeds the
chi-square quantile at `CUTOFF` is rejected. Variances get a floor, so that a statistic that is constant
within the support neither breaks the inverse nor makes specks of dust outliers.

Everything is DataFrame and SQL functions. A text is looked at in its own row; its counts are written once
to the shared folder, and each step after is one partially aggregated pass over those numbers by group and
distance bin, so a source that holds a third of all rows costs no task more than any other. The vectors
are fixed-point integers: sums don't depend on the order of rows, and results repeat exactly.

Null and empty texts have no words (base_failed, not kept). A null language or source is a group of its
own. A group of fewer than `MIN_ROWS` rows is judged with its language's other small groups; if those are
still fewer, by the estimate of its whole language, and if that is too small, by that of the whole corpus,
of whatever size: every row gets a distance. Repeated rows are judged each on their own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowmere.llm.common import keep, text_or_empty

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SUPPORT, STEPS, MIN_ROWS, CUTOFF = 0.75, 3, 200, 1 - 1e-9
#: Groups up to this many travel to every task; beyond it their estimates are joined by a shuffle.
BROADCAST_GROUPS = 20_000
#: Fixed point of the vectors.
ONE = 256
#: The vector: (SQL of the transformed statistic, floor of its standard deviation).
VECTOR = [
    ("ln(1 + n_words)", 0.5),
    ("ln((1 + word_chars) / (1 + n_words))", 0.08),
    ("ln(1 + 10.0 * n_symbols / (1 + n_words))", 0.15),
    ("ln(1 + 10.0 * n_dup_lines / (1 + n_lines))", 0.35),
    ("sqrt(n_repeat_words / (1.0 + n_words))", 0.12),
]
DIM = len(VECTOR)
WORD, SYMBOL = r"[^\x20\x09-\x0D]+", r"[#*$%&|<>]"


def chi_square_cdf(x: float, dof: int) -> float:
    """Regularised lower incomplete gamma function at (dof / 2, x / 2), by its series."""
    a, z = dof / 2, x / 2
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= z / k
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a))) if x > 0 else 0.0


def chi_square_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, dof) < p else (low, mid)
    return (low + high) / 2


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The counts of every text, and whether it fails the base rules."""
    rows = docs.select(F.col(id_col), *[F.col(c).cast("string").alias(c) for c in also], text_or_empty(text_col).alias("_text"))
    rows = rows.select(
        id_col,
        *also,
        F.regexp_count("_text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        F.regexp_extract_all("_text", F.lit(WORD), 0).alias("_words"),
    )
    rows = rows.select(
        id_col,
        *also,
        "n_symbols",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_words") >= 3, F.zip_with(F.expr("zip_with(_words, slice(_words, 2, size(_words)), (a, b) -> xxhash64(a, b))"), F.expr("slice(_words, 3, size(_words))"), lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.xxhash64(a, b)))).alias("_open"),
    )
    rows = rows.withColumn("_windows", F.slice("_open", 1, F.greatest(F.lit(1), F.col("n_words").cast("int") - 2)))
    # Only texts that have a window twice need positions: windows sorted by hash, those with an equal neighbour, back in text order.
    rows = rows.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    rows = rows.withColumn("_hashes", F.transform("_sorted", lambda x: x.h))  # not `_sorted.h`, which would be taken out anew for each element
    rows = rows.withColumn("_twice", F.expr("filter(_sorted, (x, k) -> (k > 0 AND get(_hashes, k - 1) = x.h) OR (k < size(_hashes) - 1 AND get(_hashes, k + 1) = x.h))"))
    rows = rows.withColumn("_places", F.sort_array(F.col("_twice.i")))
    covered = "aggregate(_places, named_struct('n', 0L, 'last', -3), (a, p) -> named_struct('n', a.n + least(3, p - a.last), 'last', p), a -> a.n)"
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.expr(covered), F.lit(0).cast("long")))
    failed = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"
    return rows.select(id_col, *also, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", F.expr(failed).alias("base_failed"))


def _bounded(df: DataFrame) -> DataFrame:
    """`df`, to be broadcast if it is known to be small."""
    return F.broadcast(df) if df.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else df


def _keyed(stats: DataFrame) -> DataFrame:
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    return stats.withColumns({"_l": key("lang"), "_s": key("source")})


def _groups(stats: DataFrame) -> DataFrame:
    """For each language and source the key of the group that judges it, and all groups that its rows are part of."""
    sizes = _keyed(stats).groupBy("_l", "_s").agg(F.count("*").alias("_n"))
    own, rest, whole = F.col("_n") >= MIN_ROWS, F.col("_rest") >= MIN_ROWS, F.col("_whole") >= MIN_ROWS
    languages = sizes.groupBy("_l").agg(F.sum(F.when(~own, F.col("_n"))).alias("_rest"), F.sum("_n").alias("_whole"))
    tail = languages.agg(F.max(~whole).alias("_tail"))
    key = F.when(own, F.concat_ws("\u0001", "_l", "_s")).when(rest, F.concat(F.col("_l"), F.lit("\u0001*")))
    language, corpus = F.concat(F.lit("+"), F.col("_l")), F.lit("*")  # languages' keys begin otherwise
    parts = F.array(key, F.when((F.col("_rest") < MIN_ROWS) & whole, language), F.when(F.col("_tail"), corpus))
    return keep(sizes.join(languages, "_l").crossJoin(F.broadcast(tail)).select("_l", "_s", F.coalesce(key, F.when(whole, language), corpus).alias("_g"), F.array_compact(parts).alias("_parts")), "groups")


def _grouped(stats: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows with their vectors and group keys."""
    vector = {f"x{k}": F.expr(f"cast(round({ONE} * ({sql})) as bigint)") for k, (sql, _) in enumerate(VECTOR)}
    return _keyed(stats).join(_bounded(groups), ["_l", "_s"], "left").drop("_l", "_s").withColumns(vector)


def _triangle() -> list[tuple[int, int]]:
    return [(i, j) for i in range(DIM) for j in range(i + 1)]


def _sums() -> list[tuple[str, str]]:
    return [("n", "count(*)"), *[(f"s{i}", f"sum(x{i})") for i in range(DIM)], *[(f"q{i}_{j}", f"sum(x{i} * x{j})") for i, j in _triangle()]]


def _estimate(sums: DataFrame) -> DataFrame:
    """Mean, Cholesky factor and log-determinant from the sums of the kept rows."""
    out = sums.selectExpr("_g", "_start", *[f"s{i} / n AS m{i}" for i in range(DIM)], *[f"q{i}_{j} / n - (s{i} / n) * (s{j} / n)" + f" + {(VECTOR[i][1] * ONE) ** 2}" * (i == j) + f" AS c{i}_{j}" for i, j in _triangle()])
    return _factor(out)


def _factor(out: DataFrame) -> DataFrame:
    for i, j in _triangle():
        rest = "".join(f" - l{i}_{k} * l{j}_{k}" for k in range(j))
        out = out.withColumn(f"l{i}_{j}", F.expr(f"sqrt(greatest(c{i}_{j}{rest}, 1e-6))" if i == j else f"(c{i}_{j}{rest}) / l{j}_{j}"))
    return out.selectExpr("_g", "_start", *[f"m{i}" for i in range(DIM)], *[f"l{i}_{j}" for i, j in _triangle()], " + ".join(f"2 * ln(l{i}_{i})" for i in range(DIM)) + " AS logdet")


def _distance(rows: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance by forward substitution."""
    for i in range(DIM):
        rest = "".join(f" - l{i}_{k} * y{k}" for k in range(i))
        rows = rows.withColumn(f"y{i}", F.expr(f"(x{i} - m{i}{rest}) / l{i}_{i}"))
    return rows.withColumn("d2", F.expr(" + ".join(f"y{i} * y{i}" for i in range(DIM))))


def _medians(rows: DataFrame) -> DataFrame:
    """Estimates from coordinate medians and median absolute deviations, exact, from counts of each value."""

    def median(values: DataFrame) -> DataFrame:
        counts = values.groupBy("_g", "k", "v").agg(F.count("*").alias("n"))
        order = "PARTITION BY _g, k ORDER BY v"
        counts = counts.selectExpr("_g", "k", "v", f"sum(n) OVER ({order}) AS upto", "sum(n) OVER (PARTITION BY _g, k) AS total")
        return counts.where("2 * upto >= total").groupBy("_g", "k").agg(F.min("v").alias("mid"))

    long = rows.selectExpr("_g", f"stack({DIM}, {', '.join(f'{k}, x{k}' for k in range(DIM))}) AS (k, v)")
    middle = keep(median(long), "medians")
    spread = median(long.join(_bounded(middle), ["_g", "k"]).selectExpr("_g", "k", "abs(v - mid) AS v")).withColumnRenamed("mid", "dev")
    both = middle.join(spread, ["_g", "k"])
    wide = both.groupBy("_g").agg(*[F.max(F.when(F.col("k") == i, F.col("mid"))).cast("double").alias(f"m{i}") for i in range(DIM)], *[F.max(F.when(F.col("k") == i, F.col("dev"))).alias(f"v{i}") for i in range(DIM)])
    return _factor(wide.selectExpr("_g", "0 AS _start", *[f"m{i}" for i in range(DIM)], *[f"pow(1.4826 * v{i}, 2) + {(VECTOR[i][1] * ONE) ** 2} AS c{i}_{i}" if i == j else f"0D AS c{i}_{j}" for i, j in _triangle()]))


def mcd(rows: DataFrame) -> DataFrame:
    """One estimate for each group key of `rows`, which are counted in all groups that they are part of."""
    rows = rows.select(F.explode("_parts").alias("_g"), *[f"x{i}" for i in range(DIM)])
    everyone = _estimate(rows.groupBy("_g").agg(*[F.expr(sql).alias(name) for name, sql in _sums()]).withColumn("_start", F.lit(1)))
    at = keep(_medians(rows).unionByName(everyone), "mcd")
    names = [name for name, _ in _sums()]
    for _ in range(STEPS):
        near = _distance(rows.join(_bounded(at), "_g")).withColumn("bin", F.expr("cast(floor(16 * log2(d2 + 1D / 64)) as int)"))
        bins = near.groupBy("_g", "_start", "bin").agg(*[F.expr(sql).alias(name) for name, sql in _sums()])
        order = "OVER (PARTITION BY _g, _start ORDER BY bin)"
        upto = bins.selectExpr("_g", "_start", "bin", *[f"sum({c}) {order} AS {c}" for c in names], "sum(n) OVER (PARTITION BY _g, _start) AS total")
        first = upto.where(f"n >= {SUPPORT} * total").groupBy("_g", "_start").agg(F.min_by(F.struct(*names), "bin").alias("k"))
        at = keep(_estimate(first.select("_g", "_start", "k.*")), "mcd")
    best = at.groupBy("_g").agg(F.min_by(F.struct(*[c for c in at.columns if c != "_g"]), F.struct("logdet", "_start")).alias("k"))
    return best.select("_g", "k.*")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(statistics, groups, estimates) of a corpus, each written to the shared folder."""
    stats = keep(statistics(docs, id_col, text_col), "statistics")
    groups = _groups(stats)
    return stats, groups, keep(mcd(_grouped(stats, groups)), "estimates")


def _verdicts(stats: DataFrame, groups: DataFrame, estimates: DataFrame) -> DataFrame:
    shrink = SUPPORT / chi_square_cdf(chi_square_quantile(SUPPORT, DIM), DIM + 2)
    near = F.col("distance") <= chi_square_quantile(CUTOFF, DIM)
    rows = _distance(_grouped(stats, groups).drop("_parts").join(_bounded(estimates), "_g", "left"))
    return rows.withColumn("distance", F.col("d2") / shrink).withColumn("kept", ~F.col("base_failed") & near)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_symbols, ..., base_failed, kept and the distance of every row."""
    rows = _verdicts(*fit(docs, id_col, text_col))
    return rows.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, that are kept. Rows are written with their counts rather than joined to verdicts by an id."""
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("lang"), F.col("source"), F.col(text_col).alias("_whole"))
    return _verdicts(*fit(carried, "_row", "_whole")).where("kept").select("_row.*")
