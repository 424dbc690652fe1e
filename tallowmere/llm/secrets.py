"""Secret scans: pattern spans of every text, and how widely each secret is owned across the corpus.

Base patterns (assignments, access keys, long hex) are found in whole texts, leftmost and without overlap
within a kind; so are long tokens that mix capitals, small letters and digits where no base span lies. Every
candidate's value is hashed, and the corpus gives each hash its number of distinct repositories and owners:
a value that at least `EXAMPLE_REPOS` repositories of at least `EXAMPLE_OWNERS` owners hold is a copied
example; any other looks like a live credential of its owner. The values of the latter are added as spans of
the kind `live`, whether a base span holds them or not; base spans always stay.

DataFrame functions only. Texts are scanned in their own rows. What is found, a small share of the corpus,
is written once to the shared folder with a row number; distinct (hash, repository) and (hash, owner) pairs
are formed and counted with partial aggregation, so a value that a third of all rows hold is reduced before
each shuffle, and the counts join back as a join that adaptive execution can split.

Null and empty texts have no spans. A null repository or owner counts as one of its own. Repeated rows are
scanned each on their own (they name the same repository, so they don't make a value an example), and so are
values that a text repeats. An empty table gives an empty table. Other columns of `docs`, whatever their names,
are left out by `scan` and carried along by `redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallowmere.llm.common import keep, text_or_empty

EXAMPLE_REPOS, EXAMPLE_OWNERS = 3, 3
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SIGNS = "A-Za-z0-9+/_=-"
#: (kind, pattern, least length, group that the value and the least length are of), in the order of kinds.
BASE = [("assign", ASSIGN, 6, 1), ("access", r"AKIA[A-Z0-9]{16,}", 20, 0), ("hex", r"[0-9a-f]{24,}", 24, 0)]
LIVE = ("live", rf"(?<![{SIGNS}])(?=[{SIGNS}]*?[0-9])(?=[{SIGNS}]*?[A-Z])(?=[{SIGNS}]*?[a-z])[{SIGNS}]{{20,}}", 20, 0)
KINDS = [*BASE, LIVE]
#: Lengths are summed in blocks of this many to place the matches of a text.
BLOCK = 128


def _spans(rows: DataFrame, number: int) -> DataFrame:
    """Adds `_c{number}`: the candidates of a kind as structs (start, no, end, value), in code points."""
    kind, pattern, least, group = KINDS[number]
    m, p, n, s, b, out = (f"_{x}{number}" for x in "mpnsbc")
    some = F.size(m) > 0
    rows = rows.withColumn(m, F.regexp_extract_all("_text", F.lit(pattern), 0))
    # Texts between matches: their lengths and those of the matches, summed up, are the places.
    rows = rows.withColumn(p, F.when(some, F.transform(F.split("_text", pattern, -1), lambda x: F.length(x).cast("long"))))
    rows = rows.withColumn(n, F.zip_with(p, m, lambda a, x: a + F.coalesce(F.length(x), F.lit(0)).cast("long")))
    rows = rows.withColumn(s, F.expr(f"transform(sequence(0, (size({n}) - 1) div {BLOCK}), b -> aggregate(slice({n}, cast(b * {BLOCK} + 1 as int), {BLOCK}), 0L, (a, x) -> a + x))"))
    rows = rows.withColumn(b, F.expr(f"transform({s}, (x, b) -> aggregate(slice({s}, 1, b), 0L, (a, y) -> a + y))"))
    value = f"regexp_extract(x, '{_quoted(pattern)}', 1)" if group else "x"
    start = f"get({b}, cast(k div {BLOCK} as int)) + aggregate(slice({n}, cast((k div {BLOCK}) * {BLOCK} + 1 as int), k % {BLOCK}), 0L, (a, y) -> a + y) + get({p}, k)"
    found = f"transform({m}, (x, k) -> named_struct('start', {start}, 'no', {number}, 'size', length(x), 'value', {value}))"
    rows = rows.withColumn(out, F.when(some, F.expr(f"filter(transform({found}, y -> named_struct('start', y.start, 'no', y.no, 'end', y.start + y.size, 'value', y.value)), y -> length(y.value) >= {least})")))
    rows = rows.withColumn(out, F.coalesce(F.col(out), F.expr(f"cast(array() as array<{SPAN}>)")))
    return rows.drop(m, p, n, s, b)


SPAN = "struct<start: bigint, no: int, end: bigint, value: string>"


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def candidates(docs: DataFrame, also: list[str], text_col: str = "text") -> DataFrame:
    """The `also` columns, the text as `_text`, `base` spans in order and `values`: the distinct places of all candidates' values."""
    rows = docs.select(*also, text_or_empty(text_col).alias("_text"))
    for number in range(len(KINDS)):
        rows = _spans(rows, number)
    last = len(KINDS) - 1
    rows = rows.withColumn("base", F.sort_array(F.concat(*[F.col(f"_c{k}") for k in range(last)])))
    free = F.filter(f"_c{last}", lambda x: ~F.exists("base", lambda y: (y.start < x.end) & (x.start < y.end)))
    # a pattern ends with its value
    values = F.transform(F.concat("base", free), lambda x: F.struct((x.end - F.length(x.value)).alias("start"), x.end.alias("end"), x.value.alias("value")))
    return rows.select(*also, "_text", "base", F.array_distinct(values).alias("values"))


def ownership(found: DataFrame) -> DataFrame:
    """n_repos and n_owners of each `hash` of rows (hash, repo, owner)."""
    repos = found.select("hash", "repo").distinct().groupBy("hash").agg(F.count("*").alias("n_repos"))
    owners = found.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("n_owners"))
    return repos.join(owners, "hash")


def judged(docs: DataFrame, repo_col: str, owner_col: str, carried: str, text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Every row's `carried` column, its `base` spans, and `judged`: all candidates' values with `example` (widely copied)."""
    named = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")).alias(n) for c, n in ((repo_col, "_repo"), (owner_col, "_owner"))]
    rows = docs.select(F.col(carried).alias("_carried"), F.col(text_col).alias("_whole"), *named)
    rows = candidates(rows, ["_carried", "_repo", "_owner"], "_whole")
    rows = keep(rows.withColumn("_row", F.monotonically_increasing_id()).drop(*[] if with_text else ["_text"]), "candidates")
    empty = F.expr(f"cast(array() as array<{JUDGED}>)")
    none = rows.where(F.size("values") == 0).withColumn("judged", empty)
    some = rows.where(F.size("values") > 0)
    each = some.select("_row", F.col("_repo").alias("repo"), F.col("_owner").alias("owner"), F.explode("values").alias("f")).withColumn("hash", F.sha2("f.value", 256))
    seen = each.join(keep(ownership(each), "ownership"), "hash").withColumn("example", (F.col("n_repos") >= EXAMPLE_REPOS) & (F.col("n_owners") >= EXAMPLE_OWNERS))
    lists = seen.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("f.start", "f.end", "example"))).alias("judged"))  # of one text
    some = some.join(lists, "_row").select(*none.columns)
    return some.unionByName(none).drop("values", "_row", "_repo", "_owner")


JUDGED = "struct<start: bigint, end: bigint, example: boolean>"


def _written(spans: str) -> Column:
    kinds = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x.no), x.start.cast("string"), x.end.cast("string"))), ",")


def scan(docs: DataFrame, repo_col: str, owner_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_assign, n_access, n_hex, base_sha256, spans, and how many values are live or examples."""
    rows = judged(docs, repo_col, owner_col, id_col, text_col)
    counts = [F.expr(f"size(filter(base, x -> x.no = {k}))").cast("long").alias(f"n_{kind[0]}") for k, kind in enumerate(BASE)]
    live = F.filter("judged", lambda x: ~x.example)
    marks = F.transform(live, lambda x: F.struct(x.start.alias("start"), F.lit(len(BASE)).alias("no"), x.end.alias("end")))
    rows = rows.withColumn("spans", F.sort_array(F.concat(F.transform("base", lambda x: F.struct(x.start.alias("start"), x.no.alias("no"), x.end.alias("end"))), marks)))
    return rows.select(
        F.col("_carried").alias(id_col),
        *counts,
        F.sha2(_written("base"), 256).alias("base_sha256"),
        _written("spans").alias("spans"),
        F.size(live).cast("long").alias("n_live"),
        F.size(F.filter("judged", lambda x: x.example)).cast("long").alias("n_examples"),
    )


def redact(docs: DataFrame, repo: Column, owner: Column, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every candidate whose value isn't a copied example replaced by `mark` (overlapping ones by a single one)."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("_carried"), F.col(text_col).alias("_whole"), repo.alias("_r"), owner.alias("_o"))
    rows = judged(rows, "_r", "_o", "_carried", "_whole", with_text=True)
    # A base span is what its value is; spans come by start, and one that starts within an earlier one continues it.
    example = "exists(judged, y -> y.example AND y.end = x.end AND y.start = x.end - length(x.value))"
    rows = rows.withColumn("_live", F.expr(f"""sort_array(concat(
        transform(filter(base, x -> NOT {example}), x -> named_struct('start', x.start, 'end', x.end)),
        transform(filter(judged, y -> NOT y.example), y -> named_struct('start', y.start, 'end', y.end))))"""))
    merged = """aggregate(_live, cast(array() as array<struct<s: bigint, e: bigint>>), (a, x) ->
        CASE WHEN size(a) > 0 AND x.start < element_at(a, -1).e
        THEN concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, 'e', greatest(element_at(a, -1).e, x.end))))
        ELSE concat(a, array(named_struct('s', x.start, 'e', x.end))) END)"""
    rows = rows.withColumn("_cuts", F.expr(merged))
    between = f"transform(_cuts, (c, k) -> concat(substring(_text, cast(if(k = 0, 0L, get(_cuts, k - 1).e) as int) + 1, cast(c.s - if(k = 0, 0L, get(_cuts, k - 1).e) as int)), '{mark}'))"
    cleaned = F.when(F.size("_cuts") == 0, F.col("_carried")[text_col]).otherwise(F.concat(F.array_join(F.expr(between), ""), F.expr("substring(_text, cast(element_at(_cuts, -1).e as int) + 1)")))
    return rows.select(*[cleaned.alias(c) if c == text_col else F.col("_carried")[c].alias(c) for c in docs.columns])
