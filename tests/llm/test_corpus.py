"""Fill-in-middle, suffix-array dedup and the filter audit against plain code, and their edge cases."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tallowmere.llm import fill_middle, filter_audit, suffix_repeats, suffix_sort
from tallowmere.llm.queries_corpus import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, id bigint, hash string, `a.b` int, n int, key string, body string"
R = random.Random(5)
WORDS = ["".join(R.choice("abcdefgiou") for _ in range(R.randint(2, 9))) for _ in range(300)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


COMMON = prose(70, 1000)
NEAR = [prose(40, s) + " " + " ".join(w if R.random() > 0.05 else "changed" for w in COMMON.split()) + " " + prose(30, -s) for s in range(1, 30)]
ODD = [None, "", "", " ", "a", "é", "日本語テスト😀x9", "<P>", "a<S", "x<<M>y", "<<P", "A" * 199, "x" * 200, "x" * 700, "ab" * 300, "é" * 250, "tab\tand\nfeed\rAB#", COMMON, COMMON, "Zz " + COMMON, COMMON + "!", COMMON[:199], COMMON[3:203], prose(60, 3) + COMMON + prose(60, 4) + COMMON, "long " * 3 + prose(30000, 8)]


def table_of(texts):
    rows = [(k, t, ["en", None, "", "de"][k % 4], 1, "clash", 2, 3, "clash", "clash") for k, t in enumerate(texts)]
    return rows + [rows[17], rows[17], (None, "no id", "en", *rows[0][3:]), (None, COMMON, "en", *rows[0][3:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(table_of(ODD + NEAR), DOCS).repartition(4)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in range(40)] + [(4, 1, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = con.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(str(tuple(r[names.index(c)] for c in cols)) for r in found.fetchall())


def plain_sample(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_samples_equal_plain_code_and_go_back(spark, nothing):
    from pyspark.sql import functions as F

    r = random.Random(3)
    texts = ODD + ["".join(r.choice(["ab", "Z", " ", "é", "日", "😀", "<", "P", "S", "M", ">", "9\n"]) for _ in range(r.randint(0, 60))) for _ in range(400)]
    rows = table_of(texts)
    out = fill_middle.samples(spark.createDataFrame(rows, DOCS).repartition(3)).withColumn("back", fill_middle.restore(F.col("form"), F.col("output"))).collect()
    assert Counter(tuple(x)[:6] for x in out) == Counter(plain_sample(x[0], x[1]) for x in rows)
    assert {x.form for x in out} == {"plain", "psm", "spm"}
    assert Counter((x.doc_id, x.back) for x in out) == Counter((x[0], x[1] or "") for x in rows)
    assert fill_middle.samples(nothing).count() == 0


def test_word_marks_of_every_byte():
    data = np.arange(256, dtype=np.uint8)
    w = data.view("<u8")
    marked = lambda m: {k for k in range(256) if m.view(np.uint8)[k] & 128}
    assert marked(fill_middle.letter_marks(w)) == {*range(65, 91), *range(97, 123)}
    assert marked(fill_middle.continuation_marks(w)) == {*range(128, 192)}


def test_rank_and_select():
    r = np.random.default_rng(1)
    flags = r.random(4096) < 0.3
    marks = fill_middle.Marks((flags.astype(np.uint8) << 7).view("<u8"))
    at = np.arange(4097)
    assert np.array_equal(marks.rank(at), np.concatenate([[0], np.cumsum(flags)]))
    assert np.array_equal(marks.select(np.arange(1, flags.sum() + 1)), np.flatnonzero(flags) + 1)


def plain_removal(texts, length):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) of each text, from all strings of `length` bytes."""
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in bodies for k in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"most": 4}, {"most": 1, "slice_bytes": 300, "broadcast_keys": 1}, {"sorted_bytes": 500, "slice_bytes": 64}])
def test_removal_equals_all_strings(docs, options):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = Counter((i, *w) for (i, _), w in zip(rows, plain_removal([t for _, t in rows], 200)))
    out = suffix_repeats.judge(docs, **options).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == want
    assert sum(w[2] > 0 for w in want) > 30
    texts = dict(rows)
    for r in out:
        kept = suffix_repeats.kept_bytes((texts[r.doc_id] or "").encode(), [[s.start, s.stop] for s in r.spans]) if r.doc_id is not None else None
        assert kept is None or hashlib.sha256(kept).hexdigest() == r.kept_sha256


def test_removal_of_other_lengths_and_of_nothing(spark, docs, nothing):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    out = suffix_repeats.judge(docs, length=40, gram=9, most=8).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == Counter((i, *w) for (i, _), w in zip(rows, plain_removal([t for _, t in rows], 40)))
    assert suffix_repeats.judge(nothing).count() == 0


def test_removal_over_the_smallest_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = QUERIES["op12_suffix_array_dedup"](spark, SF).collect()
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out} == {(i, *w) for (i, _), w in zip(rows, plain_removal([t for _, t in rows], 200))}


@pytest.mark.parametrize("seed", range(40))
def test_suffix_order_and_prefixes(seed):
    r = random.Random(seed)
    data = bytes(r.choice(b"ab\x00\xffc"[: r.randint(1, 5)]) for _ in range(r.randint(1, 300))) + suffix_sort.END
    full = np.frombuffer(data, np.uint8)
    wanted = np.array([r.random() < 0.6 for _ in data[:-2]] + [False, False])
    ahead = suffix_sort.words(full)
    order = suffix_sort.suffix_array(full, wanted, ahead, 400)
    assert list(order) == sorted(np.flatnonzero(wanted), key=lambda k: data[k:])
    small = suffix_sort.is_small(full)
    assert all(small[k] == (data[k:] < data[k + 1 :]) for k in range(len(data) - 1))
    for a, b, n in zip(order, order[1:], suffix_sort.common_prefixes(order, ahead, 50)[1:]):
        same = next((k for k in range(50) if data[a + k : a + k + 1] != data[b + k : b + k + 1]), 50)
        assert n == same or max(a, b) + n >= len(data)


def test_windows_share_anchors_with_equal_windows():
    r = random.Random(2)
    data = bytes(r.choice(b"abcd") for _ in range(3000))
    data = np.frombuffer(data + data[500:1500], np.uint8)
    first, n, anchor, key = suffix_repeats.anchors(data, 200, 24)
    assert first[0] == 0 and first[-1] + n[-1] == len(data) - 199 and (first[1:] == first[:-1] + n[:-1]).all()
    of = {s + k: (int(a) - k, int(h)) for s, m, a, h in zip(first.tolist(), n.tolist(), anchor, key) for k in range(m)}
    assert all(of[500 + k] == of[3000 + k] for k in range(801))


def plain_audit(rows, labels):
    quality, toxic = defaultdict(int), defaultdict(int)
    for i, q, t in labels:
        if i is not None:
            quality[i], toxic[i] = max(quality[i], q), max(toxic[i], t)
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    fails = []
    for i, t, part in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        f = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and smallest[t] < i}
        fails.append((part or "", {k for k, v in f.items() if v}, quality[i] == 1, toxic[i] == 1))
    out, taken = {}, Counter()
    for part in {f[0] for f in fails}:
        mine = [f[1:] for f in fails if f[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for k, x in enumerate(order):
                here = [f for f in mine if not f[0] & set(order[:k])]
                gone = [f for f in here if x in f[0]]
                out[part, order, k + 1] = [len(here) - len(gone), len(gone), sum(x in f[0] for f in mine) - len(gone), sum(f[0] == {x} for f in mine), sum(f[1] for f in gone), sum(f[2] for f in gone)]
                taken[part, x] += len(gone)
    return {(*k, *v, taken[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_plain_code(spark, docs, labels, nothing, monkeypatch):
    rows, marks = [(r.doc_id, r.text, r.lang) for r in docs.collect()], [tuple(r) for r in labels.collect()]
    want = plain_audit(rows, marks)
    assert {tuple(r) for r in filter_audit.audit(docs, labels).collect()} == want
    monkeypatch.setattr(filter_audit, "BROADCAST_HASHES", 1)
    assert {tuple(r) for r in filter_audit.audit(docs, labels).collect()} == want
    assert filter_audit.audit(nothing, labels).count() == 0
    assert {tuple(r) for r in filter_audit.audit(docs, labels.limit(0)).collect()} == plain_audit(rows, [])


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<form><div><article><p>Long text</p></article></div></form>", "Long text"),
        ("<form><h1>Title</h1><p>One</p><input><select><option>x</option></select></form>", "Title\nOne"),
        ("<p>Before</p><form><p>Your name</p><label>Mail</label><input></form>", "Before"),
        ("<div class='search page'><article><p>x y</p></article></div>", "x y"),
        ("<div class='search page'><div role='main'><p>x y</p></div></div>", "x y"),
        ("<article><p>area <math>x</math> done</p><p>see <label>this</label> word</p><p>press <button>OK</button> now</p><button>Share</button></article>", "area x done\nsee this word\npress OK now"),
        ("<article><p>a</p><div class='reader-comments'>nice</div><div class='user-comment-text'>nice</div></article>", "a"),
        ("<body class='comments-open'><article class='post has-comments'><p>kept</p></article><article class='comment'><p>no</p></article></body>", "kept"),
    ],
)
def test_pages_in_forms_names_and_inline_words(html, text):
    from tallowmere.llm.html_text import text_of

    assert text_of(html) == text


def test_toxicity_does_not_hang_on_the_layout(spark):
    from tallowmere.llm import toxicity

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scores = []
    for parts, shuffles in ((3, 4), (5, 7)):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        scores.append({r.doc_id: r.score for r in toxicity.judge(docs.repartition(parts), labels.repartition(parts)).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert scores[0].keys() == scores[1].keys() and len(scores[0]) == 1000
    assert max(abs(scores[0][k] - scores[1][k]) for k in scores[0]) < 1e-9


ODD_DOCS = "doc_id bigint, text string, lang string, source string, `a.b` string, _row int, score double, distance double, n_chars bigint"


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, "x", 1, 0.5, 1.0, 7), (1, None, None, None, "x", 1, 0.5, 1.0, 7), (2, "", "en", "a", None, None, None, None, None), (3, prose(9000, 1), "en", "a", "y", 2, 0.1, 0.2, 3), (None, prose(200, 2), None, "b", "z", 3, None, None, None)]])
def test_stages_on_odd_tables(spark, rows, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame(rows, ODD_DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    left = docs.collect()
    assert {r.doc_id for r in left} <= {3, None} and all(r["a.b"] in ("y", "z") for r in left)
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in placed} == {r.doc_id for r in left}
