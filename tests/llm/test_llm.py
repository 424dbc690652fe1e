"""The training-data operators against plain code, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallowmere.llm import html_text, jaccard, neighbours, packing, quality, secrets, sentencepiece_viterbi, token_counts, toxicity, urls

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id bigint, text string, lang string, source string, n_words string, bin int, features string"
R = random.Random(7)
WORDS = ["".join(R.choice("abcdefgiou") for _ in range(R.randint(2, 9))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return "\n".join(" ".join(r.choice(WORDS) for _ in range(12)) for _ in range(max(1, n // 12)))


ODD = [None, "", " ", "\n\n", "a", "a  b", "  lead", "tail ", "tab\tand\rfeed", "é ü ß “quoted” 日本語 テスト 😀", "<|endoftext|> x <|endoftext|>", "word" * 3000, "it's they're I'll 'quoted'", "▁ under ▁▁ bars", " line space", "x" * 50 + " " + "9" * 40]


@pytest.fixture(scope="module")
def docs(spark):
    texts = ODD + [prose(120, s) for s in range(30)] + [prose(3000, 99)]
    rows = [(k, t, "en" if k % 2 else None, f"s{k % 3}", "clash", 1, "clash") for k, t in enumerate(texts)]
    rows += [rows[20], rows[20], (None, "without an id", "en", None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(4)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def pairs_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def test_sentencepiece_equals_the_library(spark, docs, nothing):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = sentencepiece_viterbi.encode(docs, PIECES).collect()
    want = Counter((i, tuple(model.encode(t))) for i, t in pairs_of(docs))
    assert Counter((r.doc_id, tuple(r.ids)) for r in out) == want
    encoded = sentencepiece_viterbi.encode(docs, PIECES)
    decoded = Counter((r.doc_id, r.text) for r in sentencepiece_viterbi.decode_ids(encoded, PIECES).collect())
    assert decoded == Counter((i, model.decode(list(ids))) for i, ids in want.elements())
    assert sentencepiece_viterbi.encode(nothing, PIECES).count() == 0


def test_sentencepiece_query_gives_ids_and_texts(spark):
    import sentencepiece

    from tallowmere.llm.queries_tokens import op1_sentencepiece

    sf_dir = "/root/testdata/sf0.001"
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = dict(pairs_of(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    out = {r.doc_id: r for r in op1_sentencepiece(spark, sf_dir).collect()}
    assert out.keys() == texts.keys()
    assert all(r.ids == model.encode(texts[k]) and r.decoded == model.decode(r.ids) for k, r in out.items())


def test_streaming_window_is_bounded():
    pieces = sentencepiece_viterbi.Pieces(PIECES)
    search = sentencepiece_viterbi.StreamingViterbi(pieces)
    r = random.Random(1)
    text = "".join(r.choice("abthe▁né日") for _ in range(20000))
    ids = [*search.feed(text), *search.finish()]
    import sentencepiece

    assert ids == sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text[1:] if text[0] == "▁" else text)[0 if text[0] == "▁" else 0 :] or text[0] != "▁"
    assert search.peak <= 4 * pieces.longest


def test_token_counts_equal_the_library(docs, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    out = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, BPE, 512, cache_words=50).collect())
    want = [(i, len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for i, x in pairs_of(docs)]
    assert out == Counter((i, b, n, n > 512) for i, b, n in want)
    assert token_counts.count_tokens(nothing, BPE, 512).count() == 0


def test_packing_places_every_piece(docs, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    out = packing.pack(packing.pieces(docs, BPE, 64, 2), 64, shard_pieces=100).collect()
    want = Counter()
    for i, x in pairs_of(docs):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 2], "<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids), 64)):
            want[i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for b in by.values():
        place = 0
        for offset, length in sorted(b):
            assert offset == place
            place += length
        assert place <= 64
    assert packing.pack(packing.pieces(nothing, BPE, 64, 2), 64).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_local_search_never_loses(seed):
    r = random.Random(seed)
    lengths = [r.choice([r.randint(1, 100), r.randint(35, 55)]) for _ in range(300)]
    order = sorted(lengths, reverse=True)
    bins, _ = packing.best_fit(order, 100)
    packed = packing.pack_lengths(lengths, 100)
    assert sorted(k for b in packed for k in b) == list(range(300))
    assert all(sum(lengths[k] for k in b) <= 100 for b in packed)
    assert -(-sum(lengths) // 100) <= len(packed) <= len(bins)


def fewest_bins(lengths, capacity):
    """By all subsets: fewest bins, then the least fill of the last one."""
    best = {0: (1, 0)}
    for taken in range(1, 1 << len(lengths)):
        best[taken] = min((n, fill + lengths[k]) if fill + lengths[k] <= capacity else (n + 1, lengths[k]) for k in range(len(lengths)) if taken >> k & 1 for n, fill in [best[taken ^ 1 << k]])
    return best[(1 << len(lengths)) - 1][0]


@pytest.mark.parametrize("seed", range(30))
def test_packing_against_all_packings(seed):
    r = random.Random(seed)
    lengths = [r.randint(20, 60) for _ in range(11)]
    packed = packing.pack_lengths(lengths, 100)
    assert len(packed) == fewest_bins(lengths, 100)


@pytest.mark.parametrize("seed", range(6))
def test_local_search_leaves_no_exchange(seed):
    """Where it ends above the bound, no move, one-for-one or two-for-one exchange increases the sum of squared fills."""
    r = random.Random(seed)
    lengths = [r.randint(25, 45) for _ in range(60)]
    packed = packing.pack_lengths(lengths, 100)
    if len(packed) == -(-sum(lengths) // 100):
        return
    fill = [sum(lengths[k] for k in b) for b in packed]
    for i, high in enumerate(packed):
        for j, low in enumerate(packed):
            if i == j or fill[i] == 100 or fill[j] == 100 or fill[j] > fill[i]:
                continue
            takes = [lengths[k] for k in low] + [lengths[a] + lengths[b] for n, a in enumerate(low) for b in low[n + 1 :]]
            for give in [0, *[lengths[k] for k in high]]:
                assert not any(0 < take - give <= 100 - fill[i] for take in takes)


@pytest.mark.parametrize("bounds", [(200, 500), (150, 420), (1, 12)])
def test_local_search_reaches_all_bins(bounds):
    r = random.Random(3)
    lengths = [r.randint(*bounds) for _ in range(3000)]
    capacity = 1024 if bounds[0] > 1 else 67
    order = sorted(lengths, reverse=True)
    bins, free = packing.best_fit(order, capacity)
    packed = packing.local_search([list(b) for b in bins], list(free), order, capacity)
    assert sorted(k for b in packed for k in b) == list(range(3000))
    fills = [sum(order[k] for k in b) for b in packed]
    assert max(fills) <= capacity
    least = -(-sum(lengths) // capacity)
    assert len(packed) == least or (len(packed) < len(bins) and sum(f * f for f in fills) > sum((capacity - f) ** 2 for f in free))


def base_of(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_base_rules(spark, docs, nothing):
    more = spark.createDataFrame([(900, "a b c a b c d\na b c a b c d\n \n \nx", "en", "s", None, None, None), (901, "w " * 60, "en", "s", None, None, None), (902, "# * $ % & | < >" * 9, "en", "s", None, None, None)], DOCS)
    both = docs.unionByName(more)
    out = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(both).collect())
    assert out == Counter((i, *base_of(t)) for i, t in pairs_of(both))
    assert quality.judge(nothing).count() == 0 == quality.accepted(nothing).count()


def test_quality_outliers_go_and_clean_stay(spark):
    rows = [(k, prose(random.Random(k).randint(60, 600), k), "en", "hot" if k % 3 else "s2") for k in range(700)]
    bad = [(1000 + k, re.sub(r"(\w+)", r"\1***###", prose(200, k)), "en", "hot") for k in range(40)]
    frame = spark.createDataFrame(rows + bad, "doc_id bigint, text string, lang string, source string")
    out = {r.doc_id: r for r in quality.judge(frame).collect()}
    assert not any(out[1000 + k].kept for k in range(40))
    fine = [k for k in range(700) if not out[k].base_failed]
    assert sum(out[k].kept for k in fine) == len(fine)
    assert sorted(r.doc_id for r in quality.accepted(frame).collect()) == sorted(k for k, r in out.items() if r.kept)


def test_quality_judges_small_groups(spark):
    lang = lambda k: ("en", "big") if k < 300 else ("en", "small") if k < 320 else (None, "s") if k < 325 else ("fr", f"s{k % 3}")
    rows = [(k, prose(random.Random(k).randint(60, 600), k), *lang(k)) for k in range(350)]
    bad = [(1000 + k, re.sub(r"(\w+)", r"\1***###", prose(200, k)), *lang(300 + 10 * k)) for k in range(5)]
    whole = spark.createDataFrame(rows + bad, "doc_id bigint, text string, lang string, source string")
    for frame in (whole, whole.where("doc_id < 100 OR doc_id BETWEEN 320 AND 350 OR doc_id > 1001")):  # the second has under 200 rows
        out = quality.judge(frame).collect()
        assert all(r.distance is not None for r in out) and len(out) == frame.count()
        assert [r.doc_id for r in out if not r.base_failed and not r.kept and r.doc_id < 1000] == []
        assert not any(r.kept for r in out if r.doc_id >= 1000)


def test_chi_square():
    assert abs(quality.chi_square_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(quality.chi_square_cdf(3.84146, 1) - 0.95) < 1e-5


BASE = [("assign", re.compile(r'(?:(?i:password|passwd|secret|token|api_?key))["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)'), lambda m: len(m[1]) >= 6), ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20), ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24)]


def spans_of(text):
    return sorted((m.start(), n, m.end()) for n, (_, p, ok) in enumerate(BASE) for m in p.finditer(text) if ok(m))


def test_secrets(spark, docs, nothing):
    own, shared = "Xk29fLq0PzW7vBnM3rTy8a", "Qw8eRt6yUi4oPa2sDf0gHj"
    texts = ["password=token=abcdef PASSWORD : 'x1y2z3' token=ab", "😀 AKIA" + "Z" * 16 + "AKIA1", "secret = " + "ab12" * 10 + " é " + "0" * 24, "password=token :abcdefgh", " ".join(f"token={k:08x}" for k in range(500)), f"here {own} ends"]
    rows = [(500 + k, t, "en", f"o{k}", None, None, None) for k, t in enumerate(texts)] + [(600 + k, f"sample {shared} of the manual", "en", f"o{k}", None, None, None) for k in range(8)]
    both = docs.unionByName(spark.createDataFrame(rows, DOCS))
    out = secrets.scan(both, "doc_id", "source").collect()
    assert len(out) == both.count()
    text = dict(pairs_of(both))
    for r in out:
        spans = spans_of(text[r.doc_id])
        written = ",".join(f"{BASE[n][0]}:{a}:{b}" for a, n, b in spans)
        assert r.base_sha256 == hashlib.sha256(written.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(n == k for _, n, _ in spans) for k in range(3)]
        assert set(filter(None, written.split(","))) <= set(r.spans.split(","))
    by = {r.doc_id: r for r in out}
    assert by[505].spans == "live:5:27" and all(by[600 + k].spans == "" for k in range(8))
    clean = {r.doc_id: r.text for r in secrets.redact(both, F.col("doc_id"), F.col("source")).collect()}
    assert clean[505] == "here [SECRET] ends" and own not in str(clean) and shared in clean[600]
    assert clean[502] == "[SECRET] é [SECRET]" and clean[500] == "[SECRET] [SECRET]' token=ab"
    assert secrets.scan(nothing, "doc_id", "source").count() == 0


def test_secret_ownership_against_brute_force(spark):
    r = random.Random(4)
    hexes = ["".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(12)]
    mixed = ["".join(r.choice("abcXYZ019") for _ in range(18)) + "aB9" for _ in range(8)]
    rows = []
    for k in range(300):
        parts = [r.choice(WORDS) for _ in range(20)]
        for _ in range(r.choice([0, 0, 1, 2])):
            v = r.choice(hexes[: r.choice([3, 12])] + mixed)
            parts.insert(r.randrange(20), r.choice([f'token = "{v}"', v, f"api_key:{v}"]))
        rows.append((k, " ".join(parts), r.choice([None, "a", "b", "c"]) if k % 2 else "a", r.choice("xyz"), [k], "clash", 1))
    rows += rows[:20]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string, repo string, spans array<int>, _row string, _text int").repartition(3)

    def values(text):  # (start, end, value) of base candidates, and of mixed tokens away from base spans
        base = [(m.start(), m.end(), m[1] if n == 0 else m[0]) for n, (_, p, ok) in enumerate(BASE) for m in p.finditer(text) if ok(m)]
        out = {(e - len(v), e, v) for _, e, v in base}
        for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
            if all(re.search(p, m[0]) for p in ("[0-9]", "[A-Z]", "[a-z]")) and not any(a < m.end() and m.start() < b for a, b, _ in base):
                out.add((m.start(), m.end(), m[0]))
        return out

    repos, owners = defaultdict(set), defaultdict(set)
    for row in rows:
        for _, _, v in values(row[1]):
            repos[v].add(row[3])
            owners[v].add(row[2])
    example = {v for v in repos if len(repos[v]) >= secrets.EXAMPLE_REPOS and len(owners[v]) >= secrets.EXAMPLE_OWNERS}
    want = Counter()
    for row in rows:
        live = {(a, 3, b) for a, b, v in values(row[1]) if v not in example}
        n_examples = sum(v in example for _, _, v in values(row[1]))
        want[row[0], ",".join(f"{(*(x[0] for x in BASE), 'live')[n]}:{a}:{b}" for a, n, b in sorted({*spans_of(row[1]), *live})), len(live), n_examples] += 1
    out = secrets.scan(frame, "repo", "source").collect()
    assert Counter((x.doc_id, x.spans, x.n_live, x.n_examples) for x in out) == want
    assert example and len(example) < len(repos)
    masked = secrets.redact(frame, F.col("repo"), F.col("source"))
    assert masked.columns == frame.columns
    for x in masked.collect():
        assert x.spans == [x.doc_id] and x._row == "clash" and x._text == 1
        assert {v for _, _, v in values(x.text)} <= example


def linked(texts):
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [find(k) for k in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("seed", range(2))
def test_jaccard_against_brute_force(spark, seed):
    r = random.Random(seed)
    texts = ["", " ", "a", "A", "a b", "one two three four", "One TWO three four", "a b c d e", "a b c d e f"]
    for base in range(25):
        words = [r.choice(WORDS) for _ in range(r.choice([3, 6, 9, 14, 25, 60, 150, 400]))]
        for _ in range(r.randint(1, 9)):
            copy = list(words)
            for _ in range(r.randint(0, 1 + len(words) // 40)):
                copy[r.randrange(len(copy))] = r.choice(WORDS)
            cut = r.randint(0, max(1, len(words) // 9))
            texts.append(" ".join(copy[cut:] if r.random() < 0.5 else copy))
    passage = " ".join(r.choice(WORDS) for _ in range(40))
    texts += [passage + " " + prose(r.randint(12, 60), 1000 + k) for k in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    out = {x.doc_id: x for x in jaccard.join(frame).collect()}
    want, sizes = linked(texts)
    assert [out[k].n_shingles for k in range(len(texts))] == sizes
    assert [out[k].component_id for k in range(len(texts))] == [w if s else k for k, (w, s) in enumerate(zip(want, sizes))]
    left = sorted(x.doc_id for x in jaccard.one_of_each(frame).collect())
    assert left == [k for k, (w, s) in enumerate(zip(want, sizes)) if w == k or not s]


@pytest.mark.parametrize("edits", [(1, 6), (2, 3)])
def test_jaccard_joins_near_copies_without_their_original(spark, edits):
    r = random.Random(11)
    original = [r.choice(WORDS) + str(k) for k in range(150)]
    texts = []
    for _ in range(260):
        copy = list(original)
        for _ in range(r.randint(*edits)):
            copy[r.randrange(150)] = r.choice(WORDS) + "x" + str(r.random())
        texts.append(" ".join(copy))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    out = {x.doc_id: x.component_id for x in jaccard.join(frame).collect()}
    want, _ = linked(texts)
    assert [out[k] for k in range(len(texts))] == want


def test_rarest_shingles_leave_few_pairs(spark):
    """Copies that were each changed too much to be linked meet nobody; those that were changed alike meet."""
    r = random.Random(12)
    original = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(400):
        copy = list(original)
        for at in r.sample(range(0, 150, 6), 5):
            copy[at] = f"x{k}_{at}"
        texts.append(" ".join(copy))
    texts += [texts[0] + " end", texts[0] + " other end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    described = jaccard.describe(rows, "doc_id", "text").selectExpr("id AS node", "*").drop("id").cache()
    found = jaccard._Verifier(rows, described.withColumn("id", F.col("node")), "doc_id", "text", 80, 5)
    found.fetch(described.select("node"))
    pairs = jaccard._rarest(described.selectExpr("node", "node AS component"), described, found.texts, 80, 5).collect()
    assert {(0, 400), (0, 401), (400, 401)} <= {tuple(sorted(p)) for p in pairs} and len(pairs) < 20


def test_jaccard_against_sql(spark):
    from tallowmere.llm.queries_joins import ORACLE, QUERIES

    (name,), sf = ORACLE, "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    found = con.execute(ORACLE[name])
    names = [d[0] for d in found.description]
    rows = QUERIES[name](spark, sf)
    assert sorted(names) == sorted(rows.columns)
    assert sorted(tuple(r) for r in rows.select(*names).collect()) == sorted(found.fetchall())


def test_jaccard_edges(spark, docs, nothing):
    out = jaccard.join(docs).collect()
    assert len(out) == docs.count() and jaccard.join(nothing).count() == 0
    assert {r.component_id for r in out if r.doc_id == 20} == {20}
    assert sum(r.doc_id == 20 for r in jaccard.one_of_each(docs).collect()) == 1


@pytest.mark.parametrize("n", [1, 4, 5, 9, 40, 300, 2000])
def test_signatures_meet_at_the_bound(n):
    bands, rng = jaccard.Bands(), np.random.default_rng(n)
    for _ in range(60):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        lost = int(len(a) * 0.2) if len(a) * 0.8 <= len(a) - int(len(a) * 0.2) else 0
        b = np.sort(rng.permutation(a)[lost:])
        both = len(b)
        if 100 * both >= 80 * len(a) and len(b) != len(a):
            assert set(bands.signatures(a)) & set(bands.signatures(b))


RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def test_urls(spark):
    rows = [(1, "http://Example.ORG/es/x?q#f", "block", "example.org/es/"), (2, "https://www.example.org/en/12", "block", "example.org/en/1"), (3, "https://a.example.org/en/2", "allow", "org/"), (4, "http://notexample.org/es/", "allow", "org/"), (5, "http://x.com/de/1", "block", "com/de/"), (6, "http://m.site.net/a.html?x=1", "block", None), (7, "http://site.net/a/", "block", None), (8, "http://site.net/b", "allow", None), (9, None, "allow", None), (10, "no scheme", "allow", None), (11, "http://org", "allow", None), (12, "http://site.net/a", "block", None)]
    pages = spark.createDataFrame([(i, u, "x") for i, u, _, _ in rows], "page_id bigint, url string, block string")
    listed = spark.createDataFrame([("site.net/a",), ("site.net/a",), (None,)] + [(f"other{k}.net/",) for k in range(500)], "key string")
    out = {r.page_id: r for r in urls.judge(pages, RULES, listed).collect()}
    assert {(i, out[i].verdict, out[i].rule) for i in out} == {(i, v, r) for i, _, v, r in rows}
    assert (out[1].host, out[1].path, out[9].host, out[11].path) == ("example.org", "/es/x", "", "")
    assert urls.judge(pages.limit(0), RULES, listed).count() == 0
    assert urls.judge(pages, RULES, listed.limit(0)).where("verdict = 'block'").count() == 3


def test_html(spark):
    page = """<html><head><title>t</title><script>var x="<p>no</p>"</script></head><body><header>Site</header><nav><ul><li>Home</li></ul></nav>
    <div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p>One  two<br>three &lt;3<p>Four <b>five</b>, six.<form>mail <input></form><div class="share">share</div>
    <ul><li>x</li><li>y</li></ul></article><section class="comments"><article class="comment"><p>nice comment that is very long indeed, much longer than all of the article put together, really, it is so long</p></article></section><aside>side</aside><footer>&copy; foot</footer></body></html>"""
    want = "A & B\nOne two three <3\nFour five, six.\nx\ny"
    assert html_text.text_of(page) == want
    assert html_text.text_of("<div><p>loose</p>tail") == "loose\ntail"
    rows = [(1, "http://a.org/1", page), (2, None, None), (3, "http://a.org/2", ""), (1, "http://a.org/1", page), (4, "x", "plain & text")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert Counter((r.page_id, r.text, r.n_chars) for r in out) == Counter([(1, want, len(want)), (1, want, len(want)), (2, "", 0), (3, "", 0), (4, "plain & text", 12)])


def test_site_style_tree_cuts_what_repeats(spark):
    body = lambda k: f"<body><div class='box'><p>Always the same words here</p></div><div class='story'><p>{prose(24, k)}</p></div></body>"
    rows = [(k, f"http://h.org/{k}", body(k)) for k in range(20)] + [(100, "http://other.org/", body(3))]
    out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all("Always" not in out[k] and out[k] == " ".join(prose(24, k).split()) for k in range(20))
    assert out[100].startswith("Always")
    same = [(k, f"http://h.org/{k}", f"<body><article><p>One text.</p></article>{k}</body>") for k in range(30)]
    assert {r.text for r in html_text.extract(spark.createDataFrame(same, "page_id bigint, url string, html string")).collect()} == {"One text."}


def test_html_small_hosts_plain_nodes_articles_and_depth(spark):
    story = lambda k: " ".join(prose(24, k).split())
    rows = [(k, f"http://two.org/{k}", f"<body><div class='box'><p>Always here</p></div><div class='story'><p>{story(k)}</p></div></body>") for k in range(2)]
    rows += [(10 + k, f"http://plain.org/{k}", f"<body><p>Always here<div class='story'><p>{story(k)}</p></div></body>") for k in range(12)]
    rows += [(30, "http://many.org/", "<article><p>Short one.</p></article><article><p>The longer one of the two.</p></article>")]
    rows += [(31, "http://deep.org/", "<b>" * 3000 + "deep" + "<div>" * 3000 + "deeper")]
    out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert all(out[k] == story(k % 10) for k in (0, 1)) and all(out[10 + k] == story(k) for k in range(12))
    assert out[30] == "Short one.\nThe longer one of the two." and out[31] == "deep\ndeeper"


def cut_by_plain_code(rows):
    """Texts of (host, html) rows by importance computed page by page."""
    pages = {(h, t): html_text.Page(t) for h, t in rows}
    nodes = defaultdict(list)
    for (h, _), p in pages.items():
        for key, row in p.nodes.items():
            nodes[h, key].append(row)

    def entropy(values):
        c, n = Counter(values), len(values)
        return -sum(x / n * np.log(x / n) for x in c.values()) / np.log(n) if n > 1 else 1.0

    low = {}
    for at, found in nodes.items():
        style, content = entropy([r[0] for r in found]), entropy([r[1] for r in found])
        weight = 0.9 ** (sum(r[3] for r in found) / len(found))
        importance, may = (1 - weight) * style + weight * content, min(r[2] for r in found)
        if may and (max(style, content) < 0.1 or (may == 2 and (max(style, content) < 0.2 or (importance < 0.5 and content < 0.97)))):
            low[at] = {c for c, k in Counter(r[1] for r in found).items() if k > 1}
    return [pages[h, t].text(frozenset(k for k, r in pages[h, t].nodes.items() if r[1] in low.get((h, k), ()))) for h, t in rows]


def test_style_tree_against_plain_code(spark):
    r = random.Random(6)
    menus = ["<div class='m'>" + "".join(f"<a><b>{r.choice(WORDS)}</b></a>" for _ in range(12)) + "</div>" for _ in range(3)]
    rows = []
    for k in range(60):
        parts = [r.choice(menus), f"<div class='x'>{r.choice(['Sport', 'News', r.choice(WORDS)])}</div>", "<p>Follow us" + r.choice(["", "", "!"])]
        parts += [f"<div class='t'><h2>{r.choice(WORDS)}</h2>" + "".join(f"<p>{prose(12, r.random())}</p>" for _ in range(r.randint(1, 4))) + "</div>"]
        r.shuffle(parts)
        rows.append((k, f"http://{r.choice('aab')}.org/{k}", "<body>" + "".join(parts) + "</body>"))
    rows += rows[:5]
    out = Counter((x.page_id, x.text) for x in html_text.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect())
    want = cut_by_plain_code([(u[7:12], h) for _, u, h in rows])
    assert out == Counter((row[0], t) for row, t in zip(rows, want))
    uncut = [html_text.text_of(h) for _, _, h in rows]
    assert sum(a != b for a, b in zip(want, uncut)) > 40  # menus go, which no name tells
    assert all(w in t for (_, _, h), t in zip(rows, want) for w in re.findall("<h2>(.*?)</h2>", h))


@pytest.mark.parametrize("html,want", [("<article><div class='post-header'><h1>T</h1></div><p>x</p></article>", "T\nx"), ("<div class='widget-content'><p>the story</p></div>", "the story"), ("<div class='site-header'>no</div><div class='ad-slot'>no</div><div id='cookie-notice'>no</div><p>yes</p>", "yes"), ("<p>a<td>b</td>c", "a\nb\nc"), ("a<script>x</script>b<span>c<div>d</div>e</span>f", "abc\nd\nef")])
def test_html_pages(html, want):
    assert html_text.text_of(html) == want


def test_deep_and_long_pages():
    n = 50_000
    assert html_text.text_of("<div>" * n + "deep" + "<b>" * n + "er" + "</i>" * n) == "deeper"
    assert html_text.text_of("<p>" + "<ul><li>x" * n) == "\n".join("x" * n)
    assert len(html_text.text_of("<p>word word</p>" * n)) == 10 * n - 1


def test_html_of_empty_tables_and_clashing_columns(spark):
    schema = "page_id bigint, url string, html string, text int, host int, page int, cut string"
    assert html_text.extract(spark.createDataFrame([], schema)).collect() == []
    out = html_text.extract(spark.createDataFrame([(None, None, "<p>a", 1, 2, 3, "x"), (None, None, "<p>a", 1, 2, 3, "x")], schema))
    assert [tuple(r) for r in out.collect()] == [(None, None, "a", 1)] * 2


def test_neighbours_are_exact(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    v[100:160] = v[0]
    v[7] *= 1000
    rows = [(k, [float(x) for x in v[k]]) for k in range(600)]
    odd = [(601, None), (620, [0.0] * 16), (640, [float("nan")] * 16), (660, [1.0, None] + [0.0] * 14), (680, [1.0]), (700, [float("inf")] * 16)]
    frame = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").repartition(5)
    out, blocks = defaultdict(list), defaultdict(list)
    for r in neighbours.search(frame, F.col("id") % 20 == 0, 10).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score))
    for r in neighbours.search(frame, F.col("id") % 20 == 0, 10, block_bytes=2000).orderBy("query_id", "rank").collect():
        blocks[r.query_id].append((r.vec_id, r.score))
    assert out == blocks
    s = np.zeros((600, 600))
    for j in range(16):
        s += v[:, None, j].astype(float) * v[None, :, j].astype(float)
    assert sorted(out) == list(range(0, 600, 20))
    for q, found in out.items():
        want = sorted((-s[q, k], k) for k in range(600) if k != q)[:10]
        assert [(k, -x) for x, k in want] == found
    assert neighbours.search(frame.limit(0), F.col("id") % 20 == 0, 10).count() == 0
    assert neighbours.search(frame.where("vec_id < 3"), F.col("id") % 20 == 0, 10).count() == 2


def test_toxicity_on_held_out_rows(spark):
    insults = ["zorgat", "blenkid", "mopfrag"]
    r, rows, labels = random.Random(5), [], []
    for k in range(600):
        toxic, words = k % 6 == 0, prose(80, k).split(" ")
        if toxic:
            for _ in range(4):
                words[r.randrange(len(words))] = r.choice(insults) + r.choice(["", "e", "ung", "."])
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    frame = spark.createDataFrame(rows + [(None, None), (900, "")], "doc_id bigint, text string")
    out = {x.doc_id: x for x in toxicity.judge(frame, spark.createDataFrame(labels + [(None, 1), (901, None)], "doc_id bigint, toxic int")).collect()}
    held = [k for k in range(600) if out[k].held_out]
    assert {k for k in held} == {k for k in range(600) if zlib.crc32(str(k).encode()) % 3 == 1}
    wrong = [k for k in held if out[k].predicted != int(k % 6 == 0)]
    assert len(wrong) <= 0.03 * len(held) and len(out) == 602 and all(0 <= x.score <= 1 for x in out.values())
    none = toxicity.judge(frame, spark.createDataFrame([], "doc_id bigint, toxic int")).collect()
    assert {x.score for x in none} == {0.0}


def test_pipeline_on_the_smallest_tables(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = jaccard.keep(stage(spark, docs, sf), name)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024
