"""Exact n-gram Jaccard join by parity sketches.

A document's distinct word shingles are dealt by hash into the parts of a sketch; each shingle XORs its hash
into its part. A shingle in which two sets differ changes at most one part, so the number of parts that
differ is at most the symmetric difference. For a similarity of t that is at most (1 - t) / (1 + t) of
both sizes together: a size band with one part more than that has an equal part in every linked pair.

1. Documents with the same set form a class; one of each goes on.
2. Each emits its first parts that aren't empty, one more than the bound for its size and its partners', in
   its size band and in the next if a larger partner may lie there. The shorter of two such prefixes holds
   more filled parts than can differ, so linked sets share one. A set that leaves too many parts empty
   emits all it has, and its empty parts too, to meet others of its kind.
3. Classes that share a part are candidates of one leader among them, not of each other: a group of copies
   gives a star. A bit sketch (each shingle flips one of 512 bits) drops candidates whose Hamming distance
   exceeds the bound, a sketch sized to the set drops more, and the rest is verified on whole texts.
4. Components of the verified links. Parts in which several components still meet take a new leader, in
   rounds, as long as a round links at least a tenth of the classes that are left there.
5. Classes of different components that are still left in a common part are compared where they share one of
   their rarest shingles, which linked sets must, and so no link between components is lost. What counts as rare
   is told by a part of these classes; it decides which pairs meet, not which of them link.

A round costs a part one pair for each member, however many copies there are. In step 5 a class meets others
only by shingles that are rare among those left; copies that were changed too much to be linked have enough
shingles of their own to meet nobody.

Verification reads the texts of candidates alone, compressed, once. What a part's bucket holds is grouped and
joined, never gathered, and its joins may be split by adaptive execution.

Null and empty texts, and texts without words, have an empty set and link with nothing. Repeated rows are of
one class. Rows without an id belong to their class, and its number is the smallest id in its component, null
if there is none. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowmere.llm.common import bounded, discard, keep, text_or_empty
from tallowmere.llm.graph import merged
from tallowmere.llm.shingles import mix, shingle_set

WIDTH, PERCENT = 5, 80
BITS = 512
#: Ids of candidates up to this many are broadcast to pick their texts; beyond, texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000
BAND_RATIO = 2
#: One node in so many is counted for the order of shingles in the last step, and so many shingles are told apart by it.
ORDER_EVERY, ORDER_MOST = 8, 1_000_000


class Bands:
    """Size bands of sets for links of at least `percent` similarity, with their parts."""

    def __init__(self, percent: int = PERCENT):
        self.percent, self.edges, self.plans = percent, [1], {}
        self.share = (100 - percent) / (100 + percent)

    def band(self, n: int) -> int:
        while self.edges[-1] <= n:
            self.edges.append(max(self.edges[-1] + 1, math.ceil(self.edges[-1] * BAND_RATIO)))
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def most(self, n: int, band: int) -> int:
        """How many shingles a set of `n` and a linked one that isn't smaller, or lies in the same band, may differ in."""
        return math.floor((n + min(n * 100 // self.percent, self.edges[band + 1] - 1)) * self.share + 1e-9)

    def parts(self, band: int) -> int:
        """Parts of a band: as many as its largest sets must fill, and some that stay empty."""
        if band not in self.plans:
            high = self.edges[band + 1] - 1
            filled = self.most(high, band) + 1
            empty = filled * math.exp(-high / filled)
            self.plans[band] = filled + math.ceil(empty + 6 * math.sqrt(empty))
        return self.plans[band]

    def of(self, n: int) -> range:
        """The bands in which a set of `n` may be linked: its own, and those where a linked larger set may lie."""
        return range(self.band(n), self.band(n * 100 // self.percent) + 1)

    def signatures(self, members: np.ndarray) -> np.ndarray:
        """A 64-bit number for each part that the set emits; equal parts of a band have equal numbers."""
        n, out = len(members), []
        for band in self.of(n):
            most = self.most(n, band)
            if not most:  # only equal sets are that similar
                continue
            parts = self.parts(band)
            part = ((members >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, value = part[order], mix(members[order] + np.uint64(1))
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            filled, folded = part[starts], np.bitwise_xor.reduceat(value, starts)
            if len(filled) > most:
                filled, folded = filled[: most + 1], folded[: most + 1]
            else:
                empty = np.setdiff1d(np.arange(parts), filled)
                filled, folded = np.r_[filled, empty], np.r_[folded, np.zeros(len(empty), np.uint64)]
            out.append(mix(folded + mix(filled.astype(np.uint64) + np.uint64(band << 32))))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bit_sketch(members: np.ndarray) -> np.ndarray:
    """Parities of the shingles of each of `BITS` bits, as 64-bit words."""
    odd = np.bincount((members % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_sketch(members: np.ndarray) -> bytes:
    """Parities of the shingles of as many bits, a power of two, as the set has members or up to twice that."""
    bits = 1 << max(9, len(members).bit_length())
    odd = np.bincount((members % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Hamming distance of two wide sketches, the longer one's halves folded onto each other first."""
    a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.unpackbits(a ^ b).sum())


KEY = ["n_shingles", "x", "y"]
SKETCH = [f"k{j}" for j in range(BITS // 64)]


def _key(members: np.ndarray) -> tuple[int, int, int]:
    """Size and two 64-bit sums: equal sets have equal keys, and different ones don't, but by chance of 2 to the -128."""
    return len(members), int(np.bitwise_xor.reduce(members).view(np.int64)), int(mix(members + np.uint64(7)).sum(dtype=np.uint64).view(np.int64)) if len(members) else 0


def describe(docs: DataFrame, id_col: str, text_col: str, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """Every row's id, the key of its set, its bit sketch and, for the first of equal sets in a task, its signatures."""

    def run(batches):
        bands, seen = Bands(percent), set()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                keys, sketches, signatures = [], [], []
                for text in part.column("text").to_pylist():
                    members = shingle_set(text, width)
                    keys.append(_key(members) if len(members) else (0, 0, 0))
                    sketches.append(bit_sketch(members))
                    first = len(members) and keys[-1] not in seen
                    signatures.append(bands.signatures(members).view(np.int64) if first else np.zeros(0, np.int64))
                    seen.add(keys[-1])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(s) for s in signatures])], pa.int32()), pa.array(np.concatenate(signatures)))
                words = np.stack(sketches)
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array(c, pa.int64()) for c in zip(*keys)), *(pa.array(words[:, j]) for j in range(words.shape[1])), lists], ["id", *KEY, *SKETCH, "signatures"])

    kind = docs.schema[id_col].dataType.simpleString()
    columns = ", ".join(f"{c} long" for c in [*KEY, *SKETCH])
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"id {kind}, {columns}, signatures array<long>")


def _texts(docs: DataFrame, nodes: DataFrame, asked: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(node, n_shingles, wide sketch, packed text) of the `asked` nodes, written once: read from the documents that bear the nodes' ids."""
    nodes = keep(nodes.join(asked, "node", "left_semi").select("node", "id", *KEY), "asked")

    def pack(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = part.column("text").to_pylist()
                sets = [shingle_set(t, width) for t in texts]
                keys = [_key(s) if len(s) else (0, 0, 0) for s in sets]
                packed = [zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in texts]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*keys)), pa.array([wide_sketch(s) for s in sets], pa.binary()), pa.array(packed, pa.binary())], [*KEY, "wide", "packed"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    asked = bounded(nodes.select(F.col("id").alias("_id")), BROADCAST_IDS)
    some = rows.join(asked, rows["id"].eqNullSafe(asked["_id"]), "left_semi").select("text")
    packed = some.mapInArrow(pack, ", ".join(f"{c} long" for c in KEY) + ", wide binary, packed binary")
    once = packed.groupBy(*KEY).agg(F.first("wide").alias("wide"), F.first("packed").alias("packed"))
    return keep(once.join(nodes.select("node", *KEY), KEY).select("node", "n_shingles", "wide", "packed"), "texts")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) of nodes whose similarity is `percent` or more.

    Wide sketches, far smaller than texts, go first: their distance is at most the symmetric difference.
    """

    def near(batches):
        for b in batches:
            a_, b_, sizes = b.column("a"), b.column("b"), zip(b.column("n_a").to_pylist(), b.column("n_b").to_pylist())
            fits = [(100 + percent) * differing(x, y) <= (100 - percent) * (n + m) for x, y, (n, m) in zip(b.column("wide_a").to_pylist(), b.column("wide_b").to_pylist(), sizes)]
            mask = pa.array(fits, pa.bool_())
            yield pa.RecordBatch.from_arrays([a_.filter(mask), b_.filter(mask)], ["a", "b"])

    def check(batches):
        last: tuple = (None, None)
        for b in batches:
            keep_, a_, b_ = [], b.column("a").to_pylist(), b.column("b").to_pylist()
            for k, (packed_a, packed_b) in enumerate(zip(b.column("packed_a").to_pylist(), b.column("packed_b").to_pylist())):
                if last[0] != a_[k]:
                    last = (a_[k], shingle_set(zlib.decompress(packed_a).decode("utf-8", "surrogatepass"), width))
                other = shingle_set(zlib.decompress(packed_b).decode("utf-8", "surrogatepass"), width)
                both = len(np.intersect1d(last[1], other, assume_unique=True))
                if 100 * both >= percent * (len(last[1]) + len(other) - both):
                    keep_.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([a_[k] for k in keep_], pa.int64()), pa.array([b_[k] for k in keep_], pa.int64())], ["a", "b"])

    sketches = [texts.select(F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("wide").alias(f"wide_{c}")) for c in "ab"]
    pairs = keep(pairs.join(sketches[1], "b").join(sketches[0], "a").select("a", "b", "n_a", "n_b", "wide_a", "wide_b").mapInArrow(near, "a long, b long"), "near")
    if pairs.isEmpty():
        return pairs
    asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = texts.join(bounded(asked, BROADCAST_IDS), "node", "left_semi")  # only these are shuffled
    left = texts.select(F.col("node").alias("a"), F.col("packed").alias("packed_a"))
    right = texts.select(F.col("node").alias("b"), F.col("packed").alias("packed_b"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "packed_a", "packed_b").mapInArrow(check, "a long, b long")


def _near(a: str, b: str, percent: int) -> F.Column:
    """Whether two rows' sizes and bit sketches allow a link."""
    sizes = f"100 * least({a}.n_shingles, {b}.n_shingles) >= {percent} * greatest({a}.n_shingles, {b}.n_shingles)"
    hamming = " + ".join(f"bit_count({a}.{k} ^ {b}.{k})" for k in SKETCH)
    return F.expr(f"{sizes} AND {100 + percent} * ({hamming}) <= {100 - percent} * ({a}.n_shingles + {b}.n_shingles)")


def _parts_shared(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(signature, node, weight) of the parts that several classes emit; weight: how many its node meets in all."""
    full = rows.where("size(signatures) > 0")
    # A class emits once a task at most; its first row always does, so that row stands for the others.
    others = keep(full.select("row").join(nodes.select(F.col("node").alias("row")), "row", "left_anti"), "others")
    emitted = full.join(bounded(others, BROADCAST_IDS), "row", "left_anti").select(F.explode("signatures").alias("signature"), F.col("row").alias("node"))
    # Shuffled once, for the counts and for what joins them: both read the same columns, or Spark would shuffle each apart.
    emitted = emitted.repartition("signature")
    several = emitted.groupBy("signature").agg(F.count("node").alias("size")).where("size > 1")
    members = keep(emitted.join(several.hint("shuffle_hash"), "signature"), "members")
    shared = keep(members.drop("size").join(members.groupBy("node").agg(F.sum("size").alias("weight")), "node"), "shared")
    discard(others, members)
    return shared


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members (signature, node, weight), with their components, of parts in which several components meet."""
    placed = members.join(labels, "node", "left").select("signature", "node", "weight", F.coalesce("component", "node").alias("component"))
    apart = keep(placed.groupBy("signature").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("signature"), "apart")
    out = keep(placed.join(apart, "signature"), "mixed")
    discard(apart)
    return out


class _Verifier:
    """Links found so far, as components, and the packed texts of the classes that pairs were made of."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, percent: int, width: int):
        self.docs, self.nodes, self.columns, self.percent, self.width = docs, nodes, (id_col, text_col), percent, width
        self.texts: DataFrame | None = None
        self.packed: list[DataFrame] = []
        self.labels = docs.sparkSession.createDataFrame([], "node long, component long")

    def fetch(self, asked: DataFrame) -> None:
        """Packs the texts of the `asked` nodes (node), as far as that isn't done."""
        if self.texts is not None:
            asked = keep(asked.join(self.texts.select("node"), "node", "left_anti"), "missing")
            if asked.isEmpty():
                return
        more = _texts(self.docs, self.nodes, asked, *self.columns, self.width)
        self.packed.append(more)
        self.texts = more if self.texts is None else self.texts.unionByName(more)

    def apart(self, pairs: DataFrame) -> DataFrame:
        ends = pairs.join(self.labels.toDF("a", "ca"), "a", "left").join(self.labels.toDF("b", "cb"), "b", "left")
        return ends.where("coalesce(ca, a) <> coalesce(cb, b)").select(*pairs.columns)

    def verify(self, pairs: DataFrame) -> int:
        """How many of the pairs (a, b) link; their components are joined."""
        links = keep(_verified(pairs, self.texts, self.percent, self.width), "links")
        n = links.count()
        if n:
            self.labels = merged(self.labels, links)
        discard(links)
        return n

    def lead(self, led: DataFrame) -> int:
        """Verifies (a: leader, b: node, parts): with the leader that shares most parts first, with others where that leaves nodes apart."""
        if led.isEmpty():
            return 0
        best = led.groupBy("b").agg(F.max_by("a", F.struct("parts", -F.col("a"))).alias("a"))
        n = self.verify(best.select("a", "b"))
        rest = keep(self.apart(led.select("a", "b").join(best, ["a", "b"], "left_anti")), "rest")
        n += 0 if rest.isEmpty() else self.verify(rest)
        discard(rest)
        return n


def _led(members: DataFrame, nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(signature, leader) of every part, and the distinct pairs (a: leader, b: node, parts) of different components that may link.

    The leader is the member that meets most others: in a group of copies one that is close to what they were copied from.
    """
    leaders = keep(members.groupBy("signature").agg(F.max_by(F.struct(F.col("node").alias("leader"), F.col("component").alias("of")), F.struct("weight", -F.col("node"))).alias("l")).select("signature", "l.*"), "leaders")
    pairs = members.join(leaders, "signature").where("component <> of").groupBy("node", "leader").agg(F.count("*").alias("parts"))
    a, b = nodes.alias("a"), nodes.alias("b")
    pairs = pairs.alias("p").join(a, F.col("p.leader") == F.col("a.node")).join(b, F.col("p.node") == F.col("b.node")).where(_near("a", "b", percent))
    return leaders, keep(pairs.select(F.col("p.leader").alias("a"), F.col("p.node").alias("b"), "parts"), "led")


def _frequent(texts: DataFrame, width: int, every: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, `most` at most, of one node in `every`, sorted, and their counts there: an order to go by, no more."""

    def sets(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                found = [shingle_set(zlib.decompress(t).decode("utf-8", "surrogatepass"), width).view(np.int64) for t in b.slice(at, 512).column("packed").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["e"])

    some = texts.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).select("packed").mapInArrow(sets, "e long")
    counts = keep(some.groupBy("e").agg(F.count("*").alias("c")).where("c > 1"), "frequent")
    least, held = 2, 0
    for r in counts.groupBy("c").agg(F.count("*").alias("n")).orderBy(F.desc("c")).toLocalIterator():
        held += r.n
        if held > most:
            least = r.c + 1
            break
    rows = counts.where(F.col("c") >= least).orderBy("e").toArrow()
    discard(counts)
    return rows.column("e").to_numpy(), rows.column("c").to_numpy()


def _rarest(mixed: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs of different components among the nodes of `mixed` that share one of their rarest shingles and may link.

    Linked sets of n shingles and of a size that allows it share at least percent / 100 * n of the larger one, so with
    all shingles in one order, the same for all, they have one in common among the first n - ceil(percent / 100 * n) + 1
    of each. Of sets of n and m that is so among the first n - o + 1 and m - o + 1, where o is the least they
    share, which their places tell. The order, rare ones first, comes from counts in a part of the nodes; any
    order would do, this one has sets meet by shingles that few have. Copies that were each changed much have
    enough shingles of their own to meet nobody.
    """
    asked = mixed.select("node", "component").distinct()
    held = keep(texts.select("node", "n_shingles", "packed").join(asked, "node"), "held")
    shared = held.sparkSession.sparkContext.broadcast(_frequent(held, width, ORDER_EVERY, ORDER_MOST))

    def first(batches):
        known, counts = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part, lists = b.slice(at, 512), []
                for t in part.column("packed").to_pylist():
                    found = shingle_set(zlib.decompress(t).decode("utf-8", "surrogatepass"), width).view(np.int64)
                    place = np.minimum(np.searchsorted(known, found), max(0, len(known) - 1))
                    rank = np.where(known[place] == found, counts[place], 0) if len(known) else np.zeros(len(found), np.int64)
                    lists.append(found[np.lexsort((found, rank))[: len(found) - -(-percent * len(found) // 100) + 1]])
                sizes = [len(x) for x in lists]
                repeated = [pa.array(np.repeat(part.column(c).to_numpy(), sizes)) for c in ("node", "n_shingles", "component")]
                places = pa.array(np.concatenate([np.zeros(0, np.int64), *[np.arange(n) for n in sizes]]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *lists])), places, *repeated], ["e", "place", "node", "n_shingles", "component"])

    rows = held.mapInArrow(first, "e long, place long, node long, n_shingles long, component long")
    a, b = rows.alias("a"), rows.alias("b")
    sizes = f"100 * least(a.n_shingles, b.n_shingles) >= {percent} * greatest(a.n_shingles, b.n_shingles)"
    most = f"({percent} * (a.n_shingles + b.n_shingles) + {99 + percent}) div {100 + percent}"
    places = f"a.place <= a.n_shingles - {most} AND b.place <= b.n_shingles - {most}"
    met = a.join(b, (F.col("a.e") == F.col("b.e")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component")) & F.expr(f"{sizes} AND {places}"))
    met = keep(met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), "met")
    a, b = nodes.alias("x"), nodes.alias("y")
    near = met.join(a, F.col("a") == F.col("x.node")).join(b, F.col("b") == F.col("y.node")).where(_near("x", "y", percent))
    out = keep(near.select("a", "b"), "pairs")
    discard(held, met)
    return out


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """id_col, n_shingles, component_id and class_id (smallest id of the same set) of every row."""
    rows = keep(describe(docs, id_col, text_col, percent, width).withColumn("row", F.monotonically_increasing_id()), "sketches")
    nodes = rows.where("n_shingles > 0").groupBy(*KEY).agg(F.min("row").alias("node"), F.min("id").alias("id"), *[F.first(k).alias(k) for k in SKETCH])
    nodes = keep(nodes, "classes")
    shared = _parts_shared(rows, nodes)
    keys = keep(rows.select("id", *KEY), "keys")
    discard(rows)  # and with it the signatures
    mixed = shared.withColumn("component", F.col("node"))
    found = _Verifier(docs, nodes, id_col, text_col, percent, width)
    turn, ended = 0, False
    while not ended:
        leaders, led = _led(mixed, nodes, percent)
        found.fetch((led.select(F.col("a").alias("node")).union(led.select("b")) if turn == 0 else mixed.select("node")).distinct())
        linked = found.lead(led)
        # A leader has now met all others of its part, so only those meet again, where components differ.
        open_ = mixed.join(leaders.select("signature", F.col("leader").alias("node")), ["signature", "node"], "left_anti").drop("component")
        again = _mixed(open_, found.labels)
        discard(leaders, led, shared)
        met = again.select("node").distinct().count()
        # Rounds go on while each takes a good part of the nodes that are still apart; the rest is left to the rarest shingles.
        ended = not met or (turn > 0 and 10 * linked < met)
        mixed, shared, turn = again, again, turn + 1
    if met:
        found.fetch(mixed.select("node").distinct())
        pairs = _rarest(mixed, nodes, found.texts, percent, width)
        if not pairs.isEmpty():
            found.verify(pairs)
        discard(pairs)
    discard(shared, *found.packed)

    placed = nodes.select(*KEY, "node", "id").join(found.labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = keep(placed.groupBy("component").agg(F.min("id").alias("component_id")), "smallest")
    placed = placed.join(smallest, "component").select(*KEY, F.col("id").alias("class_id"), "component_id")
    out = keys.join(placed, KEY, "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("class_id")).alias("class_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """The rows of `docs` without those of a component that don't bear its number: one document of each group.

    Empty texts stay, and so do rows without an id. Of rows that repeat an id of one class, one stays.
    """
    rows = keep(join(docs, id_col, text_col, percent, width).where(F.col(id_col).isNotNull() & (F.col("n_shingles") > 0)), "components")
    gone = rows.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    left = docs.join(bounded(gone, BROADCAST_IDS), id_col, "left_anti")
    repeated = keep(rows.where(F.col(id_col) == F.col("component_id")).groupBy(id_col).count().where("count > 1").select(id_col), "repeated")
    if repeated.isEmpty():
        return left.select(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = bounded(repeated, BROADCAST_IDS)
    once = left.join(repeated, id_col, "left_semi").dropDuplicates([id_col])
    return left.join(repeated, id_col, "left_anti").unionByName(once).select(*[F.col(f"`{c}`") for c in docs.columns])
