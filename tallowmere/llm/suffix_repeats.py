"""Bytes covered by strings of `length` bytes that occur twice, found by suffix arrays of text around shared anchors.

1. Equal texts are one text, written once, bucketed by their hash, so that what later joins them is moved and
   they aren't. A text of several rows repeats as a whole.
2. Every window of `length` bytes has an anchor: of its `GRAM`-byte strings the one with the least hash, the first
   among equal ones. Equal windows have equal anchors at equal offsets. The windows of one anchor follow each
   other; their region is the text that they cover. Anchors whose string no other anchor has are left out, counted
   by partial sums.
3. Regions that are equal, byte for byte by their 128-bit hash, are all repeated. One of each goes on, where an anchor
   has several: all regions of an anchor meet in one task, which sorts the suffixes of a few million bytes of such
   regions at a time (see `suffix_sort`) and finds repeated windows where neighbours share `length` bytes.
4. An anchor with more than `MOST` different regions (the edge of a passage that very many texts hold) isn't sorted
   in one task: its regions are cut into runs of `FINER` windows each, keyed by what all windows of a run share, and go
   through the same steps again, at last window by window, where equal ones are one. Nothing is dropped.
5. The windows found are joined to their texts, and their bytes cut out.

A null text is empty. Texts under `length` bytes keep all. Repeated rows, and rows of one id with equal texts, are
copies of each other: all their bytes go. Rows without an id are judged alike. Windows may overlap, also
within a text of one letter. An empty table gives an empty table, further columns are ignored. Long texts are
cut into slices of `SLICE` bytes that overlap by a window. What remains are bytes: a cut may fall within a character.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowmere.llm.common import bounded, discard, keep, shared_dir, text_or_empty
from tallowmere.llm.shingles import mix
from tallowmere.llm.suffix_sort import END, common_prefixes, suffix_array, words

LENGTH, GRAM = 200, 24
#: Different regions of one anchor that one task sorts together (some 3 MB), and the windows of a run beyond that.
MOST, FINER = 8192, 16
#: Bytes of text that are hashed at a time, and bytes of regions that are sorted at a time.
SLICE, SORTED = 1 << 19, 1 << 20
#: Anchors' strings up to this many are broadcast; beyond, anchors meet them by a shuffle.
BROADCAST_KEYS = 4_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_PLACE = np.uint64((1 << 20) - 1)
CUT = "id binary, at int, n int, anchor int, key long, digest binary"


class Powers:
    """Powers of an odd base modulo 2^64, and of its inverse, as far as they were asked for."""

    def __init__(self):
        self.inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            ones = np.ones(n, np.uint64)
            ones[1:] = _BASE
            self.up = np.multiply.accumulate(ones)
            ones[1:] = self.inverse
            self.down = np.multiply.accumulate(ones)
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes from each place on."""
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:-1])])
    return mix((sums[gram:] - sums[:-gram]) * down[: len(data) - gram + 1])


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: the first window, their number, the anchor's place from there, its hash."""
    hashes, width = gram_hashes(data, gram), length - gram + 1
    least, step = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: step - width], least[width - step :])
    place = (least & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return first, np.diff(np.append(first, len(place))), place[first] - first, hashes[place[first]].view(np.int64)


def _digest(b: bytes) -> bytes:
    return hashlib.blake2b(b, digest_size=16).digest()


def _cut_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
    columns = zip(*rows) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "at", "n", "anchor", "key", "digest"])


def regions(texts: DataFrame, length: int, gram: int, slice_bytes: int) -> DataFrame:
    """The regions of all texts (id, body): where their windows begin, how many, the anchor's offset and key, the region's hash."""

    def cut(batches):
        for b in batches:
            rows = []
            for id_, body in zip(b.column("id").to_pylist(), b.column("body")):
                body = body.as_buffer()
                data = np.frombuffer(body, np.uint8)
                for start in range(0, max(1, len(data) - length + 1), slice_bytes):
                    part = data[start : start + slice_bytes + length - 1]
                    raw = part.tobytes()
                    for at, n, anchor, key in zip(*(x.tolist() for x in anchors(part, length, gram))):
                        rows.append((id_, start + at, n, anchor, key, _digest(raw[at : at + n + length - 1])))
                if len(rows) > 50_000:
                    yield _cut_batch(rows)
                    rows = []
            yield _cut_batch(rows)

    return texts.select("id", "body").mapInArrow(cut, CUT)


def runs(bodies: DataFrame, length: int, finer: int) -> DataFrame:
    """Regions (id, at, n, anchor, body) cut into runs of up to `finer` windows, at the same offsets from the anchor."""

    def cut(batches):
        for b in batches:
            rows = []
            for r in b.to_pylist():
                body, anchor, n = r["body"], r["anchor"], r["n"]
                for k in range((anchor - n + 1) // finer, anchor // finer + 1):
                    whole = anchor - finer * k - finer + 1  # the run's first window, if the region had it
                    first, last = max(0, whole), min(n - 1, anchor - finer * k)
                    core = body[anchor - finer * k : whole + length]
                    key = int.from_bytes(_digest(core)[:8], "little", signed=True)
                    rows.append((r["id"], r["at"] + first, last - first + 1, anchor - first, key, _digest(body[first : last + length])))
            yield _cut_batch(rows)

    return bodies.select("id", "at", "n", "anchor", "body").mapInArrow(cut, CUT)


def repeated_windows(bodies: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each body, which of its first `count` windows another one of them equals, by the suffix array of all."""
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bodies])]).astype(np.int64)
    data = np.frombuffer(b"".join(bodies) + END, np.uint8)
    wanted = np.zeros(len(data), np.int8)
    np.add.at(wanted, starts[:-1], 1)
    np.add.at(wanted, starts[:-1] + np.array(counts), -1)
    wanted = np.cumsum(wanted, dtype=np.int8) > 0
    ahead = words(data)
    order = suffix_array(data, wanted, ahead, length)
    meets = common_prefixes(order, ahead, length) >= length
    meets[:-1] |= meets[1:]
    found = np.zeros(len(data), bool)
    found[order[meets]] = True
    return [found[s : s + n] for s, n in zip(starts, counts)]


def _stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of each run of true flags."""
    edges = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edges == 1).tolist(), (np.flatnonzero(edges == -1) - 1).tolist()))


def sorted_spans(bodies: DataFrame, length: int, sorted_bytes: int) -> DataFrame:
    """Spans (id, start, stop) of repeated windows in regions (key, id, at, n, copies, body); of those with copies, none."""

    def sort(batches):
        held, size = [], 0
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, [pa.binary(), pa.int32(), pa.int32()])], ["id", "start", "stop"])

        def done(rows):
            flags = repeated_windows([r["body"] for r in rows], [r["n"] for r in rows], length) if rows else []
            return out([(r["id"], r["at"] + a, r["at"] + b + length) for r, f in zip(rows, flags) if r["copies"] == 1 for a, b in _stretches(f)])

        for batch in batches:
            for r in batch.to_pylist():
                if size > sorted_bytes and r["key"] != held[-1]["key"]:
                    yield done(held)
                    held, size = [], 0
                held.append(r)
                size += len(r["body"])
        yield done(held)

    one = bodies.repartition("key").sortWithinPartitions("key")
    return one.mapInArrow(sort, "id binary, start int, stop int")


class Texts:
    """Different texts of `length` bytes or more (id, whole, copies, body), bucketed by id in the shared folder."""

    def __init__(self, docs: DataFrame, length: int):
        self.spark = docs.sparkSession
        self.name = f"tallowmere_texts_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        one = docs.where(F.octet_length("body") >= length).groupBy("id").agg(F.first("whole").alias("whole"), F.count("*").alias("copies"), F.first("body").alias("body"))
        one.write.bucketBy(buckets, "id").option("path", f"{shared_dir(self.spark)}/{self.name}").saveAsTable(self.name)
        self.df = self.spark.table(self.name)
        self.df._kept_at = f"{shared_dir(self.spark)}/{self.name}"

    def with_bodies(self, rows: DataFrame, length: int) -> DataFrame:
        """Regions with their text. `rows` are moved to the texts, which stay in their buckets."""
        met = self.df.select("id", F.col("body").alias("_body")).join(rows.hint("shuffle_hash"), "id")
        return met.select(*rows.columns, F.substring("_body", F.col("at") + 1, F.col("n") + (length - 1)).alias("body"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        discard(self.df)


def repeats(texts: Texts, length: int = LENGTH, gram: int = GRAM, most: int = MOST, slice_bytes: int = SLICE, sorted_bytes: int = SORTED, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """Spans (id, start, stop) of all windows that start elsewhere too, in a text or between texts; kept tables underneath."""
    cut, found, used = regions(texts.df, length, gram, slice_bytes), [], []
    for finer in (FINER, 1, None):
        again = cut.groupBy("key").count().where("count > 1").select("key")
        at_hand = keep(cut.join(bounded(again, broadcast_keys), "key", "left_semi"), "regions")
        by = at_hand.groupBy("key", "digest").agg(F.count("*").alias("copies"), F.min(F.struct("id", "at", "n", "anchor")).alias("r"))
        by = keep(by, "different")
        used += [at_hand, by]
        found.append(at_hand.join(by.where("copies > 1").select("key", "digest"), ["key", "digest"], "left_semi").select("id", F.col("at").alias("start"), (F.col("at") + F.col("n") + (length - 1)).alias("stop")))
        several = by.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
        mixed = by.join(several, "key").select("key", "copies", "many", "r.*")
        spans = keep(sorted_spans(texts.with_bodies(mixed.where(F.col("many") <= most).drop("many", "anchor"), length), length, sorted_bytes), "spans")
        found.append(spans)
        wide = mixed.where(F.col("many") > most)
        if finer is None or wide.isEmpty():
            break
        cut = runs(texts.with_bodies(wide.select("id", "at", "n", "anchor"), length), length, finer)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    out._kept = used
    return out


def joined(spans: list) -> list[list[int]]:
    """Spans in order, those that overlap or touch made one."""
    out = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return out


def kept_bytes(body: bytes, spans: list[list[int]]) -> bytes:
    """`body` without the spans."""
    edges = [0, *(x for s in spans for x in s), len(body)]
    return b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _cut_out(batches):
    for b in batches:
        rows = []
        for id_, body, spans in zip(*(b.column(c).to_pylist() for c in ("id", "body", "spans"))):
            spans = joined([(s["start"], s["stop"]) for s in spans])
            rows.append((id_, sum(y - x for x, y in spans), [{"start": x, "stop": y} for x, y in spans], hashlib.sha256(kept_bytes(body, spans)).hexdigest()))
        columns = zip(*rows) if rows else [[]] * 4
        kinds = [pa.binary(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "n_removed", "spans", "kept_sha256"])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **options) -> DataFrame:
    """`id_col`, n_bytes, n_removed, n_spans, kept_sha256 of every row, and the removed `spans` (start, stop) in bytes."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.encode(text_or_empty(f"`{text_col}`"), "UTF-8").alias("body"))
    whole = F.sha2("body", 256)
    rows = rows.select("doc", F.substring(F.unhex(whole), 1, 16).alias("id"), whole.alias("whole"), F.octet_length("body").cast("long").alias("n_bytes"), "body")
    texts = Texts(rows, length)
    found = repeats(texts, length, **options)
    by_text = found.groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    several = texts.df.where("copies > 1")
    single = texts.df.where("copies = 1").select("id", "body").join(by_text.hint("shuffle_hash"), "id").mapInArrow(_cut_out, "id binary, n_removed long, spans array<struct<start:long,stop:long>>, kept_sha256 string")
    size = F.octet_length("body").cast("long")
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("stop")))
    effects = keep(single.unionByName(several.select("id", size.alias("n_removed"), all_of.alias("spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"))), "repeats")
    discard(*found._kept)
    texts.drop()
    out = rows.select("doc", "id", "whole", "n_bytes").join(effects, "id", "left")
    return out.select(F.col("doc").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), F.coalesce("spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("spans"))
