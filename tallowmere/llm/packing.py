"""Best-fit packing of tokenised documents, improved by a swap-based local search.

Documents become pieces of at most `capacity` tokens where they are read. The pieces, without their ids,
are written once to the shared folder and dealt at random (by a seed) into shards of about `shard_pieces`;
a shard is packed in one task by best fit, longest first, and then searched: between any two underfull bins
one or two pieces move, or are exchanged for one, whenever that increases the sum of squared fills, until
there are as few bins as the pieces' sum needs or nothing more helps. A shard's last bins are all that sharding can cost: less than one
sequence in some ten thousand. Shards have a bounded size at any scale and no key decides where a row goes.

Nulls are empty texts and give one piece that holds the end id alone. Repeated rows are packed each on
their own. An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallowmere.llm.bpe_words import TextEncoder
from tallowmere.llm.common import keep, text_or_empty

SHARD_PIECES = 20_000


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> TextEncoder:
    return TextEncoder(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of `n` ids: whole ones of `capacity`, after a shorter first one if need be."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids as an array."""

    def encoded(batches):
        encoder = _encoder(tokenizer_path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows: list = []
                keys, texts = b.column("id").slice(at, 256).to_pylist(), b.column("text").slice(at, 256).to_pylist()
                for key, text in zip(keys, texts):
                    ids = np.array([*encoder.ids(text), end_id], "<u4")
                    for k, (s, n) in enumerate(cut(len(ids), capacity)):
                        rows.append((key, k, s, n, zlib.crc32(ids[s : s + n].tobytes()), *([ids[s : s + n].tolist()] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    schema = docs.select(F.col(id_col).alias("doc_id")).schema
    types = [pa.int64() if schema[0].dataType.simpleString() == "bigint" else pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
    key = F.col(id_col) if schema[0].dataType.simpleString() == "bigint" else F.col(id_col).cast("string")
    out = f"doc_id {'bigint' if types[0] == pa.int64() else 'string'}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(key.alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(encoded, out)


def best_fit(lengths: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """Bins (lists of indices) and their free places, by best fit over lengths that don't increase."""
    bins: list[list[int]] = []
    free: list[int] = []
    by_free: dict[int, list[int]] = defaultdict(list)
    present = 0  # bit f: a bin has f free places
    for k, n in enumerate(lengths):
        fits = present >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            j = by_free[f].pop()
            if not by_free[f]:
                present &= ~(1 << f)
            bins[j].append(k)
        else:
            f, j = capacity, len(bins)
            bins.append([k])
            free.append(capacity)
        free[j] = f - n
        if free[j]:
            by_free[free[j]].append(j)
            present |= 1 << free[j]
    return bins, free


def _takes(items: list[int], lengths: list[int]) -> dict[int, list[int]]:
    """What can be taken from a bin: one item or two of each sum."""
    by = defaultdict(list)
    for k in items:
        by[lengths[k]].append(k)
    ones = list(by)  # their sum is within the capacity, so they are few
    twos = {a + b: [by[a][0], by[b][0]] for i, a in enumerate(ones) for b in ones[i + 1 :]}
    twos |= {2 * a: by[a][:2] for a in ones if len(by[a]) > 1}
    return twos | {a: by[a][:1] for a in ones}


def local_search(bins: list[list[int]], free: list[int], lengths: list[int], capacity: int) -> list[list[int]]:
    """Exchanges between underfull bins that increase the sum of squared fills, until there are none.

    What a bin can give is kept by its sum of lengths, the emptiest bin first, so that a bin finds the
    exchange that fills it most over all others. The sum of squares grows with each, so the search ends.
    """
    held: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # (fill, bin, its state) by the sum that it can give
    state = [0] * len(bins)
    present = 0  # bit n: a bin may hold a sum of n

    def offer(j: int) -> None:
        nonlocal present
        state[j] += 1
        if bins[j] and free[j]:
            for n in _takes(bins[j], lengths):
                heapq.heappush(held[n], (capacity - free[j], j, state[j]))
                present |= 1 << n

    def emptiest(n: int, other: int) -> int | None:
        """The emptiest bin but `other` that can give `n`."""
        nonlocal present
        heap, own = held[n], None
        while heap and (heap[0][2] != state[heap[0][1]] or heap[0][1] == other):
            top = heapq.heappop(heap)
            own = top if top[2] == state[top[1]] else own
        found = heap[0][1] if heap else None
        if own:
            heapq.heappush(heap, own)
        if not heap:
            present &= ~(1 << n)
        return found

    def exchange(high: int) -> tuple[int, int, int] | None:
        """(bin, sum to take from it, length to give back or 0) with the largest gain for `high`."""
        room, backs = free[high], [0, *{lengths[k] for k in bins[high]}]
        gains = 0
        for m in backs:
            gains |= present >> m
        gains &= (2 << room) - 2
        while gains:
            gain = gains.bit_length() - 1
            gains ^= 1 << gain
            for m in backs:
                if present >> (m + gain) & 1 and (low := emptiest(m + gain, high)) is not None and capacity - free[low] < capacity - room + gain:
                    return low, m + gain, m
        return None

    left, least, changed = sum(map(bool, bins)), -(-sum(lengths) // capacity), True
    for j in range(len(bins)):
        offer(j)
    while changed and left > least:
        changed = False
        for high in sorted((j for j, b in enumerate(bins) if b and free[j]), key=lambda j: free[j]):
            while left > least and bins[high] and free[high] and (found := exchange(high)):
                low, n, m = found
                take = _takes(bins[low], lengths)[n]
                give = [next(k for k in bins[high] if lengths[k] == m)] if m else []
                bins[low] = [k for k in bins[low] if k not in take] + give
                bins[high] = [k for k in bins[high] if k not in give] + take
                free[low], free[high], changed = free[low] + n - m, free[high] - n + m, True
                left -= not bins[low]
                offer(low)
                offer(high)
    return [b for b in bins if b]


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices into `lengths`, none above `capacity`."""
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    down = [lengths[k] for k in order]
    bins, free = best_fit(down, capacity)
    return [[order[k] for k in b] for b in local_search(bins, free, down, capacity)]


def pack(table: DataFrame, capacity: int, shard_pieces: int = SHARD_PIECES, seed: int = 8) -> DataFrame:
    """`table` (from `pieces`, without ids) with sequence_id and the gapless offset of every piece in its sequence."""
    table = keep(table, "pieces")
    shards = -(-table.count() // shard_pieces) or 1

    def packed(key, pdf):
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"]).reset_index(drop=True)
        sequence, offset = np.zeros(len(pdf), "int64"), np.zeros(len(pdf), "int64")
        lengths = pdf["length"].tolist()
        for number, b in enumerate(pack_lengths(lengths, capacity)):
            place = 0
            for k in b:
                sequence[k], offset[k] = (int(key[0]) << 32) + number, place
                place += lengths[k]
        return pdf.drop(columns="shard").assign(sequence_id=sequence, offset=offset)

    dealt = table.withColumn("shard", (F.rand(seed) * shards).cast("int"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema)
    return dealt.groupBy("shard").applyInPandas(packed, f"{kinds}, sequence_id long, offset long")
