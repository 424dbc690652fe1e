"""Exact nearest neighbours by a block matrix join with int8 tiles.

Queries and candidates are dealt into blocks of bounded size, every candidate block meets every query
block, and a task multiplies their int8 tiles. The quantisation error of each product is bounded from the
rows' scales and norms, so a product is an interval that holds the true inner product. A candidate whose
upper end lies below the k-th largest lower end, or below the k-th best found so far, can't be among the k
nearest; all others are recomputed in double precision and merged into a heap of k per query. A task emits
its heaps; those of all tasks are ranked by (score, id), cut to k per query before the shuffle and after it.

The queries are a stated set against all rows, in blocks: queries are dealt into blocks of about `BLOCK_BYTES`,
candidates into slices of that size, and each block and slice meet in one task, which goes through them tile
by tile. Blocks, slices and what a task finds are shuffled; nothing passes through the driver.

Vectors that are null, zero, of another length than most, or that hold null or non-finite components take
no part. Repeated ids take part as they are, each row on its own; a query's own id is no candidate. Ties go
to the smaller id, a whole number. Other columns, whatever their names, are left out. An empty table gives an
empty table.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What a task finds.
FOUND = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
#: Bytes of vectors in a block of queries or a slice of candidates, and rows of a tile of each.
BLOCK_BYTES, QUERY_ROWS, TILE_ROWS = 64 << 20, 1_024, 4_096


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part, v as array<double>."""
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine)


def _dimension(rows: DataFrame) -> int:
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return most.d if most else 0


def quantise(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, the norms of what rounding lost, and the norms of the rounded rows."""
    scale = np.abs(m).max(axis=1) / 127
    q = np.rint(m / scale[:, None]).astype(np.int8)
    back = q * scale[:, None]
    return q, scale, np.linalg.norm(m - back, axis=1), np.linalg.norm(back, axis=1)


def _tile(ids, block, tile, queries, best, k):
    """(query rows, candidate rows, scores) of the candidates of a tile that may be among the k nearest; `best`: each query's k-th best so far."""
    q_ids, qm, (qq, qs, ql, qn) = queries
    cq, cs, cl, cn = tile
    # int8 products, exact in float32 while a row has under 1,000 components (127 * 127 * 1000 < 2 ** 24)
    kind = np.float32 if qm.shape[1] < 1000 else np.float64
    near = (qq.astype(kind) @ cq.astype(kind).T).astype(np.float64) * qs[:, None] * cs[None, :]
    # <a, b> - <a', b'> = <a - a', b'> + <a', b - b'> + <a - a', b - b'>
    slack = ql[:, None] * cn[None, :] + qn[:, None] * cl[None, :] + ql[:, None] * cl[None, :]
    slack += 1e-9 * (1 + qn[:, None] * cn[None, :])
    own = q_ids[:, None] == ids[None, :]
    low, high = np.where(own, -np.inf, near - slack), np.where(own, -np.inf, near + slack)
    floor = best
    if low.shape[1] > k:
        floor = np.maximum(best, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
    rows, cols = np.nonzero((high >= floor[:, None]) & ~own)
    # summed component by component whatever the block, so that equal vectors score equally
    scores, a, b = np.zeros(len(rows)), qm[rows], block[cols]
    for j in range(qm.shape[1]):
        scores += a[:, j] * b[:, j]
    return rows, cols, scores


def _merge(heaps: list, best: np.ndarray, rows, ids, scores, k: int) -> None:
    """Puts (score, -id) into the heaps of their query rows, which keep the k best; `best` follows."""
    for r, i, s in zip(rows.tolist(), ids.tolist(), scores.tolist()):
        heap, item = heaps[r], (s, -i)
        if len(heap) < k:
            heapq.heappush(heap, item)
        elif item > heap[0]:
            heapq.heapreplace(heap, item)
        if len(heap) == k:
            best[r] = heap[0][0]


def search(vectors: DataFrame, is_query, k: int, id_col: str = "vec_id", vec_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, the id and the score of each query's k nearest rows. `is_query`: a condition over the column `id`."""
    rows = usable(vectors, id_col, vec_col).withColumn("id", F.col("id").cast("long"))
    d = _dimension(rows)
    rows = rows.where(F.size("v") == d).withColumn("row", F.monotonically_increasing_id())
    queries = rows.where(is_query)
    many = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    per = max(1, block_bytes // (8 * max(1, d)))
    blocks = -(-many.q // per) or 1
    slices = max(-(-many.n // per), min(many.n // TILE_ROWS, vectors.sparkSession.sparkContext.defaultParallelism), 1)

    def nearest(key, mine: pa.Table, others: pa.Table) -> pa.Table:
        if not mine.num_rows or not others.num_rows:
            return FOUND.empty_table()
        q_rows, q_ids, qm = mine.column("row").to_numpy(), mine.column("id").to_numpy(), _matrix(mine.column("v").combine_chunks(), d)
        c_ids, cm = others.column("c_id").to_numpy(), _matrix(others.column("c_v").combine_chunks(), d)
        parts = [(slice(a, a + QUERY_ROWS), quantise(qm[a : a + QUERY_ROWS])) for a in range(0, len(q_ids), QUERY_ROWS)]
        heaps, best = [[] for _ in q_ids], np.full(len(q_ids), -np.inf)
        for at in range(0, len(c_ids), TILE_ROWS):
            ids, block = c_ids[at : at + TILE_ROWS], cm[at : at + TILE_ROWS]
            tile = quantise(block)
            for part, packed in parts:
                got, cols, scores = _tile(ids, block, tile, (q_ids[part], qm[part], packed), best[part], k)
                _merge(heaps[part], best[part], got, ids[cols], scores, k)
        sizes = [len(h) for h in heaps]
        found = [x for h in heaps for x in h]
        return pa.table([np.repeat(q_rows, sizes), np.repeat(q_ids, sizes), pa.array([-i for _, i in found], pa.int64()), pa.array([s for s, _ in found], pa.float64())], schema=FOUND)

    dealt = queries.withColumn("block", F.pmod("row", F.lit(blocks))).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))))
    each = rows.select(F.col("id").alias("c_id"), F.col("v").alias("c_v"), "row").withColumn("slice", F.pmod("row", F.lit(slices))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).drop("row")
    met = dealt.groupBy("block", "slice").cogroup(each.groupBy("block", "slice"))
    found = met.applyInArrow(nearest, "query long, query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    """A list column whose lists all have `d` items, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, max(1, d))
