"""Nearest neighbours by a block matrix join with int8 products and exact error bounds.

Queries and candidates are dealt into blocks, and each tile - one block of
queries, one of candidates - is one task's work. In a tile every vector is
rounded to int8 with a scale of its own; the product of the int8 blocks gives
all inner products, and the norms of the rounding errors bound, by the
Cauchy-Schwarz inequality, how far each may be off. Only pairs whose lowest
possible distance does not exceed the highest possible distance of the k-th
nearest are computed again, from the original values in double precision, and
kept in a heap for each query. The heaps of the tiles are merged at the end. So
the result is exact: recall is 1 by construction.

Nulls and the like: vectors that are null, empty, zero or hold a null or
non-finite component take no part, nor do null ids; vectors are compared with
those of their own length only. A candidate with the id of the query is the
query's own row. Of repeated query ids the smallest vector asks; repeated
candidates are all found. Ties go to the smaller id.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 4096
#: Candidates of a tile that are multiplied at once.
STRIP = 1024
#: Components up to this have squares, and sums of squares, well within a double.
HUGE = 1e140


def usable(vector: Column) -> Column:
    """Whether a vector has a direction and only finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 values, scale, norm of the rounded vector, norm of the error) of each row."""
    scale = np.abs(x).max(axis=1) / 127.0
    whole = np.rint(x / scale[:, None]).astype(np.int8)
    back = whole * scale[:, None]
    return whole, scale, np.sqrt((back * back).sum(axis=1)), np.sqrt(((x - back) ** 2).sum(axis=1))


def tile_neighbours(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray,
                    k: int) -> list[list[tuple[float, int]]]:
    """The k nearest (distance, id) of each query among the vectors, sorted.

    Vectors whose squares would not fit a double are scaled by a power of two, which changes no digit.
    """
    largest = max(np.abs(queries).max(initial=0.0), np.abs(vectors).max(initial=0.0))
    if largest > HUGE or 0 < largest < 1 / HUGE:
        unit = 2.0 ** np.clip(np.frexp(largest)[1], -1020, 1020)
        found = tile_neighbours(query_ids, queries / unit, ids, vectors / unit, k)
        return [[(d * unit, other) for d, other in near] for near in found]
    heaps: list[list[tuple[float, int]]] = [[] for _ in query_ids]
    whole, scale, norm, error = quantised(queries)
    squares = (queries * queries).sum(axis=1)
    # Sums of so many products of int8 are whole numbers that a float holds exactly.
    exact = np.float32 if queries.shape[1] * 127 * 127 < 1 << 24 else np.float64
    left = whole.astype(exact)
    for at in range(0, len(ids), STRIP):
        y, y_ids = vectors[at:at + STRIP], ids[at:at + STRIP]
        y_whole, y_scale, y_norm, y_error = quantised(y)
        y_squares = (y * y).sum(axis=1)
        inner = (left @ y_whole.astype(exact).T).astype(np.float64) * scale[:, None] * y_scale[None, :]
        middle = squares[:, None] + y_squares[None, :] - 2 * inner
        slack = 2 * (norm[:, None] * y_error[None, :] + error[:, None] * y_norm[None, :] + error[:, None] * y_error[None, :])
        slack += 1e-9 * (squares[:, None] + y_squares[None, :])  # rounding of the doubles themselves
        own = query_ids[:, None] == y_ids[None, :]
        highest = np.where(own, np.inf, middle + slack)
        reach = np.partition(highest, k - 1, axis=1)[:, k - 1] if highest.shape[1] > k else np.full(len(query_ids), np.inf)
        lowest = np.where(own, np.inf, middle - slack)
        for i, heap in enumerate(heaps):
            limit = min(reach[i], heap[0][0] ** 2 * (1 + 1e-9) if len(heap) == k else math.inf)
            near = np.flatnonzero((lowest[i] <= limit) & ~own[i])
            if not len(near):
                continue
            distances = np.sqrt(((y[near] - queries[i]) ** 2).sum(axis=1))
            for d, other in zip((-distances).tolist(), (-y_ids[near]).tolist(), strict=True):
                if len(heap) < k:
                    heapq.heappush(heap, (d, other))
                elif (d, other) > heap[0]:
                    heapq.heapreplace(heap, (d, other))
    return [sorted((-d, -other) for d, other in heap) for heap in heaps]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _tile(k: int):
    def run(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, float]] = []
        if queries.num_rows and candidates.num_rows:
            query_ids = queries.column("id").to_numpy()
            found = tile_neighbours(query_ids, _matrix(queries.column("vector")), candidates.column("id").to_numpy(),
                                    _matrix(candidates.column("vector")), k)
            rows = [(q, other, d) for q, near in zip(query_ids.tolist(), found, strict=True) for d, other in near]
        q, other, d = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(other, pa.int64()),
                         "score": pa.array(d, pa.float64())})
    return run


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest candidates of each query by Euclidean distance."""
    def plain(df: DataFrame) -> DataFrame:
        vector = F.col(f"`{vector_col}`").cast("array<double>")
        return df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), vector.alias("vector")).where(
            F.col("id").isNotNull() & usable(F.col("vector")))

    right = plain(candidates)
    left = plain(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    blocks = max(1, math.ceil(right.count() / CANDIDATE_BLOCK))
    query_blocks = max(1, math.ceil(left.count() / QUERY_BLOCK))
    key = ("length", "block", "query_block")
    right = right.select("id", "vector", F.size("vector").alias("length"), F.pmod(F.xxhash64("id", "vector"), blocks).alias("block"),
                         F.explode(_numbers(query_blocks)).alias("query_block"))
    left = left.select("id", "vector", F.size("vector").alias("length"),
                       F.explode(_numbers(blocks)).alias("block"),
                       F.pmod(F.xxhash64("id"), query_blocks).alias("query_block"))
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_tile(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")  # cut to k in each task before its shuffle
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
