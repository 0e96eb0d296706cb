"""Exact top-k search by integer inner product, with MaxScore bounds in every shard.

A component is a query term; its postings in a shard are the components of the
shard's vectors. Terms are ordered by how much they can add. Those whose joint
upper bound stays below a query's threshold are non-essential: the essential
postings are traversed for all vectors of the shard, the others are probed only
for vectors that can still reach the threshold. A task holds some of the queries
and takes shards one after another; the k best that a query has found so far set
its threshold in the next one. The tasks' results are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PACKED = "block long, low long, dims int, ids binary, matrix binary"
_FOUND = "query_id long, vec_id long, score long"
_NO_ID = np.iinfo(np.int64).max
#: Multiplications that are worth a task of their own.
_TASK_WORK = 1 << 33


def _rows(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids and quantised vectors, without the rows that take no part."""
    keys, lists = batch.column("id"), batch.column("vector")
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    # A null component becomes NaN.
    x = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    odd = np.append(0, np.cumsum(~np.isfinite(x)))[np.append(0, ends)]
    there = pc.and_(keys.is_valid(), lists.is_valid()).to_numpy(zero_copy_only=False)
    kept = np.flatnonzero(there & (np.diff(odd) == 0))
    ids = keys.take(pa.array(kept)).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, [x[ends[i - 1] if i else 0 : ends[i]] for i in kept.tolist()]


def _matrix(vectors: list[np.ndarray], dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _packer(scale: int, block_rows: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial, ids, vectors = TaskContext.get().partitionId() << 32, [], []

        def block():
            nonlocal serial
            take, matrix = np.array(ids[:block_rows], np.int64), vectors[:block_rows]
            del ids[:block_rows], vectors[:block_rows]
            dims = max(map(len, matrix))
            order = np.argsort(take, kind="stable")
            packed = _matrix(matrix, dims)[order]
            serial += 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([serial - 1], pa.int64()),
                    pa.array([take[order[0]]], pa.int64()),
                    pa.array([dims], pa.int32()),
                    pa.array([take[order].tobytes()], pa.binary()),
                    pa.array([_narrow(packed).tobytes()], pa.binary()),
                ],
                names=["block", "low", "dims", "ids", "matrix"],
            )

        for batch in batches:
            more_ids, more = _rows(batch, scale)
            ids.extend(more_ids.tolist())
            vectors.extend(more)
            while len(ids) >= block_rows:
                yield block()
        if ids:
            yield block()

    return pack


def _narrow(packed: np.ndarray) -> np.ndarray:
    """Two bytes a component where they fit, else eight."""
    fits = not packed.size or (packed.min() >= -32768 and packed.max() <= 32767)
    return packed.astype("<i2") if fits else packed


def _unpacked(ids: pa.Buffer, matrix: pa.Buffer, dims: int) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(ids, np.int64)
    narrow = matrix.size == 2 * dims * len(keys)
    return keys, np.frombuffer(matrix, "<i2" if narrow else "<f8").reshape(len(keys), dims)


def _padded(matrix: np.ndarray, dims: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, dims - matrix.shape[1]))) if matrix.shape[1] < dims else matrix


def _contenders(
    queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, row of the vector, score) of each query's k best with ``least`` or more.

    Ids ascend, so ties go to the first. Queries and vectors are of one type, exact for all their sums.
    """
    dims = queries.shape[1]
    adds = np.maximum(queries * vectors.max(0), queries * vectors.min(0))
    rest = np.concatenate([np.cumsum(adds[:, ::-1], 1)[:, ::-1], np.zeros((len(adds), 1), adds.dtype)], 1)
    threshold, head = least, min(len(ids), 256)
    if head > k and not np.isfinite(least).all():  # one of them may be the query's own
        first = np.where(query_ids[:, None] == ids[None, :head], -np.inf, queries @ vectors[:head].T)
        threshold = np.maximum(least, np.partition(first, head - k, 1)[:, head - k])
    below = rest < threshold[:, None]
    at = int(np.where(below.any(1), below.argmax(1), dims).max())

    # What single precision rounds here lies beyond all sums and stays there.
    needed = (threshold - rest[:, at]).astype(queries.dtype)[:, None]
    if 1024 * np.count_nonzero(queries[:, :at] @ vectors[:head, :at].T >= needed) > len(queries) * head:
        at, needed = dims, threshold.astype(queries.dtype)[:, None]  # so many are cheaper to add up all at once
    partial = queries[:, :at] @ vectors[:, :at].T
    lines = np.flatnonzero(partial.max(1) >= needed[:, 0])
    partial = partial[lines]
    competing = np.flatnonzero(partial >= needed[lines])
    rows, places = np.divmod(competing, len(ids))
    rows, scores = lines[rows], partial.ravel()[competing]
    while at < dims:  # probe the others, a few terms at a time
        to = min(dims, at + 4)
        scores = scores + np.einsum("ij,ij->i", queries[rows, at:to], vectors[places, at:to])
        still = scores + rest[rows, to] >= threshold[rows]
        rows, places, scores, at = rows[still], places[still], scores[still], to
    others = query_ids[rows] != ids[places]
    rows, places, scores = rows[others], places[others], scores[others].astype(np.float64)
    order = np.lexsort((-scores, rows))
    rows = rows[order]
    best = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[best], places[order[best]], scores[order[best]]


class _Queries:
    """Some queries and the k best that each has found so far."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, lines: int = 256):
        self.ids, self.matrix, self.k, self.lines = ids, matrix, k, lines
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), _NO_ID)
        self.norm, self.up, self.down = 0.0, np.zeros(matrix.shape[1]), np.zeros(matrix.shape[1])
        for low in range(0, len(ids), lines):
            part = matrix[low : low + lines].astype(np.float64)
            self.norm = max(self.norm, float(np.abs(part).sum(1).max(initial=0)))
            self.up, self.down = self.up + np.maximum(part, 0).sum(0), self.down + np.minimum(part, 0).sum(0)

    def meet(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        """Take what a shard whose ids ascend has to add."""
        dims = max(self.matrix.shape[1], vectors.shape[1])
        vectors = _padded(vectors.astype(np.float64), dims)
        bound = self.norm * float(np.abs(vectors).max(initial=0))
        if bound >= 2**53:
            raise OverflowError("scores beyond 2**53 are not exact")
        # Sums of small integers are exact in single precision.
        exact = np.float32 if bound < 2**24 else np.float64
        up, down = _padded(np.stack([self.up, self.down]), dims)
        order = np.argsort(-(up * vectors.max(0) + down * vectors.min(0)), kind="stable")
        vectors = vectors[:, order].astype(exact)
        # Of equal scores the smaller id stays, so a shard of larger ones has to beat the last.
        least = self.scores[:, -1] + (ids[0] >= self.found[:, -1])
        for low in range(0, len(self.ids), self.lines):
            part = slice(low, low + self.lines)
            queries = _padded(self.matrix[part], dims)[:, order].astype(exact)
            rows, places, scores = _contenders(queries, self.ids[part], vectors, ids, self.k, least[part])
            if len(rows):
                self._merge(low + rows, ids[places], scores)

    def _merge(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """``rows`` ascend, each at most k times."""
        lines, first, line = np.unique(rows, return_index=True, return_inverse=True)
        column = self.k + np.arange(len(rows)) - first[line]
        both = np.full((len(lines), 2 * self.k), -np.inf)
        keys = np.full((len(lines), 2 * self.k), _NO_ID)
        both[:, : self.k], keys[:, : self.k] = self.scores[lines], self.found[lines]
        both[line, column], keys[line, column] = scores, ids
        order = np.lexsort((keys, -both))[:, : self.k]
        self.scores[lines] = np.take_along_axis(both, order, 1)
        self.found[lines] = np.take_along_axis(keys, order, 1)


def shard_top(
    queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query id, vector ids, scores) of each query's k best in one shard whose ids ascend."""
    asked = _Queries(query_ids, queries, k)
    asked.meet(vectors, ids)
    for key, found, scores in zip(query_ids.tolist(), asked.found, asked.scores, strict=True):
        yield key, found[np.isfinite(scores)], scores[np.isfinite(scores)]


def _searcher(k: int, rows: int = 1 << 16):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[tuple[np.ndarray, np.ndarray]] = []
        asked = None
        for batch in batches:
            for row in range(batch.num_rows):
                at = {c: batch.column(c)[row] for c in ("shard", "dims", "ids", "matrix")}
                ids, matrix = _unpacked(at["ids"].as_buffer(), at["matrix"].as_buffer(), at["dims"].as_py())
                if not at["shard"].as_py():  # they come first
                    blocks.append((ids, matrix))
                    continue
                if blocks:
                    dims = max(m.shape[1] for _, m in blocks)
                    asked = _Queries(
                        np.concatenate([i for i, _ in blocks]), np.concatenate([_padded(m, dims) for _, m in blocks]), k
                    )
                    blocks = []
                if asked:
                    asked.meet(matrix, ids)
        for low in range(0, len(asked.ids) if asked else 0, rows):
            scores, found = asked.scores[low : low + rows], asked.found[low : low + rows]
            query, place = np.nonzero(np.isfinite(scores))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(asked.ids[low + query]),
                    pa.array(found[query, place]),
                    pa.array(scores[query, place].astype(np.int64)),
                ],
                names=["query_id", "vec_id", "score"],
            )

    return search


def _grid(shard_size: int, query_size: int, queries: int, most: int, shard_bytes: int, query_bytes: int) -> tuple[int, int]:
    """Parts of the queries and of the shards, so that a task for each pair of parts is bounded.

    Sizes are in components. The shards are sent once for each part of the queries and the
    other way round; for more tasks than memory asks for, that may be twice the larger side each.
    """
    widest = 4 * max(shard_size, query_size) // max(1, min(shard_size, query_size))
    tasks = max(1, min(most, queries * shard_size // _TASK_WORK, widest))
    down = max(1, math.ceil(8 * query_size / query_bytes), round(math.sqrt(tasks * query_size / max(1, shard_size))))
    return down, max(1, math.ceil(8 * shard_size / shard_bytes), math.ceil(tasks / down))


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    block_rows: int = 4096,
    query_bytes: int = 64 << 20,
    shard_bytes: int = 256 << 20,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every row that ``is_query`` marks.

    Components become ``floor(scale * x)``; the score is the integer inner product;
    ties go to the smaller id; rows with the query's own id are no candidates.

    Null vectors, those with null or non-finite components, and null ids take no
    part. Vectors of unequal length: the shorter is filled with zeros. Repeated
    rows are candidates each; of a repeated query the best k of all its rows'
    candidates stay. Fewer than k candidates: all. Empty table: empty result.

    A task holds queries of ``query_bytes`` and gets shards of ``shard_bytes``, at
    eight bytes a component; no side of it passes the driver, whatever its size.
    """
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector"), is_query.alias("asks")
    )
    # The ids and what is found count as a few components.
    size = F.coalesce(F.size("vector"), F.lit(0)) + 8
    total = rows.agg(F.sum(size).alias("all"), F.sum(F.when(F.col("asks"), size)).alias("asked"), F.count_if("asks").alias("n")).first()
    most = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    down, across = _grid(total["all"] or 0, total["asked"] or 0, total["n"], most, shard_bytes, query_bytes)

    shards = rows.select("id", "vector").mapInArrow(_packer(scale, block_rows), _PACKED)
    asked = rows.where("asks").select("id", "vector").dropDuplicates(["id", "vector"])
    # A query's part follows from its id, so it is the same if a task runs again.
    asked = asked.repartitionById(down, F.pmod(F.xxhash64("id"), F.lit(down)).cast("int"))
    queries = asked.mapInArrow(_packer(scale, block_rows), _PACKED)
    source, serial = F.shiftright("block", 32), F.col("block").bitwiseAND(0xFFFFFFFF)
    row = F.pmod(source, F.lit(down)) * across
    column = F.pmod(F.hash(source) + serial, F.lit(across))
    packed = ("low", "dims", "ids", "matrix")
    dealt = queries.select(F.explode(F.sequence(row, row + (across - 1))).alias("task"), F.lit(False).alias("shard"), *packed)
    every = F.sequence(column, column + (down - 1) * across, F.lit(across).cast("long"))
    dealt = dealt.unionAll(shards.select(F.explode(every).alias("task"), F.lit(True).alias("shard"), *packed))
    # No join: its planner would take the copies of few queries for a small table and broadcast them.
    tasks = dealt.repartitionById(down * across, F.col("task").cast("int")).sortWithinPartitions("shard", "low")
    found = tasks.mapInArrow(_searcher(k), _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
