"""Exact top-k search by inner product with a KD-tree for each shard of vectors.

Components are turned into integers, floor(scale * x), so scores are exact and ties are plain. Vectors are dealt into
shards by a hash of their rows; in a shard a tree is built by median splits on the widest side, each node with the tight
box of its vectors. A query goes through a tree best-first: by the highest inner product that a node's box allows, until
that falls below the k-th best score known. That score starts from a first search of one shard for each query, and so
every other shard is entered with a k-th score that only vectors worth returning can reach.

Queries are dealt into blocks, and a task searches one shard for one block, so what a task holds is bounded whatever the
numbers of vectors and queries. Each shard returns at most k rows for a query; the best k of these are the result.

Defined results: vectors that are null or hold null or non-finite components take no part, neither as queries nor as
candidates; nor do candidates of another length than the query. Rows that share the query's id are the query's own and
are left out; a null id is never a query, and as a candidate it comes after every other on ties. A repeated candidate row
counts as often as it occurs; a repeated query row is answered once. With fewer than k candidates all are returned. Other
columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LAST = np.iinfo(np.int64).max


class KdTree:
    """Nodes in arrays: boxes (low, high), children, and the run of rows below each node."""

    def __init__(self, points: np.ndarray, leaf: int = 64) -> None:
        self.order = np.arange(len(points))
        low, high, child, run = [], [], [], []
        todo = [(0, len(points), -1)]
        while todo:
            begin, end, parent = todo.pop()
            rows = points[self.order[begin:end]]
            node = len(low)
            low.append(rows.min(axis=0))
            high.append(rows.max(axis=0))
            child.append([])
            run.append((begin, end))
            if parent >= 0:
                child[parent].append(node)
            wide = high[-1] - low[-1]
            if end - begin > leaf and wide.max(initial=0) > 0:
                axis, half = int(wide.argmax()), (end - begin) // 2
                self.order[begin:end] = self.order[begin:end][np.argpartition(rows[:, axis], half)]
                todo += [(begin, begin + half, node), (begin + half, end, node)]
        self.low, self.high, self.child, self.run = np.array(low), np.array(high), child, run
        self.points = points[self.order]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node the highest inner product that the node's box allows."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bounds: np.ndarray, ids: np.ndarray, own: int, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the k best rows that reach floor, ties to smaller ids. ids: in the order of self.order."""
        scores, found, kth = np.zeros(0), np.zeros(0, np.int64), floor
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < kth:
                break
            if self.child[node]:
                for c in self.child[node]:
                    if bounds[c] >= kth:
                        heapq.heappush(heap, (-bounds[c], c))
                continue
            begin, end = self.run[node]
            reached = self.points[begin:end] @ query
            good = (reached >= kth) & (ids[begin:end] != own)
            if good.any():
                scores, found = np.concatenate([scores, reached[good]]), np.concatenate([found, ids[begin:end][good]])
                if len(scores) > k:
                    best = np.lexsort((found, -scores))[:k]
                    scores, found = scores[best], found[best]
                    kth = max(kth, scores[-1])
                elif len(scores) == k:
                    kth = max(kth, scores.min())
        return scores, found


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1)


def _exact(*sides: np.ndarray) -> list[np.ndarray]:
    """As doubles if every product and sum is exact in them, else as Python integers."""
    most = [int(np.abs(s.astype(object)).max()) if s.size else 0 for s in sides]
    safe = sides[0].shape[1] * max(1, most[0]) * max(1, most[1]) < 1 << 53
    return [s.astype(np.float64 if safe else object) for s in sides]


def _anew(df: DataFrame) -> DataFrame:
    """df with new columns of the same names, so that it can meet a table it was made from."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """id, v (array<long>) and dim of the rows that take part."""
    v = F.col(f"`{vector}`")
    # exists() is null, not false, where a component is null and none is non-finite
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return df.where(v.isNotNull() & ~bad & (F.size(v) > 0)).select(F.col(f"`{key}`").cast("long").alias("id"), whole.alias("v"), F.size(v).alias("dim"))


def top_k(df: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding", shard_rows: int = 4096, block_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each row for which is_query (over id) holds."""
    vectors = integer_vectors(df, key, vector, scale)
    n, asked = vectors.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-(asked or 0) // block_rows))
    placed = vectors.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))
    queries = placed.where(is_query & F.col("id").isNotNull()).dropDuplicates(["id", "v"]).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def search(points: pa.Table, asked: pa.Table, floors: np.ndarray | None) -> pa.Table | None:
        if not points.num_rows or not asked.num_rows:
            return None
        p, q = _exact(_matrix(points["v"], points.num_rows), _matrix(asked["v"], asked.num_rows))
        ids = points["id"].fill_null(_LAST).to_numpy()
        tree = KdTree(p)
        ids = ids[tree.order]
        bounds, own = tree.bounds(q), asked["id"].to_numpy()
        out = [tree.search(q[i], bounds[i], ids, own[i], k, -np.inf if floors is None else floors[i]) for i in range(len(q))]
        lengths = [len(s) for s, _ in out]
        scores = np.concatenate([s for s, _ in out]).astype(np.int64)
        found = np.concatenate([f for _, f in out])
        at = np.repeat(np.arange(len(q)), lengths)
        return pa.table({"query_id": pa.array(own[at]), "mark": pa.array(asked["mark"].to_numpy()[at]), "vec_id": pa.array(found, mask=found == _LAST), "score": pa.array(scores)})

    schema = "query_id long, mark long, vec_id long, score long"
    nothing = pa.table({"query_id": pa.array([], pa.int64()), "mark": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})

    def first_look(asked: pa.Table, points: pa.Table) -> pa.Table:
        return (found if (found := search(points, asked, None)) is not None else nothing).select(["query_id", "mark", "vec_id", "score"])

    def full_look(asked: pa.Table, points: pa.Table) -> pa.Table:
        floors = asked["floor"].fill_null(np.iinfo(np.int64).min).to_numpy().astype(np.float64) if asked.num_rows else None
        return (found if (found := search(points, asked, floors)) is not None else nothing).select(["query_id", "mark", "vec_id", "score"])

    queries = queries.withColumn("mark", F.xxhash64("v"))
    here = _anew(queries).groupBy("dim", "shard", "block").cogroup(placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("dim", "shard", "block")).applyInArrow(first_look, schema)
    # the k-th score is a bound only where one shard alone has k candidates
    floors = here.groupBy("query_id", "mark").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    floors = floors.select(F.col("query_id").alias("id"), "mark", "floor")
    spread = _anew(queries).drop("shard").join(floors, ["id", "mark"], "left")
    spread = spread.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    all_points = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = _anew(spread).groupBy("dim", "shard", "block").cogroup(all_points.groupBy("dim", "shard", "block")).applyInArrow(full_look, schema)
    best = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
