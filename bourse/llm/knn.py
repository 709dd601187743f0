"""Exact top-k search by inner product over KD-trees, one per shard.

Vectors are dealt to shards of about SHARD_ROWS rows by a hash of id and vector.  A shard's tree halves its points at
the median of the widest dimension down to leaves; every node keeps the tight bounding box of its points.  For a
query q the best inner product inside a box is at most the sum of max(q * low, q * high), so the search opens nodes
best bound first and stops when the next bound is below the k-th score found.

Queries travel in blocks.  In a first round each block searches one shard; the k-th scores found there are passed
on to the second round over all shards, where they cut most boxes from the start.  Scores stay exact: an equal
bound is still opened, because a smaller id may win a tie.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bourse.llm.common import col, pieces, stored

SHARD_ROWS, LEAF_ROWS, BLOCK_ROWS = 8192, 512, 512
#: below every score
LOWEST = -(1 << 62)


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component; NULL for vectors that are NULL, empty, or hold NULL or a non-finite number."""
    x = F.transform(vector, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when((F.size(x) > 0) & ~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v * scale).cast("bigint")))


class Tree:
    """Points in leaf order with their ids, and per node: low, high, children (or -1), first and last point."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order, nodes, todo = np.arange(len(ids)), [], [(0, len(ids), -1)]
        while todo:
            a, b, parent = todo.pop()
            if parent >= 0:
                nodes[parent][2 if nodes[parent][2] < 0 else 3] = len(nodes)
            own = points[order[a:b]]
            low, high = own.min(0), own.max(0)
            nodes.append([low, high, -1, -1, a, b])
            if b - a > LEAF_ROWS:
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(own[:, int((high - low).argmax())], mid)]
                todo += [(a + mid, b, len(nodes) - 1), (a, a + mid, len(nodes) - 1)]
        self.ids, self.points = ids[order], points[order]
        self.low, self.high = np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes])
        self.links = np.array([n[2:] for n in nodes], np.int64)

    FIELDS = ("ids", "points", "low", "high", "links")

    def pack(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, f)).tobytes() for f in self.FIELDS]

    @classmethod
    def unpack(cls, dim: int, parts: list[bytes]) -> Tree:
        t = object.__new__(cls)
        for f, raw in zip(cls.FIELDS, parts, strict=True):
            v = np.frombuffer(raw, np.int64)
            setattr(t, f, v if f == "ids" else v.reshape(-1, 4 if f == "links" else dim))
        return t

    def search(self, query_ids: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> Iterator[list[tuple[int, int]]]:
        """For each query up to k (score, id), best first, of scores that are not below its `kth`."""
        points, low, high = self.points, self.low, self.high
        # products of doubles are exact up to 2**53 and much faster
        if float(np.abs(points).max()) * float(np.abs(queries).max()) * points.shape[1] < 2 ** 53:
            points, low, high, queries = (x.astype(np.float64) for x in (points, low, high, queries))
        bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        for own, q, least, bound in zip(query_ids, queries, kth, bounds, strict=True):
            heap, best = [(-bound[0], 0)], []
            while heap:
                b, n = heappop(heap)
                if -b < least:
                    break
                left, right, a, e = self.links[n]
                if left >= 0:
                    heappush(heap, (-bound[left], int(left)))
                    heappush(heap, (-bound[right], int(right)))
                    continue
                score, ids = points[a:e] @ q, self.ids[a:e]
                on = np.flatnonzero((score >= least) & (ids != own))
                if len(on):
                    on = on[np.lexsort((ids[on], -score[on]))[:k]]
                    best = sorted(best + [(-int(s), int(i)) for s, i in zip(score[on], ids[on], strict=True)])[:k]
                    if len(best) == k:
                        least = max(least, -best[-1][0])
            yield [(-s, i) for s, i in best]


def arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors)"""
    return pdf["id"].to_numpy(np.int64), np.stack(pdf["v"].to_numpy()).astype(np.int64)


def build(rows: DataFrame, shards: int) -> DataFrame:
    """(dim, shard, ids, points, low, high, links): a tree per shard and dimension"""
    def tree(key: Any, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[key[0], key[1], *Tree(*arrays(pdf)).pack()]], columns=["dim", "shard", *Tree.FIELDS])

    dealt = rows.withColumns({"dim": F.size("v"), "shard": F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int")})
    return dealt.groupBy("dim", "shard").applyInPandas(tree, "dim int, shard int, " + ", ".join(f"{f} binary" for f in Tree.FIELDS))


def blocks(rows: DataFrame, n: int) -> DataFrame:
    """(dim, block, qids, qs): queries packed into `n` blocks for each dimension"""
    def pack(key: Any, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, v = arrays(pdf)
        return pd.DataFrame([[key[0], key[1], ids.tobytes(), v.tobytes()]], columns=["dim", "block", "qids", "qs"])

    dealt = rows.withColumns({"dim": F.size("v"), "block": F.pmod(F.xxhash64("id", "v", F.lit(3)), F.lit(n)).cast("int")})
    return dealt.groupBy("dim", "block").applyInPandas(pack, "dim int, block int, qids binary, qs binary")


def searched(asked: DataFrame, index: DataFrame, k: int, only_kth: bool) -> DataFrame:
    """(query_id, vec_id, score), or with `only_kth` (dim, block, kth) with the k-th score of every query of a block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            dim, block, qids, qs, kth, *tree = (c[0].as_py() for c in b.columns)
            ids = np.frombuffer(qids, np.int64)
            least = np.frombuffer(kth, np.int64) if kth else np.full(len(ids), LOWEST, np.int64)
            found = Tree.unpack(dim, tree).search(ids, np.frombuffer(qs, np.int64).reshape(-1, dim), least, k)
            if only_kth:
                last = np.array([f[-1][0] if len(f) == k else LOWEST for f in found], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([block], pa.int32()), pa.array([last.tobytes()], pa.binary())], ["dim", "block", "kth"])
                continue
            got = [(int(q), i, s) for q, f in zip(ids, found, strict=True) for s, i in f]
            yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], pa.int64()) for c in range(3)], ["query_id", "vec_id", "score"])

    pairs = asked.join(index, ["dim", "shard"]).select("dim", "block", "qids", "qs", "kth", *Tree.FIELDS)
    return pairs.mapInArrow(run, "dim int, block int, kth binary" if only_kth else "query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for every row whose id is divisible by `every`.

    Scores are inner products of floor(256 * x), and must fit in 64 bits.  Vectors
    that are NULL, empty, or hold NULL or non-finite components, and rows without an
    id, take no part.  Vectors of different lengths are not compared.  Every row is a
    candidate, so an id may be found once for each of its rows, but not by
    rows with its own id; rows that share a query's id ask together and get one ranking.
    Of equal rows no more than `k` can rank, so they are counted before they are dealt out.
    """
    valid = (vectors.select(col(id_col).cast("bigint").alias("id"), whole(col(vector_col)).alias("v"))
             .where("id is not null and v is not null"))
    rows = stored(valid.groupBy("id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
                  .select("id", "v", F.explode(F.sequence(F.lit(1), F.col("n")))).select("id", "v"), "knn-rows")
    asking = rows.where(F.col("id") % every == 0)
    shards, n = max(1, -(-rows.count() // SHARD_ROWS)), max(1, -(-asking.count() // BLOCK_ROWS))
    index = stored(build(rows, shards), "knn-index")
    asked = stored(blocks(asking, n), "knn-queries")
    home = asked.withColumns({"shard": F.pmod("block", F.lit(shards)).cast("int"), "kth": F.lit(None).cast("binary")})
    known = stored(searched(home, index, k, only_kth=True), "knn-bounds")
    everywhere = (asked.join(known, ["dim", "block"], "left")
                  .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    found = searched(everywhere, index, k, only_kth=False)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
