"""Nearest neighbours by inner product with a vantage-point tree per shard.

A vector gets one more component that brings all of a shard to one length, so the largest inner product is the smallest distance, and the
triangle inequality holds.  A subtree is left out where ``relax`` times its least possible distance exceeds the distance of the k-th
neighbour so far: 1 is exact search, whatever the lengths.  More is faster and only fit for vectors of nearly one length: queries don't get
the component, so one long vector moves all distances of its shard to its own length, and most of the shard is left out.  Neighbours are
ranked by the inner product itself.  Every row is in a tree.  Shards and query blocks have a
fixed size in bytes; a task holds one tree and reads query blocks one by one, and keeps k rows for each query and shard.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part; a query meets only vectors of its own
length; rows with the query's id are its own; repeated rows count as often as they occur; a null id takes no part; with fewer than k
candidates all are returned; an empty table gives an empty one; columns other than the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_BYTES = 4 << 20
BLOCK_QUERIES = 512
LEAF = 128
# part of the common length by which rounding may move a distance
ROUNDING = 1e-6


class Tree:
    """A vantage-point tree over row numbers of ``points``."""

    def __init__(self, points: np.ndarray, seed: int = 7):
        self.points = points
        self.squares = (points * points).sum(1)
        self.random = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(points)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        at = int(self.random.choice(rows))
        distance = np.sqrt(np.maximum(self.squares[rows] + self.squares[at] - 2 * self.points[rows] @ self.points[at], 0))
        middle = float(np.median(distance))
        inner = distance <= middle
        if inner.all() or not inner.any():  # many equal vectors, or lengths past the range of a double
            half = len(rows) // 2
            return (at, np.inf, self._build(rows[:half]), self._build(rows[half:]))
        return (at, middle, self._build(rows[inner]), self._build(rows[~inner]))


class Search:
    """The best k of a block of queries in one tree."""

    def __init__(self, tree: Tree, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, relax: float):
        self.tree, self.ids, self.queries, self.own, self.k, self.relax = tree, ids, queries, own, k, relax
        n = len(queries)
        self.squares = (queries * queries).sum(1)
        self.reach = self.squares + tree.squares.max(initial=0)
        self.scores = np.full((n, k), -np.inf)
        self.rows = np.full((n, k), -1)
        if n:
            self._visit(tree.root, np.arange(n))

    def _distance(self, q: np.ndarray, rows: np.ndarray) -> np.ndarray:
        t = self.tree
        return np.sqrt(np.maximum(self.squares[q][:, None] + t.squares[rows] - 2 * self.queries[q] @ t.points[rows].T, 0))

    def _visit(self, node, q: np.ndarray):
        if not len(q):
            return
        if isinstance(node, np.ndarray):
            score = np.einsum("qd,rd->qr", self.queries[q], self.tree.points[node])  # equal vectors get equal scores
            own = self.ids[node] == self.own[q][:, None]
            score[own] = -np.inf
            scores = np.concatenate([self.scores[q], score], 1)
            rows = np.concatenate([self.rows[q], np.where(own, -1, node)], 1)
            # a few more than k aren't needed: equal scores are told apart by id
            best = np.lexsort((np.where(rows < 0, 0, self.ids[rows]), -scores), axis=1)[:, :self.k]
            self.scores[q] = np.take_along_axis(scores, best, 1)
            self.rows[q] = np.take_along_axis(rows, best, 1)
            return
        at, middle, inner, outer = node
        if np.isinf(middle):
            self._visit(inner, q)
            self._visit(outer, q)
            return
        gap = self._distance(q, np.array([at]))[:, 0] - middle
        for first, second, mine in ((inner, outer, gap <= 0), (outer, inner, gap > 0)):
            side = q[mine]
            self._visit(first, side)
            last = np.sqrt(np.maximum(self.reach[side] - 2 * self.scores[side, -1], 0))
            away = np.abs(gap[mine]) * self.relax > last + ROUNDING * np.sqrt(self.reach[side])
            self._visit(second, side[~away])


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    real = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    slim = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return slim.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(real).withColumn("size", F.size("v"))


def _packed(rows: DataFrame, group: list[str], names: str) -> DataFrame:
    """One row with ids and vectors in binary for each group; groups have a bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, data = None, [], []

        def flush():
            if now is not None:
                columns = [pa.array([k], pa.int64()) for k in now] + [pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.array(data, np.float64).tobytes()], pa.binary())]
                yield pa.record_batch(columns, [*group, "ids", "data"])

        for batch in batches:
            for key, i, v in zip(zip(*[batch.column(g).to_pylist() for g in group]), batch.column("id").to_pylist(), batch.column("v").to_pylist()):
                if key != now:
                    yield from flush()
                    now, ids, data = key, [], []
                ids.append(i)
                data.append(v)
        yield from flush()

    dealt = rows.repartition(*group).sortWithinPartitions(*group, "id", "v")
    return dealt.select(*group, "id", "v").mapInArrow(run, ", ".join(f"{g} long" for g in group) + ", ids binary, data binary")


def nearest(vectors: DataFrame, is_query, id: str = "vec_id", vector: str = "embedding", k: int = 20, relax: float = 1.0) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``<id>``, ``score`` for the rows where ``is_query`` (a condition on ``id``) holds."""
    rows = usable(vectors, id, vector)
    sizes = rows.agg(F.count("*").alias("n"), F.max("size").alias("size"),
                     F.sum(F.when(is_query, 1).otherwise(0)).alias("queries")).first()
    per_shard = max(1024, SHARD_BYTES // (8 * (sizes["size"] or 1)))
    n_shards, n_blocks = -(-(sizes["n"] or 1) // per_shard), -(-(sizes["queries"] or 1) // BLOCK_QUERIES)
    placed = rows.withColumn("size", F.col("size").cast("long")).withColumn("shard", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_shards)))
    shards = _packed(placed, ["size", "shard"], "shard")
    blocks = _packed(placed.where(is_query).withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(n_blocks))), ["size", "block"], "block")
    visits = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))))
    visits = visits.select("size", "shard", "block", "ids", "data").unionByName(shards.withColumn("block", F.lit(-1).cast("long")))
    dealt = visits.repartition("size", "shard").sortWithinPartitions("size", "shard", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = tree = None
        for batch in batches:
            for r in range(batch.num_rows):
                size, shard, block, ids, data = (batch.column(c)[r].as_py() for c in ("size", "shard", "block", "ids", "data"))
                ids, data = np.frombuffer(ids, np.int64), np.frombuffer(data, np.float64).reshape(-1, size)
                if block < 0:
                    squares = (data * data).sum(1)
                    rest = np.sqrt(squares.max() - squares)
                    now, held = (size, shard), ids
                    tree = Tree(np.column_stack([data, rest]))
                elif now == (size, shard):
                    found = Search(tree, held, np.column_stack([data, np.zeros(len(data))]), ids, k, relax)
                    rows = np.maximum(found.rows, 0)
                    yield pa.record_batch([pa.array([block]), pa.array([size]), pa.array([ids.tobytes()], pa.binary()),
                                           pa.array([held[rows].tobytes()], pa.binary()), pa.array([found.scores.tobytes()], pa.binary())], ["block", "size", "queries", "ids", "scores"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None

        def flush():
            if best is not None:
                queries, ids, scores = best
                keep = np.isfinite(scores)
                rank = np.broadcast_to(np.arange(1, k + 1), scores.shape)
                yield pa.record_batch([pa.array(np.repeat(queries, keep.sum(1))), pa.array(rank[keep].astype(np.int32)), pa.array(ids[keep]), pa.array(scores[keep])],
                                      ["query_id", "rank", "id", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                key = (batch.column("size")[r].as_py(), batch.column("block")[r].as_py())
                queries = np.frombuffer(batch.column("queries")[r].as_py(), np.int64)
                ids = np.frombuffer(batch.column("ids")[r].as_py(), np.int64).reshape(len(queries), k)
                scores = np.frombuffer(batch.column("scores")[r].as_py(), np.float64).reshape(len(queries), k)
                if key != now:
                    yield from flush()
                    now, best = key, (queries, np.zeros((len(queries), 0), np.int64), np.zeros((len(queries), 0)))
                ids, scores = np.concatenate([best[1], ids], 1), np.concatenate([best[2], scores], 1)
                order = np.lexsort((ids, -scores), axis=1)[:, :k]
                best = queries, np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
        yield from flush()

    partial = dealt.mapInArrow(search, "block long, size long, queries binary, ids binary, scores binary")
    merged = partial.repartition("size", "block").sortWithinPartitions("size", "block").mapInArrow(merge, "query_id long, rank int, id long, score double")
    return merged.withColumnRenamed("id", id)
