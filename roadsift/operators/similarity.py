"""Exact nearest vectors.  Vectors are numeric arrays; similarity is the cosine."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadsift.functions.durable import stored

BLOCK = 4096                   # vectors of one packed block
PIVOTS = 256                   # cells of a corpus at most


def unit(v: str | Column) -> Column:
    """Vector divided by its length; a zero vector stays zero."""
    c = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(c, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def _best(sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (queries) and columns (corpus) of everything that can be among the k best of its row, ties included."""
    if sim.shape[1] <= k:
        q, c = np.nonzero(np.isfinite(sim))
        return q, c
    floor = -np.partition(-sim, k - 1, axis=1)[:, k - 1]
    # values within rounding of the k-th stay in, so that the final ordering decides ties
    return np.nonzero((sim >= floor[:, None] - 1e-12) & np.isfinite(sim))


def _normalised(vectors) -> np.ndarray:
    m = np.asarray([np.asarray(v, dtype=float) for v in vectors])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1.0)


def _rank(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Balls:
    """A corpus in cells around pivots: each vector with the pivot nearest to it, each cell with the angle of its farthest vector.

    By the triangle inequality no vector of a cell is nearer to a query than the query's angle to the pivot less that angle.  The
    pivots are at most ``PIVOTS`` corpus vectors, so pivots and radii fit every task; a cell holds blocks of about ``BLOCK`` vectors."""

    def __init__(self, corpus: DataFrame, vec: str, exclude: str | None):
        self.other = F.col(exclude) if exclude else F.lit(None)
        c = corpus.select("id", F.col(vec).cast("array<double>").alias("_v"), self.other.cast("string").alias("_x"))
        self.id_type = c.schema["id"].dataType.simpleString()
        n = c.count()
        if n <= BLOCK:  # one block is one cell, which every query visits
            self.facts = None
            self.blocks = c.groupBy(F.lit(0).alias("cell")).agg(F.collect_list(F.struct("id", "_v", "_x")).alias("_cb"))
            return
        cells = min(PIVOTS, max(1, -(-n // BLOCK)))
        chosen = c.where(F.exists("_v", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(cells).select("_v").collect()
        pivots = _normalised([r[0] for r in chosen]) if chosen else np.zeros((1, 1))

        def place(batches):
            for pdf in batches:
                m = _normalised(pdf["_v"])
                near = m @ pivots.T if len(m) and m.shape[1] == pivots.shape[1] else np.zeros((len(m), len(pivots)))
                cell = near.argmax(axis=1)
                yield pd.DataFrame({"id": pdf["id"], "_v": list(m), "_x": pdf["_x"], "cell": cell, "angle": _angles(near[np.arange(len(m)), cell]), "zero": ~m.any(axis=1)})

        placed = stored(c.mapInPandas(place, f"id {self.id_type}, _v array<double>, _x string, cell int, angle double, zero boolean"), "placed-vectors")
        facts = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"), F.bool_or("zero").alias("zero")).collect()}
        known = [facts.get(k) for k in range(len(pivots))]
        sizes = np.array([r["n"] if r else 0 for r in known])
        self.facts = pivots, sizes, np.array([r["radius"] if r else 0.0 for r in known]), np.array([bool(r and r["zero"]) for r in known])
        subs = F.array(*[F.lit(int(max(1, -(-int(x) // BLOCK)))) for x in sizes])
        self.blocks = placed.groupBy("cell", F.pmod(F.xxhash64("id"), F.get(subs, F.col("cell"))).alias("sub")).agg(F.collect_list(F.struct("id", "_v", "_x")).alias("_cb"))


def _bounds(m: np.ndarray, pivots: np.ndarray, sizes: np.ndarray, radius: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """The greatest similarity that each cell can hold for a query, with room for rounding."""
    angle = _angles(m @ pivots.T)
    out = np.cos(np.maximum(angle - radius[None, :] - 1e-7, 0.0)) + 1e-9
    out[:, zero] = np.maximum(out[:, zero], 1e-9)  # a zero vector lies in no direction
    out[~m.any(axis=1)] = 1.0
    out[:, sizes == 0] = -np.inf
    return out


def _angles(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def topk_with_visits(corpus: DataFrame, queries: DataFrame, k: int = 10, vec: str = "embedding", exclude: str | None = None,
                     not_self: bool = False) -> tuple[DataFrame, DataFrame]:
    """RET-04 with the number of cells each query was sent to (query_id, cells).

    A query first visits the cells nearest to it that hold 2k vectors, which gives it a k-th score; it is then sent only to cells that may
    hold a better one.  In a cell, blocks of queries meet blocks of the corpus, and a task keeps the best k of a pair per query."""
    balls = Balls(corpus, vec, exclude)
    q = queries.select("query_id", F.col(vec).cast("array<double>").alias("_v"), balls.other.cast("string").alias("_x"))
    qt = q.schema["query_id"].dataType.simpleString()
    schema = f"query_id {qt}, id {balls.id_type}, similarity double"
    chunks = max(1, -(-q.count() // BLOCK))
    facts = balls.facts
    sizes = facts[1] if facts else None

    def route(choose, extra: str):
        def run(batches):
            for pdf in batches:
                m = _normalised(pdf["_v"])
                if len(m):
                    pdf = pdf.assign(_v=list(m), cells=choose(_bounds(m, *facts), pdf))
                    yield pdf
        return lambda df: df.mapInPandas(run, f"query_id {qt}, _v array<double>, _x string{extra}, cells array<int>")

    def nearest(bound, pdf):
        order = np.argsort(-bound, axis=1, kind="stable")
        filled = np.cumsum(sizes[order], axis=1)
        until = (filled < 2 * k).sum(axis=1) + 1
        return [o[:n].tolist() for o, n in zip(order, until)]

    def better(bound, pdf):
        floor = pdf["floor"].fillna(-np.inf).to_numpy()
        return [[c for c in np.flatnonzero(b >= f).tolist() if c not in set(done)] for b, f, done in zip(bound, floor, pdf["done"])]

    def score(qid, qm, qx, cid, cm, cx) -> pd.DataFrame:
        sim = qm @ cm.T
        if exclude:
            sim[np.asarray(qx, dtype=object)[:, None] == np.asarray(cx, dtype=object)[None, :]] = -np.inf
        if not_self:
            sim[np.asarray(qid)[:, None] == np.asarray(cid)[None, :]] = -np.inf
        a, b = _best(sim, k)
        return pd.DataFrame({"query_id": np.asarray(qid)[a], "id": np.asarray(cid)[b], "similarity": sim[a, b]})

    def block(batches):
        for pdf in batches:
            for qs, cs in zip(pdf["_qb"], pdf["_cb"]):
                yield score([r["query_id"] for r in qs], _normalised([r["_v"] for r in qs]), [r["_x"] for r in qs],
                            [r["id"] for r in cs], _normalised([r["_v"] for r in cs]), [r["_x"] for r in cs])

    def visit(routed: DataFrame) -> DataFrame:
        sent = routed.select("query_id", "_v", "_x", F.explode("cells").alias("cell"))
        return meet(sent)

    def meet(sent: DataFrame) -> DataFrame:
        packs = sent.groupBy("cell", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).alias("chunk")).agg(F.collect_list(F.struct("query_id", "_v", "_x")).alias("_qb"))
        return packs.join(balls.blocks, "cell").select("_qb", "_cb").mapInPandas(block, schema)

    if facts is None:
        return _rank(meet(q.withColumn("cell", F.lit(0))), k), q.select("query_id", F.lit(1).cast("bigint").alias("cells"))
    home = stored(route(nearest, "")(q), "routed-queries")
    first = stored(_rank(visit(home), k), "first-visits")
    floor = first.where(F.col("rank") == k).select("query_id", F.col("similarity").alias("floor"))
    again = route(better, ", floor double, done array<int>")(home.withColumnRenamed("cells", "done").join(floor, "query_id", "left").select("query_id", "_v", "_x", "floor", "done"))
    again = stored(again.where(F.size("cells") > 0), "sent-on-queries")
    found = _rank(first.drop("rank").unionByName(visit(again)), k)
    visits = home.select("query_id", F.size("cells").alias("n")).unionByName(again.select("query_id", F.size("cells").alias("n"))).groupBy("query_id").agg(F.sum("n").alias("cells"))
    return found, visits


def cosine_topk(corpus: DataFrame, queries: DataFrame, k: int = 10, vec: str = "embedding",
                exclude: str | None = None, not_self: bool = False) -> DataFrame:
    """RET-04: the ``k`` most similar corpus rows of every query: query_id, id, similarity, rank.

    ``corpus`` has id, ``queries`` query_id, both the vector and, if ``exclude`` is given, that column: rows that
    share its value with the query are no candidates.  ``topk_with_visits`` says how.
    """
    return topk_with_visits(corpus, queries, k, vec, exclude, not_self)[0]
