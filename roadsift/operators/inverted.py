"""RET-05: inverted lists, a corpus table partitioned by the cell of each vector.

Cells are trained by rounds of mergeable sums (every round one pass that returns a sum and a count per cell), the corpus is written
once, partitioned by cell, with an 8-bit form beside each vector, and a search reads the partitions of the cells it probes.  In a cell the
8-bit scores choose the candidates, with the exact error of every vector as room, so that within the probed cells nothing is lost;
candidates are scored exactly.  Queries are sent to groups of cells, once to a group and not once to each of its cells.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadsift.functions.durable import shared_path, stored
from roadsift.operators.similarity import BLOCK, _normalised, _rank

CELLS = 1024   # at most, so that centres fit every task
ROUNDS = 4
GROUP = 4 * BLOCK   # rows of a group of cells at most, unless one cell holds more
SLICE = 256         # queries that meet a group's rows at once


def _unit_rows(corpus: DataFrame, vec: str) -> DataFrame:
    return corpus.select("id", F.col(vec).cast("array<double>").alias("_v"))


def train_cells(corpus: DataFrame, cells: int | None = None, vec: str = "embedding", rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of spherical k-means; by default as many as the square root of the rows."""
    rows = _unit_rows(corpus, vec)
    n = rows.count()
    k = max(1, min(CELLS, cells or math.isqrt(n)))
    start = rows.where(F.exists("_v", lambda x: x != 0)).orderBy(F.xxhash64("id"), "id").limit(k).select("_v").collect()
    centres = _normalised([r[0] for r in start]) if start else np.zeros((1, 1))
    for _ in range(rounds if start else 0):
        def sums(batches, centres=centres):
            total, count = np.zeros_like(centres), np.zeros(len(centres))
            for pdf in batches:
                if len(pdf):
                    m = _normalised(pdf["_v"])
                    cell = (m @ centres.T).argmax(axis=1)
                    np.add.at(total, cell, m)
                    np.add.at(count, cell, 1)
            yield pd.DataFrame({"cell": np.arange(len(centres)), "part": list(total), "n": count})

        parts = rows.mapInPandas(sums, "cell int, part array<double>, n double").select("cell", F.posexplode("part").alias("at", "x"))
        added = parts.groupBy("cell", "at").agg(F.sum("x").alias("x")).collect()  # cells x dimensions
        total = np.zeros_like(centres)
        for r in added:
            total[r["cell"], r["at"]] = r["x"]
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(length > 0, total / np.where(length > 0, length, 1), centres)
    return centres


class Lists:
    """The written lists and their centres."""

    def __init__(self, spark: SparkSession, path: str, centres: np.ndarray):
        self.spark, self.path, self.centres = spark, path, centres

    @classmethod
    def build(cls, corpus: DataFrame, cells: int | None = None, vec: str = "embedding", path: str | None = None) -> Lists:
        spark = corpus.sparkSession
        centres = train_cells(corpus, cells, vec)

        def place(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                m = _normalised(pdf["_v"])
                scale = np.maximum(np.abs(m).max(axis=1), 1e-12) / 127
                small = np.rint(m / scale[:, None]).astype(np.int8)
                error = np.linalg.norm(m - small * scale[:, None], axis=1)
                cell = (m @ centres.T).argmax(axis=1) if m.shape[1] == centres.shape[1] else np.zeros(len(m), int)
                yield pd.DataFrame({"id": pdf["id"], "v": list(m), "small": [r.tobytes() for r in small], "scale": scale, "error": error, "cell": cell})

        rows = _unit_rows(corpus, vec)
        kind = rows.schema["id"].dataType.simpleString()
        lists = cls(spark, path or shared_path(spark, "inverted-lists"), centres)
        # a cell goes to as many tasks as it has blocks of rows, so a large one isn't one task's work
        spread = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-rows.count() // (BLOCK * len(centres))))))
        placed = rows.mapInPandas(place, f"id {kind}, v array<double>, small binary, scale double, error double, cell int")
        placed.repartition("cell", spread).write.partitionBy("cell").option("compression", "zstd").parquet(lists.path)
        return lists

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8, vec: str = "embedding") -> DataFrame:
        """The ``k`` best rows of each query's ``probes`` nearest cells, or of more cells where those hold fewer than ``k`` rows."""
        centres = self.centres
        sizes = np.zeros(len(centres), np.int64)
        for r in self.read().groupBy("cell").count().collect():
            sizes[r["cell"]] = r["count"]
        q = queries.select("query_id", F.col(vec).cast("array<double>").alias("_v"))
        qt, ct = q.schema["query_id"].dataType.simpleString(), self.read().schema["id"].dataType.simpleString()

        places, subs = self._groups(sizes)

        def route(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                m = _normalised(pdf["_v"])
                order = np.argsort(-(m @ centres.T), axis=1, kind="stable")
                enough = np.maximum((np.cumsum(sizes[order], axis=1) < k).sum(axis=1) + 1, probes)
                probed = np.zeros(order.shape, bool)
                np.put_along_axis(probed, order, np.arange(len(centres)) < enough[:, None], axis=1)
                held = probed & (sizes > 0)
                yield pd.DataFrame({"query_id": pdf["query_id"], "_v": list(m), "places": [np.unique(places[h]) for h in held], "probed": [np.packbits(p).tobytes() for p in probed]})

        routed = stored(q.mapInPandas(route, f"query_id {qt}, _v array<double>, places array<int>, probed binary"), "routed-queries").withColumn("place", F.explode("places"))
        wanted = [r[0] for r in routed.select("place").distinct().collect()]  # at most CELLS numbers
        rows = self.read().where(F.col("cell").isin(np.flatnonzero(np.isin(places, wanted)).tolist())).withColumn("place", F.get(F.lit(places.tolist()), F.col("cell")))
        chunk, sub = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-q.count() // BLOCK)))), F.pmod(F.xxhash64("id"), F.get(F.lit(subs.tolist()), F.col("place")))
        asked = routed.groupBy("place", chunk.alias("chunk")).agg(F.collect_list(F.struct("query_id", "_v", "probed")).alias("_q"))
        blocks = rows.groupBy("place", sub.alias("sub")).agg(F.collect_list(F.struct("id", "v", "small", "scale", "error", "cell")).alias("_c"))

        def block(batches):
            for pdf in batches:
                for qs, cs in zip(pdf["_q"], pdf["_c"]):
                    cid, cell = np.asarray([r["id"] for r in cs]), np.asarray([r["cell"] for r in cs])
                    scale, error = (np.asarray([r[c] for r in cs]) for c in ("scale", "error"))
                    small, exact = np.stack([np.frombuffer(r["small"], np.int8) for r in cs]).astype(np.float64).T, np.asarray([r["v"] for r in cs])
                    room = error + 1e-12  # unit queries: the rough score is off by the vector's error at most
                    for at in range(0, len(qs), SLICE):
                        part = qs[at:at + SLICE]
                        qm, qid = np.asarray([r["_v"] for r in part]), np.asarray([r["query_id"] for r in part])
                        probed = np.stack([np.unpackbits(np.frombuffer(r["probed"], np.uint8), count=len(centres)) for r in part]).astype(bool)[:, cell]
                        rough = np.where(probed, (qm @ small) * scale, -np.inf)
                        if len(cs) > k:
                            floor = -np.partition(-(rough - room), k - 1, axis=1)[:, k - 1]
                            a, b = np.nonzero(probed & (rough + room >= floor[:, None] - 1e-12))
                        else:
                            a, b = np.nonzero(np.isfinite(rough))
                        yield pd.DataFrame({"query_id": qid[a], "id": cid[b], "similarity": np.einsum("ij,ij->i", qm[a], exact[b])})

        # the queries sent are planned at the size of the routed table, whatever the number of groups it is exploded to: no broadcast
        pairs = asked.hint("merge").join(blocks, "place").select("_q", "_c")
        return _rank(pairs.mapInPandas(block, f"query_id {qt}, id {ct}, similarity double"), k)

    def _groups(self, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group of every cell, and into how many blocks of rows each group is dealt.  Groups are at most ``GROUP`` rows and a cell
        large, and no fewer than tasks where cells allow it."""
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        total = int(sizes.sum())
        room = max(1, min(GROUP, -(-total // tasks)))
        places = (np.cumsum(sizes) - sizes) // room
        places = np.unique(places, return_inverse=True)[1].astype(np.int32)
        return places, np.maximum(1, -(-np.bincount(places, weights=sizes).astype(np.int64) // (2 * GROUP)))


def approx_topk(corpus: DataFrame, queries: DataFrame, k: int = 10, cells: int | None = None, probes: int | None = None, vec: str = "embedding") -> DataFrame:
    """RET-05: ``k`` similar rows of every query from inverted lists made for this corpus; by default half of the cells are probed, ``probes``
    of all of them make the search exact."""
    lists = Lists.build(corpus, cells, vec)
    return lists.search(queries, k, probes or -(-len(lists.centres) // 2), vec)
