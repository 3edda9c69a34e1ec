"""Exact top-k by inner product with pivot-table elimination.

Inner products become distances: with M2 the largest squared length, x' = (x, sqrt(M2 - |x|^2)) and
q' = (q, 0), |q' - x'|^2 = |q|^2 + M2 - 2 q.x. Distances of every candidate to many pivots are computed
once. For a query, max over pivots of |d(q', p) - d(x', p)| is a lower bound of its distance to a candidate, hence
an upper bound of the inner product; candidates are evaluated in the order of their bounds until no
remaining bound reaches the k-th best score, ties included. Pivots are a bounded sample (`pivots`, spread
by farthest-first choice among `pivot_sample` vectors); they affect speed only, never results.

Candidates and queries are packed into blocks; each pair of blocks is one unit of work and gives k rows a query,
which are merged by a partial top-k. Blocks are joined on a salted key.

Scores are exact below 2^53 in size; larger ones are those of double precision, at most 2^63 - 1024 in size.
Vectors that are null, empty or hold null or non-finite components take no part. Queries with fewer than k other vectors get
all of them. Ties go to the smaller id. Repeated ids: "not the query's own" compares ids. Vectors are compared only
with vectors of equal length. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import tidy


#: The greatest double below 2^63.
LARGEST = float(2**63 - 1024)


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


class PivotTable:
    """Distances of a block of integer vectors to pivots, for exact search by inner product."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], vectors[order]
        square = (self.x * self.x).sum(1)
        self.m2 = float(max(square.max(initial=0.0), (pivots * pivots).sum(1).max(initial=0.0)))
        self.lift = np.sqrt(self.m2 - square)
        self.pivots, self.p_lift = pivots, np.sqrt(self.m2 - (pivots * pivots).sum(1))
        self.table = np.stack([self._distance(self.x, self.lift, p, h) for p, h in zip(self.pivots, self.p_lift)]) if len(pivots) else np.zeros((0, len(ids)))
        self.evaluated = 0

    @staticmethod
    def _distance(x, lift, p, h):
        return np.sqrt(np.maximum(((x - p) ** 2).sum(-1) + (lift - h) ** 2, 0.0))

    def search(self, own: int, q: np.ndarray, k: int, step: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """The k best (ids, scores) for q among vectors of other ids."""
        q2 = float((q * q).sum())
        near = np.zeros(len(self.ids))
        for p, h, d in zip(self.pivots, self.p_lift, self.table):
            np.maximum(near, np.abs(d - np.sqrt(((q - p) ** 2).sum() + h * h)), out=near)
        bound = (q2 + self.m2 - near * near) / 2
        bound += 1e-6 * (q2 + self.m2) + 1  # rounding must never hide a candidate
        bound[self.ids == own] = -np.inf
        order = np.argsort(-bound, kind="stable")
        best_id, best = np.zeros(0, np.int64), np.zeros(0)
        for a in range(0, len(order), step):
            part = order[a : a + step]
            if len(best) == k and bound[part[0]] < best[-1] or bound[part[0]] == -np.inf:
                break
            part = part[bound[part] > -np.inf]
            self.evaluated += len(part)
            best_id, best = np.concatenate((best_id, self.ids[part])), np.concatenate((best, self.x[part] @ q))
            top = np.lexsort((best_id, -best))[:k]
            best_id, best = best_id[top], best[top]
        return best_id, best


def blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Rows (dim, ids binary, data binary) of up to `size` vectors (columns id, v array<double>); no shuffle."""

    def run(batches):
        for batch in batches:
            lists = batch.column("v")
            n = lists.value_lengths().to_numpy()
            flat, at = lists.flatten().to_numpy(), np.cumsum(n) - n
            ids = batch.column("id").to_numpy()
            for dim in np.unique(n).tolist():
                pick = np.flatnonzero(n == dim)
                for a in range(0, len(pick), size):
                    part = pick[a : a + size]
                    x = flat[at[part][:, None] + np.arange(dim)]
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([ids[part].astype("<i8").tobytes()], pa.binary()), pa.array([x.astype("<f8").tobytes()], pa.binary())], ["dim", "ids", "data"])

    return vectors.mapInArrow(tidy(run), "dim int, ids binary, data binary")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, pivots: int = 32, pivot_sample: int = 2000, block: int = 4096, query_block: int = 512) -> DataFrame:
    """Rows (query_id, rank, id, score long) with components floor(scale * x)."""
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    good = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)) & (F.size(v) > 0) & F.col(id_col).isNotNull()
    used = vectors.where(good)
    whole = lambda d: d.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * F.lit(scale)).cast("double")).alias("v"))
    sample = [r.v for r in whole(used).limit(pivot_sample).collect()]
    chosen = {d: spread_pivots(np.array([s for s in sample if len(s) == d]), pivots) for d in {len(s) for s in sample}}
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    data = blocks(whole(used), block).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)))
    asked = blocks(whole(used.where(is_query)).coalesce(4), query_block).withColumnsRenamed({"ids": "q_ids", "data": "q_data"})
    asked = asked.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    pairs = asked.join(data, ["salt", "dim"]).select("dim", "q_ids", "q_data", "ids", "data")

    def run(batches):
        made: dict[bytes, PivotTable] = {}
        for batch in batches:
            for dim, q_ids, q_data, ids, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if ids not in made:
                    made.clear()
                    made[ids] = PivotTable(np.frombuffer(ids, "<i8"), np.frombuffer(raw, "<f8").reshape(-1, dim), chosen.get(dim, np.zeros((0, dim))))
                out = [[], [], []]
                for own, q in zip(np.frombuffer(q_ids, "<i8").tolist(), np.frombuffer(q_data, "<f8").reshape(-1, dim)):
                    got, score = made[ids].search(own, q, k)
                    out[0] += [own] * len(got)
                    out[1] += got.tolist()
                    out[2] += np.clip(score, -LARGEST, LARGEST).astype(np.int64).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "id", "score"])

    found = pairs.mapInArrow(tidy(run), "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
