"""Approximate nearest neighbours by collision counting.

Vectors (scaled to length 1, where the largest cosine is the least distance) are dealt into shards. In a shard every single projection gives one sorted
array. A query starts with a narrow window around its own value in each array and widens all windows together (virtual rehashing). A vector that is inside
``share`` or more of the windows is verified by its exact cosine; widening stops when ``budget`` of the shard plus ``k`` vectors are
verified, or all. The shards' best are merged per query. Queries meet shards in blocks, so a task holds a shard and a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

_SCHEMA = "query_id long, vec_id long, score double"


def _axes(dim: int, n: int) -> np.ndarray:
    """``n`` unit directions in orthogonal sets, scaled so that a projected difference is as large as the distance on average."""
    rng, out = np.random.default_rng(dim * 1009 + n), []
    for _ in range(-(-n // dim)):
        out.append(np.linalg.qr(rng.standard_normal((dim, dim)))[0])
    return np.hstack(out)[:, :n] * np.sqrt(dim)


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row times a power of two, which changes no cosine and no digit, so that the squares of very large and very small components stay numbers."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, initial=0.0))[1][:, None])


class Shard:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int = 128):
        self.ids, self.vectors = ids, (vectors := _scaled(vectors))
        self.sizes = np.linalg.norm(vectors, axis=1)
        self.unit = vectors / self.sizes[:, None]
        self.axes = _axes(vectors.shape[1], projections)
        at = self.unit @ self.axes
        self.order = np.argsort(at, axis=0, kind="stable").T.astype(np.int32).copy()
        self.sorted = np.sort(at, axis=0).T.copy()

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, share: float, budget: float) -> list[tuple[int, int, float]]:
        n, m, queries = len(self.ids), len(self.sorted), _scaled(queries)
        unit = queries / np.linalg.norm(queries, axis=1)[:, None]
        at, need, enough = unit @ self.axes, int(np.ceil(share * m)), min(n, int(budget * n) + 2 * k)
        width = 0.7
        lo = np.stack([np.searchsorted(self.sorted[j], at[:, j]) for j in range(m)], 1)
        hi = lo.copy()
        count = np.zeros((len(ids), n), np.int16)
        open_, passed = np.arange(len(ids)), [np.zeros(0, int)] * len(ids)
        while len(open_):
            new_lo = np.stack([np.searchsorted(self.sorted[j], at[open_, j] - width, "left") for j in range(m)], 1)
            new_hi = np.stack([np.searchsorted(self.sorted[j], at[open_, j] + width, "right") for j in range(m)], 1)
            for i, q in enumerate(open_.tolist()):
                rings = [self.order[j, a:b] for j, a, b in zip(range(m), new_lo[i].tolist(), lo[q].tolist(), strict=True) if a < b]
                rings += [self.order[j, a:b] for j, a, b in zip(range(m), hi[q].tolist(), new_hi[i].tolist(), strict=True) if a < b]
                if rings:
                    count[q] += np.bincount(np.concatenate(rings), minlength=n).astype(np.int16)
                passed[q] = np.flatnonzero(count[q] >= need)
            lo[open_], hi[open_] = new_lo, new_hi
            open_ = open_[[len(passed[q]) < enough for q in open_.tolist()]]
            width *= 1.25
        out = []
        for q, own in enumerate(passed):
            own = own[self.ids[own] != ids[q]]
            score = (self.vectors[own] * queries[q]).sum(axis=1) / (self.sizes[own] * np.linalg.norm(queries[q]))  # a sum for each row alone: equal vectors have equal scores wherever they lie
            best = np.lexsort((self.ids[own], -score))[:k]
            out += [(int(ids[q]), int(self.ids[own[b]]), float(score[b])) for b in best]
        return out


def _rows(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    vectors = table.column("vec").combine_chunks()
    return table.column("vec_id").to_numpy(), vectors.flatten().to_numpy().reshape(len(vectors), -1)


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, vec, dim)``: rows with an id whose vector is not null, empty or zero and has finite components; of rows with one vec_id, the smallest vector."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).where("vec_id is not null and size(vec) > 0")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return v.where(F.coalesce(fine, F.lit(False))).groupBy("vec_id").agg(F.min("vec").alias("vec")).withColumn("dim", F.size("vec"))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, projections: int = 128, share: float = 0.5, budget: float = 0.07, shard: int = 8192, block: int = 16384) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each vec_id divisible by ``every``, the ``k`` nearest found among all other vectors of its dimension.

    Score is the cosine of the original vectors; nearest first, ties to the smaller vec_id. With fewer than ``k`` others all are given.
    Null, empty, zero and non-finite vectors and null ids take no part; of repeated ids the smallest vector stands. An
    empty table gives an empty table; other columns are not read.
    """
    own = usable(vectors)
    n = max(1, vectors.count())
    shards, blocks = -(-n // shard), -(-n // (every * block))
    left = own.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = own.where(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if a.num_rows and b.num_rows:
            index, (ids, queries) = Shard(*_rows(a), projections), _rows(b)
            for at in range(0, len(ids), 256):
                rows += index.search(ids[at : at + 256], queries[at : at + 256], k, share, budget)
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    keys = ["dim", "shard", "block"]
    parts = partitions(vectors.sparkSession)  # named, so that Spark does not merge the few small tasks that take long
    found = left.repartition(parts, *keys).groupBy(*keys).cogroup(right.repartition(parts, *keys).groupBy(*keys)).applyInArrow(meet, _SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
