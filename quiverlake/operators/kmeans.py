"""K-means with a growing number of centroids.

A step is one pass: every batch of points is assigned as a matrix and gives partial sums per cluster, which Spark adds up; a row per cluster and
dimension comes to the driver. Points are never collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import vector


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    if x.shape[1] != centroids.shape[1]:
        raise ValueError(f"Vector sizes does not match, {x.shape[1]} != {centroids.shape[1]}")
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], 1)


def nearest_of(d: np.ndarray) -> np.ndarray:
    """The least of each row, the first of equal ones; a distance that is no number is never the least (the first centroid stands if none is)."""
    return np.where(np.isnan(d), np.inf, d).argmin(axis=1)


def assign(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``points`` with ``cluster`` (the nearest centroid; the lowest number on ties) and ``distance`` (L2)."""
    c = np.asarray(centroids, float)

    @F.pandas_udf("cluster int, distance double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"cluster": pd.Series([], dtype="int32"), "distance": pd.Series([], dtype=float)})
        d = squared_distances(np.stack(v.to_numpy()).astype(float), c)
        at = nearest_of(d)
        return pd.DataFrame({"cluster": at.astype(np.int32), "distance": np.sqrt(d[np.arange(len(d)), at])})

    return points.withColumn("near", nearest(F.col("vec"))).select("*", "near.cluster", "near.distance").drop("near")


def nearest_expr(vec: Column, centroids: np.ndarray) -> Column:
    """The nearest centroid's number without Python workers."""
    dists = [F.struct(vector.l2_squared(vec, F.array(*[F.lit(float(x)) for x in c])).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)]
    return F.array_min(F.array(*dists))["i"]


def cluster_sums(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(cluster, pos, total, n, inertia, squares)``: per cluster and dimension the sum; per cluster size, sum of distances and of their squares."""
    c = np.asarray(centroids, float)

    def partial(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["vec"].to_numpy()).astype(float)
            d = squared_distances(x, c)
            at = nearest_of(d)
            d = d[np.arange(len(d)), at]
            rows = []
            for k in np.unique(at):
                own = at == k
                sums = x[own].sum(axis=0)
                rows.append(pd.DataFrame({"cluster": int(k), "pos": range(len(sums)), "total": sums, "n": int(own.sum()), "inertia": float(np.sqrt(d[own]).sum()), "squares": float(d[own].sum())}))
            yield pd.concat(rows)

    parts = points.select("vec").mapInPandas(partial, "cluster int, pos int, total double, n long, inertia double, squares double")
    return parts.groupBy("cluster", "pos").agg(*[F.sum(x).alias(x) for x in ("total", "n", "inertia", "squares")])


def step(points: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[int, float]]]:
    """One Lloyd step: the new centroids (an empty cluster's is zero) and, by cluster, its size and sum of squared distances under the old ones."""
    new, stats = np.zeros_like(np.asarray(centroids, float)), {}
    for r in cluster_sums(points, centroids).collect():
        new[r["cluster"], r["pos"]] = r["total"] * (1.0 / r["n"])
        stats[r["cluster"]] = (r["n"], r["squares"])
    return new, stats


def should_grow(stats: dict[int, tuple[int, float]], k: int) -> bool:
    """Whether the clusters (size and sum of squares, empty ones left out) call for another centroid."""
    n = sum(s[0] for s in stats.values())
    if n < 10 or n < 6 * k or any(s[0] < 3 for s in stats.values()):
        return False
    spread = [s[1] / s[0] for s in stats.values()]
    mean = sum(spread) / len(spread)
    return max(s[0] for s in stats.values()) / max(1, n // k) > 1.5 or max(spread) > 100 or (mean > 0 and max(spread) / mean > 1.3)


def fit_due(before: int, size: int, k: int) -> bool:
    """Whether some row number from ``before + 1`` to ``size`` is a multiple of ``max(10, 2 * (number // k))``. Numbers of one quotient are looked at together; beyond a quotient of ``k`` the answer is known."""
    q = (before + 1) // k
    while q * k <= size:
        low, high, every = max(before + 1, q * k), min(size, q * k + k - 1), max(10, 2 * q)
        if -(-low // every) * every <= high:
            return True
        if k % 2 and q >= max(5, k):
            return False  # the only multiple near q * k, q * (k + 1), lies beyond this quotient's numbers, and so for larger ones
        q += 1
    return False


class KMeans:
    """The model: centroids (two random ones at first), data, and the fit counter that growth depends on."""

    def __init__(self, spark: SparkSession, dim: int, seed: int = 12345):
        self.spark, self.dim, self.rng = spark, dim, np.random.default_rng(seed)
        self.centroids = [self.rng.random(dim), self.rng.random(dim)]
        self.data: DataFrame | None = None
        self.size, self.fit_index = 0, 0

    def add_centroid(self, c) -> None:
        if len(c) != self.dim:
            raise ValueError(f"Vector sizes does not match, {len(c)} != {self.dim}")
        self.centroids.append(np.asarray(c, float))

    def get_centroid(self, i: int) -> list[float]:
        if not 0 <= i < len(self.centroids):
            raise IndexError(f"no centroid {i}")
        return self.centroids[i].tolist()

    def add(self, points: DataFrame) -> int:
        """Add ``points(vec, [vec_id], [seq])``; duplicates stay. Vectors of another length are refused."""
        have = set(points.columns)
        vec = F.col("vec").cast("array<double>")
        ids = F.col("vec_id").cast("long") if "vec_id" in have else F.xxhash64(vec)
        seq = F.col("seq").cast("long") if "seq" in have else ids if "vec_id" in have else F.monotonically_increasing_id()
        rows = points.select((F.lit(self.size) * 0 + seq).alias("seq"), ids.alias("vec_id"), vec.alias("vec")).withColumn("batch", F.lit(self.size).cast("long")).persist()
        n = rows.count()
        wrong = rows.where(F.size("vec") != self.dim).select(F.size("vec")).first()
        if wrong:
            rows.unpersist()
            raise ValueError(f"Vector sizes does not match, {wrong[0]} != {self.dim}")
        self.data = rows if self.data is None else self.data.unionByName(rows)
        self.size += n
        return n

    def fit(self, iterations: int) -> None:
        """Lloyd steps until the centroids move less than 1e-8 in sum; a random centroid is added when the clusters call for it."""
        data, settled, ahead = self.data, len(self.centroids), None
        for _ in range(iterations):
            old = np.array(self.centroids)
            new = np.zeros_like(old) if data is None else (ahead or step(data, old))[0]
            self.centroids, ahead = list(new), None
            if np.sqrt(((new - old)[:settled] ** 2).sum(axis=1)).sum() < 1e-8:  # a centroid just added does not count
                break
            settled = len(new)
            if self.fit_index > 0 and data is not None:
                ahead = step(data, new)  # the sums of the next step, unless a centroid is added
                if should_grow(ahead[1], len(new)):
                    self.centroids.append(self.rng.random(self.dim))
                    ahead = None
            self.fit_index += 1

    def results(self) -> DataFrame:
        """Every point with its cluster."""
        return assign(self.data, np.array(self.centroids))

    def insert(self, points: DataFrame) -> None:
        """Add points, then refit if the schedule falls due within the batch."""
        before = self.size
        self.add(points)
        k = len(self.centroids)
        if fit_due(before, self.size, k):
            self.fit(min(5, max(1, k // 20)))

    def query(self, queries: DataFrame, n: int, rank: str = "insertion") -> DataFrame:
        """``queries(query_id, q)`` -> ``(query_id, vec_id, vec, rank)``: the first ``n`` points of the query's cluster in insertion order (or nearest first, ``rank='l2'``), less those equal to it."""
        if self.data is None:
            return self.spark.createDataFrame([], "query_id long, vec_id long, vec array<double>, rank int")
        centroids = np.array(self.centroids)
        q = assign(queries.select("query_id", F.col("q").cast("array<double>").alias("vec")), centroids).select("query_id", F.col("vec").alias("q"), "cluster")
        members = self.results()
        if rank == "l2":
            rows = q.join(members, "cluster").where(F.col("vec") != F.col("q")).withColumn("order", vector.l2("vec", "q"))
            from ..plans.search import top_k

            return top_k(rows, n, F.col("order"), F.col("vec_id")).select("query_id", "vec_id", "vec", "rank")
        first = F.row_number().over(Window.partitionBy("cluster").orderBy("batch", "seq", "vec_id"))
        head = members.withColumn("rank", first).where(F.col("rank") <= n)  # n rows a cluster, whatever its size
        return q.join(head, "cluster").where(F.col("vec") != F.col("q")).select("query_id", "vec_id", "vec", "rank")
