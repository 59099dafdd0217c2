"""One handle over all backends, with what each of them can do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.store import MemoryStore, ParquetStore
from .banded import LshIndex, MinHashIndex
from .graph import GraphIndex
from .kmeans import KMeans


class CapabilityError(RuntimeError):
    """The backend does not offer the operation."""


class VectorDatabase:
    """Made by the ``with_*`` constructors. Queries are tables ``(query_id, q)``; ``one`` makes one from a list."""

    def __init__(self, spark: SparkSession, backend, name: str, can: set[str]):
        self.spark, self.backend, self.name, self.can = spark, backend, name, can

    @classmethod
    def with_kmeans(cls, spark, vector_size: int):
        return cls(spark, KMeans(spark, vector_size), "kmeans", {"insert", "query"})

    @classmethod
    def _banded(cls, spark, index, name: str):
        return cls(spark, index, name, {"insert", "insert_with_metadata", "query", "query_with_metadata", "query_dissimilar"} | ({"compact"} if index.store.persistent else set()))

    @staticmethod
    def _store(spark, path: str | None, readonly: bool | None, temporary: bool = False):
        return ParquetStore(spark, path, "temporary" if temporary else "readonly" if readonly else "persistent")

    @classmethod
    def with_min_hash(cls, spark, num_hashes: int, num_bands: int, similarity_threshold: float):
        return cls._banded(spark, MinHashIndex(spark, num_hashes, num_bands, similarity_threshold), "minhash")

    @classmethod
    def with_persistent_min_hash(cls, spark, num_hashes: int, num_bands: int, similarity_threshold: float, db_path: str, readonly: bool | None = None):
        return cls._banded(spark, MinHashIndex(spark, num_hashes, num_bands, similarity_threshold, cls._store(spark, db_path, readonly)), "minhash (persistent)")

    @classmethod
    def with_lsh(cls, spark, num_hashes: int, num_bands: int, vector_size: int, similarity_threshold: float, **planes):
        return cls._banded(spark, LshIndex(spark, num_hashes, num_bands, vector_size, similarity_threshold, **planes), "lsh")

    @classmethod
    def with_temporary_lsh(cls, spark, num_hashes: int, num_bands: int, vector_size: int, similarity_threshold: float, **planes):
        return cls._banded(spark, LshIndex(spark, num_hashes, num_bands, vector_size, similarity_threshold, cls._store(spark, None, None, True), **planes), "lsh (temporary)")

    @classmethod
    def with_persistent_lsh(cls, spark, num_hashes: int, num_bands: int, vector_size: int, similarity_threshold: float, db_path: str, readonly: bool | None = None, **planes):
        return cls._banded(spark, LshIndex(spark, num_hashes, num_bands, vector_size, similarity_threshold, cls._store(spark, db_path, readonly), **planes), "lsh (persistent)")

    @classmethod
    def with_graph(cls, spark, similarity_threshold: float):
        return cls(spark, GraphIndex(spark, similarity_threshold, store=MemoryStore(spark)), "graph", {"insert", "query", "iterate"})

    @classmethod
    def with_persistent_graph(cls, spark, max_connections: int, similarity_threshold: float, db_path: str, readonly: bool | None = None):
        index = GraphIndex(spark, similarity_threshold, max_connections, cls._store(spark, db_path, readonly))
        return cls(spark, index, "graph (persistent)", {"insert", "insert_with_metadata", "query", "query_with_metadata", "compact", "iterate"})

    def one(self, q) -> DataFrame:
        return self.spark.createDataFrame([(0, [float(x) for x in q])], "query_id long, q array<double>")

    def _need(self, what: str) -> None:
        if what not in self.can:
            raise CapabilityError(f"{what} is not supported by the {self.name} backend")

    def insert(self, vectors: DataFrame) -> None:
        self._need("insert")
        self.backend.insert(vectors.drop("metadata"))

    def insert_with_metadata(self, vectors: DataFrame) -> None:
        self._need("insert_with_metadata")
        self.backend.insert(vectors)

    def query(self, queries: DataFrame, n: int) -> DataFrame:
        self._need("query")
        return self.backend.query(queries, n)

    def query_with_metadata(self, queries: DataFrame, n: int) -> DataFrame:
        self._need("query_with_metadata")
        return self.backend.query(queries, n, metadata=True)

    def query_dissimilar_with_metadata(self, queries: DataFrame, n: int, seed: int = 0) -> DataFrame:
        self._need("query_dissimilar")
        return self.backend.query_dissimilar(queries, n, seed)

    def compact(self) -> None:
        self._need("compact")
        self.backend.compact()

    def __iter__(self):
        self._need("iterate")
        return iter(self.backend)

    def close(self) -> None:
        if hasattr(self.backend, "store"):
            self.backend.store.close()

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        self.close()
