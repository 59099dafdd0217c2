"""Index stores: in memory (cached tables) or Parquet folders with a manifest.

A store holds tables in parts: ``append`` adds a part to each, so an insert writes its own rows alone, and ``save`` puts one new part in place of all. A Parquet store's parts are
folders ``v{n}/{table}`` (bucket tables partitioned by band, sorted by key, with a Bloom filter on it), and ``manifest-{n}.json`` names the parts and the index parameters of version n. A
version is written whole before its manifest appears, by one rename to a name that was never used; readers take the newest manifest. What only
older versions name is deleted when the version after the next one is published, so that their readers can end.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class StoreError(RuntimeError):
    """A store cannot do what was asked."""


class MemoryStore:
    persistent = False

    def __init__(self, spark: SparkSession):
        self.spark, self.tables, self.parameters, self.version = spark, {}, {}, 0

    def append(self, parameters: dict, **tables: DataFrame) -> None:
        for name, t in tables.items():
            t = t.persist()
            t.count()
            self.tables.setdefault(name, []).append(t)
        self.parameters, self.version = parameters, self.version + 1

    def save(self, parameters: dict, **tables: DataFrame) -> None:
        old, self.tables = self.tables, {}
        self.append(parameters, **tables)
        for t in (t for parts in old.values() for t in parts):
            t.unpersist()

    def load(self, name: str) -> DataFrame | None:
        return reduce(DataFrame.unionByName, self.tables[name]) if name in self.tables else None

    def compact(self) -> None:
        raise StoreError("only persistent stores can be compacted")

    def close(self) -> None:
        for t in (t for parts in self.tables.values() for t in parts):
            t.unpersist()
        self.tables = {}


class ParquetStore:
    """``mode``: ``persistent``, ``readonly``, or ``temporary`` (a folder of its own in the shared one, deleted on close)."""

    persistent = True

    def __init__(self, spark: SparkSession, path: str | None = None, mode: str = "persistent"):
        if mode not in ("persistent", "readonly", "temporary"):
            raise ValueError(f"unknown mode: {mode}")
        if mode == "temporary":
            root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
            path = f"{root.rstrip('/')}/quiverlake-store-{uuid.uuid4().hex}"
        if path is None:
            raise ValueError("a path is needed")
        self.spark, self.path, self.mode = spark, path.rstrip("/"), mode
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.manifest = self._read()
        if mode == "readonly" and self.manifest is None:
            raise StoreError(f"no store at {self.path}")

    def _at(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def _versions(self) -> list[int]:
        if not self._fs.exists(self._at()):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at())]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def _read(self, version: int | None = None) -> dict | None:
        versions = self._versions() if version is None else [version]
        if not versions:
            return None
        stream = self._fs.open(self._at(f"manifest-{versions[-1]}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        version = manifest["version"]
        draft, final = self._at(f"draft-{uuid.uuid4().hex}"), self._at(f"manifest-{version}.json")
        stream = self._fs.create(draft, True)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise StoreError(f"version {version} of {self.path} was written by another")
        kept = {p for m in (manifest, self.manifest) if m for t in m["tables"].values() for p in t["parts"]}
        for old in self._versions()[:-2]:
            gone = {p for t in self._read(old)["tables"].values() for p in t["parts"]} - kept
            for p in gone:
                self._fs.delete(self._at(p), True)
            self._fs.delete(self._at(f"manifest-{old}.json"), False)
        self.manifest = manifest

    @property
    def parameters(self) -> dict:
        return (self.manifest or {}).get("parameters", {})

    @property
    def version(self) -> int:
        return (self.manifest or {}).get("version", 0)

    def _write(self, parameters: dict, old: dict, tables: dict[str, DataFrame]) -> None:
        if self.mode == "readonly":
            raise StoreError("the store is read-only")
        version, out = self.version + 1, dict(old)
        for name, df in tables.items():
            part = f"v{version}-{uuid.uuid4().hex}/{name}"
            if "band" in df.columns:
                df.sortWithinPartitions("band", "key").write.option("parquet.bloom.filter.enabled#key", "true").partitionBy("band").parquet(f"{self.path}/{part}")
            else:
                df.write.parquet(f"{self.path}/{part}")
            out[name] = {"schema": df.schema.jsonValue(), "parts": [*old.get(name, {}).get("parts", []), part]}
        self._publish({"version": version, "parameters": parameters, "tables": out})

    def append(self, parameters: dict, **tables: DataFrame) -> None:
        """Add a part to each of the tables."""
        self._write(parameters, (self.manifest or {}).get("tables", {}), tables)

    def save(self, parameters: dict, **tables: DataFrame) -> None:
        """These tables in place of all that there are."""
        self._write(parameters, {}, tables)

    def load(self, name: str) -> DataFrame | None:
        if self.manifest is None or name not in self.manifest["tables"]:
            return None
        table = self.manifest["tables"][name]
        schema = StructType.fromJson(table["schema"])
        return reduce(DataFrame.unionByName, [self.spark.read.schema(schema).parquet(f"{self.path}/{p}") for p in table["parts"]])

    def compact(self, files: int = 1, **tables: DataFrame) -> None:
        """One part for each table, in ``files`` files (for each band of a banded one), as a new version; ``tables`` in place of what some hold."""
        if self.manifest:
            tables = {name: self.load(name) for name in self.manifest["tables"]} | tables
            self.save(self.parameters, **{k: t.repartition("band") if "band" in t.columns else t.repartition(files) for k, t in tables.items()})

    def close(self) -> None:
        if self.mode == "temporary":
            self._fs.delete(self._at(), True)


def upsert(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Add ``new(vec, [vec_id], [metadata], [seq])`` to ``old(vec_id, vec, metadata, seq)``, one row a vector.

    A vector's content is its identity: inserted again it keeps its id, and its metadata are the last given, where null gives none. ``seq`` orders
    the rows of a batch and defaults to vec_id; a vec_id defaults to the content's hash.
    """
    have = set(new.columns)
    ids = F.col("vec_id").cast("long") if "vec_id" in have else F.xxhash64(F.col("vec").cast("array<double>"))
    rows = new.select(ids.alias("vec_id"), F.col("vec").cast("array<double>").alias("vec"), (F.col("metadata") if "metadata" in have else F.lit(None)).cast("map<string,string>").alias("metadata"), (F.col("seq").cast("long") if "seq" in have else ids).alias("seq"))
    rows = rows.withColumn("age", F.lit(1))
    if old is not None:
        rows = old.withColumn("age", F.lit(0)).unionByName(rows)
    order = F.struct("age", "seq", "vec_id")
    known = F.when(F.col("metadata").isNotNull(), order)
    return rows.groupBy("vec").agg(F.min_by("vec_id", order).alias("vec_id"), F.max_by("metadata", known).alias("metadata"), F.min_by("seq", order).alias("seq")).select("vec_id", "vec", "metadata", "seq")


def sample_keys(df: DataFrame, n: int, fraction: float = 0.01, seed: int = 0) -> DataFrame:
    """A Bernoulli sample in id order, ``n`` rows at most."""
    return df.sample(fraction=fraction, seed=seed).orderBy("vec_id").limit(n)
