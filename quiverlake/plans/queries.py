"""The engine's queries over the ``embeddings`` and ``lineitem`` tables, each with its SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, vector
from ..operators import kmeans
from ..operators.banded import LshIndex, MinHashIndex
from ..operators.database import VectorDatabase
from ..operators.graph import GraphIndex, build_shards, search_shards
from ..sources.store import ParquetStore, upsert
from ..streaming.ingest import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

E = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, embedding AS f, label FROM embeddings), q AS (SELECT vec_id AS qid, v AS q, f AS g FROM e WHERE vec_id = 0)"


#: The query set of searches of a whole table.
ALL = "{} % 20 = 0"


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return df.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder where all executors see it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/quiverlake-{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame) -> DataFrame:
    """Written and read again: what a store that is about to close has answered."""
    path = shared_path(df.sparkSession, "answers")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir).select("vec_id", "vec")
    return e.crossJoin(F.broadcast(e.where("vec_id = 0").select(F.col("vec").alias("q"))))  # one row


def rounded(c: Column | str) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def _scalar(name: str, expr: Callable[[], Column], sql: str, digits: bool = True) -> None:
    value = f"round({sql}, 6) + 0.0" if digits else sql

    @query(name, f"{E} SELECT vec_id, {value} AS value FROM e, q")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _pairs(spark, sf_dir).select("vec_id", (rounded(expr()) if digits else expr()).alias("value"))


def _vector(name: str, expr: Callable[[], Column], sql: str) -> None:
    @query(name, f"{E}, r AS (SELECT vec_id, {sql} AS r FROM e, q) SELECT vec_id, unnest(range(len(r)))::INTEGER AS pos, round(unnest(r)::DOUBLE, 6) + 0.0 AS value FROM r")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _pairs(spark, sf_dir).select("vec_id", F.posexplode(expr()).alias("pos", "value")).select("vec_id", "pos", rounded(F.col("value").cast("double")).alias("value"))


def _bytes(c: str) -> Column:
    return vector.quantized(vector.scaled(c, 4.0))


_A, _B = ("[floor(greatest(0, least(1, x * 4)) * 255) for x in {}]".format(c) for c in ("v", "q"))
_ALL = "for i in range(1, len(v) + 1)]"

_scalar("vec_l2", lambda: vector.l2("vec", "q"), "list_distance(v, q)")
_scalar("vec_l2_squared", lambda: vector.l2_squared("vec", "q"), "power(list_distance(v, q), 2)")
_scalar("vec_dot", lambda: vector.dot("vec", "q"), "list_inner_product(v, q)")
_scalar("vec_cosine", lambda: vector.cosine("vec", "q"), "CASE WHEN list_inner_product(v, v) = 0 OR list_inner_product(q, q) = 0 THEN 0.0 ELSE list_cosine_similarity(v, q) END")
_scalar("vec_magnitude", lambda: vector.magnitude("vec"), "sqrt(list_inner_product(v, v))")
_scalar("vec_total", lambda: vector.total("vec"), "list_sum(v)")
_scalar("vec_length", lambda: vector.length("vec").cast("long"), "len(v)::BIGINT", False)
_scalar("vec_element", lambda: vector.element("vec", 3), "v[4]")
_scalar("vec_equal", lambda: vector.equal("vec", "q"), "v = q", False)
_scalar("vec_f32_dot", lambda: vector.f32_dot("vec", "q"), f"list_sum([(f[i] * g[i])::DOUBLE {_ALL})")
_scalar("vec_f32_l2_squared", lambda: vector.f32_l2_squared("vec", "q"), f"list_sum([(f[i] - g[i])::DOUBLE * (f[i] - g[i])::DOUBLE {_ALL})")
_scalar("vec_u8_l2", lambda: vector.u8_l2(_bytes("vec"), _bytes("q")), f"list_distance({_A}, {_B})")
_scalar("vec_u8_dot", lambda: vector.u8_dot(_bytes("vec"), _bytes("q")), f"list_inner_product({_A}, {_B})")
_scalar("vec_f32_magnitude", lambda: vector.f32_magnitude("vec"), "sqrt(list_sum([(x * x)::DOUBLE for x in f]))")
_scalar("vec_f32_cosine", lambda: vector.f32_cosine("vec", "q"), f"list_sum([(f[i] * g[i])::DOUBLE {_ALL}) / (sqrt(list_sum([(x * x)::DOUBLE for x in f])) * sqrt(list_sum([(x * x)::DOUBLE for x in g])))")
_scalar("vec_u8_magnitude", lambda: vector.u8_magnitude(_bytes("vec")), f"sqrt(list_inner_product({_A}, {_A}))")
_scalar("vec_u8_cosine", lambda: vector.u8_cosine(_bytes("vec"), _bytes("q")), f"list_inner_product({_A}, {_B}) / (sqrt(list_inner_product({_A}, {_A})) * sqrt(list_inner_product({_B}, {_B})))")
_scalar("vec_is_empty", lambda: vector.is_empty("vec"), "len(v) = 0", False)
_scalar("vec_display_parts", lambda: F.size(F.split(F.btrim(vector.display("vec"), F.lit("[]")), ", ")).cast("long"), "len(v)::BIGINT", False)
_scalar("vec_content_hash_equal", lambda: vector.content_hash("vec") == vector.content_hash("q"), "v = q", False)
_vector("vec_f32_add", lambda: vector.f32_add("vec", "q"), f"[f[i] + g[i] {_ALL}")
_vector("vec_f32_subtract", lambda: vector.f32_subtract("vec", "q"), f"[f[i] - g[i] {_ALL}")
_vector("vec_u8_normalized", lambda: vector.u8_normalized(_bytes("vec")), f"[floor(x * (1 / sqrt(list_inner_product({_A}, {_A})))) for x in {_A}]")
_vector("vec_zeros", lambda: vector.zeros(4), "[0.0, 0.0, 0.0, 0.0]")
_vector("vec_normalized", lambda: vector.normalized(vector.scaled("vec", 3.0)), "[x * 3.0 * (1 / sqrt(list_inner_product([y * 3.0 for y in v], [y * 3.0 for y in v]))) for x in v]")
_vector("vec_scaled", lambda: vector.scaled("vec", 2.5), "[x * 2.5 for x in v]")
_vector("vec_divided", lambda: vector.divided("vec", 3.0), "[x / 3.0 for x in v]")
_vector("vec_absolute", lambda: vector.absolute("vec"), "[abs(x) for x in v]")
_vector("vec_add", lambda: vector.add("vec", "q"), f"[v[i] + q[i] {_ALL}")
_vector("vec_subtract", lambda: vector.subtract("vec", "q"), f"[v[i] - q[i] {_ALL}")
_vector("vec_quantized", lambda: vector.quantized("vec"), "[floor(greatest(0, least(1, x)) * 255) for x in v]")
_vector("vec_f32_scaled", lambda: vector.f32_scaled("vec", 2.5), "[x * 2.5::FLOAT for x in f]")
_vector("vec_u8_add", lambda: vector.u8_add(_bytes("vec"), _bytes("q")), f"[least(255, ({_A})[i] + ({_B})[i]) {_ALL}")
_vector("vec_u8_subtract", lambda: vector.u8_subtract(_bytes("vec"), _bytes("q")), f"[greatest(0, ({_A})[i] - ({_B})[i]) {_ALL}")
_vector("vec_u8_scaled", lambda: vector.u8_scaled(_bytes("vec"), 2.5), f"[floor(least(255, greatest(0, x * 2.5))) for x in {_A}]")


@query("vec_mean_centered", f"{E}, x AS (SELECT vec_id, unnest(range(len(v)))::INTEGER AS pos, unnest(v) AS x FROM e) SELECT vec_id, pos, round(x - avg(x) OVER (PARTITION BY pos), 6) + 0.0 AS value FROM x")
def vec_mean_centered(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = vector.mean_centered(embeddings(spark, sf_dir).select("vec_id", "vec"))
    return df.select("vec_id", F.posexplode("vec").alias("pos", "value")).select("vec_id", "pos", rounded("value").alias("value"))


# sign projections

HASHES, BANDS, DIM = 64, 16, 64


def _sign_sql(kind: str, hashes: int = HASHES, bands: int = BANDS) -> str:
    rows = ", ".join(f"({i}, {p.tolist()}::DOUBLE[])" for i, p in enumerate(hashing.planes(hashes, DIM, kind)))
    r = hashes // bands
    return f"""{E}, p(i, w) AS (VALUES {rows}),
s AS (SELECT vec_id, i, CASE WHEN list_inner_product(v, w) >= 0 THEN 1 ELSE 0 END AS bit FROM e, p),
b AS (SELECT vec_id, (i // {r})::INTEGER AS band, 'b' || (i // {r}) || '_' || string_agg(bit::VARCHAR, '' ORDER BY i) AS key FROM s GROUP BY vec_id, i // {r}),
g AS (SELECT vec_id, string_agg(bit::VARCHAR, '' ORDER BY i) AS sig FROM s GROUP BY vec_id)"""


def _sign_query_sql(kind: str, which: str, n: int, threshold: float, metadata: bool = False) -> str:
    return f"""{_sign_sql(kind)},
c AS (SELECT DISTINCT x.vec_id AS query_id, y.vec_id FROM b x JOIN b y USING (band, key) WHERE {which.format("x.vec_id")}),
r AS (SELECT query_id, c.vec_id, o.label, list_cosine_similarity(o.v, s.v) AS sim FROM c JOIN e o ON o.vec_id = c.vec_id JOIN e s ON s.vec_id = query_id WHERE o.v <> s.v),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM r WHERE sim >= {threshold})
SELECT query_id, vec_id, round(sim, 6) AS similarity, rank::INTEGER AS rank{", label::VARCHAR AS label" if metadata else ""} FROM t WHERE rank <= {n}"""


def _asked(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    return embeddings(spark, sf_dir).where(which.format("vec_id")).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("q"))


def _scored(df: DataFrame, *more) -> DataFrame:
    return df.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank", *more)


def _lsh(spark: SparkSession, sf_dir: str, threshold: float, kind: str = "uniform", store=None) -> LshIndex:
    index = LshIndex(spark, HASHES, BANDS, DIM, threshold, store, kind)
    index.insert(embeddings(spark, sf_dir))
    return index


@query("lsh_signature", f"{_sign_sql('uniform')} SELECT vec_id, i::INTEGER AS pos, bit::INTEGER AS bit FROM s")
def lsh_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select("vec_id", F.posexplode(hashing.sign_signature(F.col("vec"), hashing.planes(HASHES, DIM))).alias("pos", "bit"))


@query("lsh_signature_gaussian", f"{_sign_sql('gaussian')} SELECT vec_id, i::INTEGER AS pos, bit::INTEGER AS bit FROM s")
def lsh_signature_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select("vec_id", F.posexplode(hashing.sign_signature_expr(F.col("vec"), hashing.planes(HASHES, DIM, "gaussian"))).alias("pos", "bit"))


@query("lsh_bands", f"{_sign_sql('uniform')} SELECT vec_id, band, key FROM b")
def lsh_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig = hashing.sign_signature(F.col("vec"), hashing.planes(HASHES, DIM))
    return embeddings(spark, sf_dir).select("vec_id", sig.alias("sig")).select("vec_id", F.posexplode(hashing.sign_bands(F.col("sig"), BANDS, HASHES // BANDS)).alias("band", "key"))


@query("lsh_query", _sign_query_sql("uniform", ALL, 20, 0.1))
def lsh_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(_lsh(spark, sf_dir, 0.1).query(_asked(spark, sf_dir, ALL), 20))


@query("lsh_query_metadata", _sign_query_sql("uniform", ALL, 20, 0.1, True))
def lsh_query_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(_lsh(spark, sf_dir, 0.1).query(_asked(spark, sf_dir, ALL), 20, metadata=True), F.col("metadata")["label"].alias("label"))


@query("lsh_query_batch", _sign_query_sql("gaussian", ALL, 5, 0.2))
def lsh_query_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(_lsh(spark, sf_dir, 0.2, "gaussian").query(_asked(spark, sf_dir, ALL), 5))


@query("lsh_query_reopened", _sign_query_sql("gaussian", ALL, 5, 0.2, True))
def lsh_query_reopened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three inserts, each a part of its own, the last one known vectors with other metadata that then give way to the first; read from a second handle."""
    store = ParquetStore(spark, mode="temporary")
    index = LshIndex(spark, HASHES, BANDS, DIM, 0.2, store, "gaussian")
    e = embeddings(spark, sf_dir)
    index.insert(e.where("vec_id % 2 = 0").drop("metadata"))
    index.insert(e.where("vec_id % 2 = 1").withColumn("metadata", F.create_map(F.lit("label"), F.lit("old"))))
    index.insert(e.select((F.col("vec_id") + 100000).alias("vec_id"), "vec", "metadata"))
    again = LshIndex(spark, HASHES, BANDS, DIM, 0.2, ParquetStore(spark, store.path, "readonly"), "gaussian")
    return _scored(again.query(_asked(spark, sf_dir, ALL), 5, metadata=True), F.col("metadata")["label"].alias("label"))


@query("lsh_query_persistent", _sign_query_sql("gaussian", ALL, 5, 0.2))
def lsh_query_persistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inserts, a compaction, and a read-only reopening in between."""
    store = ParquetStore(spark, mode="temporary")
    index = LshIndex(spark, HASHES, BANDS, DIM, 0.2, store, "gaussian")
    e = embeddings(spark, sf_dir)
    index.insert(e.where("vec_id % 2 = 0"))
    index.insert(e)
    index.compact()
    again = LshIndex(spark, HASHES, BANDS, DIM, 0.2, ParquetStore(spark, store.path, "readonly"), "gaussian")
    return _scored(again.query(_asked(spark, sf_dir, ALL), 5))


@query("lsh_dissimilar", f"{_sign_sql('uniform')}, r AS (SELECT s.vec_id AS query_id, o.vec_id, o.label, list_cosine_similarity(o.v, s.v) AS sim FROM e s JOIN g a ON a.vec_id = s.vec_id, e o JOIN g b ON b.vec_id = o.vec_id WHERE s.vec_id % 20 = 0 AND a.sig <> b.sig), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim, vec_id) AS rank FROM r) SELECT query_id, vec_id, round(sim, 6) AS similarity, label::VARCHAR AS label FROM t WHERE rank <= 300")
def lsh_dissimilar(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _lsh(spark, sf_dir, 0.1).query_dissimilar(_asked(spark, sf_dir, ALL), 300)
    return out.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), F.col("metadata")["label"].alias("label"))


@query("sample_excluding", f"{_sign_sql('gaussian')} SELECT x.vec_id AS query_id, y.vec_id FROM g x JOIN g y ON x.sig <> y.sig WHERE x.vec_id % 20 = 0")
def sample_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lsh(spark, sf_dir, 0.1, "gaussian").sample_excluding(_asked(spark, sf_dir, ALL)).select("query_id", "vec_id")


@query("bucket_sizes", f"{_sign_sql('uniform')} SELECT band, key, count(*)::BIGINT AS n FROM b GROUP BY band, key")
def bucket_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lsh(spark, sf_dir, 0.1).buckets().groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"))


@query("bucket_read", f"{_sign_sql('uniform')} SELECT b.vec_id, label::VARCHAR AS label FROM b JOIN e USING (vec_id) WHERE key = 'b0_1111'")
def bucket_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lsh(spark, sf_dir, 0.1).bucket("b0_1111").select("vec_id", F.col("metadata")["label"].alias("label"))


@query("load_by_ids", f"{E} SELECT vec_id, label::VARCHAR AS label, round(list_sum(v), 6) AS total FROM e WHERE vec_id IN (3, 5, 8)")
def load_by_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.createDataFrame([(3,), (5,), (8,), (-1,)], "vec_id long")
    return _lsh(spark, sf_dir, 0.1).get(ids).select("vec_id", F.col("metadata")["label"].alias("label"), F.round(vector.total("vec"), 6).alias("total"))


# inserts

_TWICE = f"{E}, x AS (SELECT vec_id, v, label::VARCHAR AS m, 0 AS age FROM e UNION ALL SELECT vec_id + 100000, v, CASE WHEN vec_id % 2 = 0 THEN 'again' END, 1 FROM e WHERE vec_id % 3 = 0)"


@query("insert_dedupe", f"{_TWICE} SELECT min(vec_id) AS vec_id, arg_max(m, age) FILTER (m IS NOT NULL) AS label FROM x GROUP BY v")
def insert_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second insert of known vectors: ids stay, metadata are overwritten only where given."""
    e = embeddings(spark, sf_dir)
    again = e.where("vec_id % 3 = 0").select((F.col("vec_id") + 100000).alias("vec_id"), "vec", F.when(F.col("vec_id") % 2 == 0, F.create_map(F.lit("label"), F.lit("again"))).alias("metadata"))
    return upsert(upsert(None, e), again).select("vec_id", F.col("metadata")["label"].alias("label"))


@query("stream_ingest", f"{E} SELECT vec_id, label::VARCHAR AS label FROM e")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream into a persistent MinHash index."""
    store = ParquetStore(spark, mode="temporary")
    index = MinHashIndex(spark, 8, 4, 0.5, store)
    schema = spark.read.parquet(f"{sf_dir}/embeddings.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/embeddings.parque[t]")  # a file or a folder of files: a stream's path is a folder or, as here, a pattern
    stream = stream.select("vec_id", F.col("embedding").alias("vec"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))
    ingest(stream, index, f"{store.path}-checkpoint-{uuid.uuid4().hex}").awaitTermination()
    return index.vectors().select("vec_id", F.col("metadata")["label"].alias("label"))


# MinHash over the parts of each supplier

_MH, _MB = 64, 32
_SETS = f"""WITH x AS (SELECT DISTINCT l_suppkey AS vec_id, l_partkey AS e FROM lineitem),
h AS (SELECT vec_id, i::INTEGER AS i, min((((e::UHUGEINT + (i::UHUGEINT * {hashing.SEED_STEP}::UHUGEINT) % 18446744073709551616::UHUGEINT) % 18446744073709551616::UHUGEINT) * {hashing.MULTIPLIER}::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h FROM x, range({_MH}) t(i) GROUP BY vec_id, i),
b AS (SELECT vec_id, (i // 2)::INTEGER AS band, 'm' || (i // 2) || '_' || string_agg(lower(lpad(to_hex(h::UBIGINT), 16, '0')), '' ORDER BY i) AS key FROM h GROUP BY vec_id, i // 2)"""
_AGREE = f"(SELECT x.vec_id AS query_id, y.vec_id, sum(CASE WHEN x.h = y.h THEN 1 ELSE 0 END) / {_MH}.0 AS sim FROM h x JOIN h y USING (i) WHERE x.vec_id % 20 = 0 GROUP BY ALL)"


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("vec_id"), F.col("l_partkey").cast("double").alias("e"))
    return rows.groupBy("vec_id").agg(F.sort_array(F.collect_set("e")).alias("vec")).withColumn("metadata", F.create_map(F.lit("id"), F.col("vec_id").cast("string")))


def _minhash(spark: SparkSession, sf_dir: str) -> tuple[MinHashIndex, DataFrame]:
    index = MinHashIndex(spark, _MH, _MB, 0.1)
    sets = _sets(spark, sf_dir).persist()
    index.insert(sets)
    asked = sets.where(ALL.format("vec_id")).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("q"))
    return index, asked


@query("minhash_signature", f"{_SETS} SELECT vec_id, i AS pos, (h::HUGEINT - CASE WHEN h >= 9223372036854775808 THEN 18446744073709551616::HUGEINT ELSE 0::HUGEINT END)::BIGINT AS slot FROM h")
def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sets(spark, sf_dir).select("vec_id", F.posexplode(hashing.minhash_signature(hashing.as_set(F.col("vec")), _MH)).alias("pos", "slot"))


@query("minhash_bands", f"{_SETS} SELECT vec_id, band, key FROM b")
def minhash_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash(spark, sf_dir)[0].buckets().select("vec_id", "band", "key")


@query("minhash_estimated_jaccard", f"{_SETS} SELECT query_id, vec_id, round(sim, 6)::DOUBLE AS similarity FROM {_AGREE}")
def minhash_estimated_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig = _sets(spark, sf_dir).select("vec_id", hashing.minhash_signature(hashing.as_set(F.col("vec")), _MH).alias("sig"))
    asked = sig.where(ALL.format("vec_id")).select(F.col("vec_id").alias("query_id"), F.col("sig").alias("query_sig"))
    return sig.crossJoin(asked).select("query_id", "vec_id", F.round(hashing.agreement(F.col("sig"), F.col("query_sig"), _MH), 6).alias("similarity"))


_MINHASH = f"""{_SETS}, c AS (SELECT DISTINCT x.vec_id AS query_id, y.vec_id FROM b x JOIN b y USING (band, key) WHERE x.vec_id % 20 = 0 AND x.vec_id <> y.vec_id),
t AS (SELECT query_id, vec_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rank FROM c JOIN {_AGREE} USING (query_id, vec_id) WHERE sim >= 0.1)"""


@query("minhash_query", f"{_MINHASH} SELECT query_id, vec_id, round(sim, 6)::DOUBLE AS similarity, rank::INTEGER AS rank FROM t WHERE rank <= 10")
def minhash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, asked = _minhash(spark, sf_dir)
    return _scored(index.query(asked, 10))


@query("minhash_query_metadata", f"{_MINHASH} SELECT query_id, vec_id, round(sim, 6)::DOUBLE AS similarity, rank::INTEGER AS rank, vec_id::VARCHAR AS id FROM t WHERE rank <= 10")
def minhash_query_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, asked = _minhash(spark, sf_dir)
    return _scored(index.query(asked, 10, metadata=True), F.col("metadata")["id"].alias("id"))


@query("minhash_dissimilar", f"{_SETS}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim, vec_id) AS rank FROM {_AGREE} WHERE sim < 1) SELECT query_id, vec_id, round(sim, 6)::DOUBLE AS similarity FROM t WHERE rank <= 200")
def minhash_dissimilar(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, asked = _minhash(spark, sf_dir)
    return index.query_dissimilar(asked, 200).select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"))


# graph

_NEAR = f"""{E}, r AS (SELECT s.vec_id AS query_id, o.vec_id, o.label, list_distance(o.v, s.v) AS l2, list_cosine_similarity(o.v, s.v) AS sim FROM e o, e s WHERE s.vec_id % 20 = 0 AND o.v <> s.v AND list_cosine_similarity(o.v, s.v) >= 0.1 {{}}),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {{}} l2, vec_id) AS rank FROM r)
SELECT query_id, vec_id, round(l2, 6) AS l2, row_number() OVER (PARTITION BY query_id ORDER BY l2, vec_id)::INTEGER AS rank{{}} FROM t WHERE rank <= 10"""


def _near(df: DataFrame, *more) -> DataFrame:
    return df.select("query_id", "vec_id", F.round("l2", 6).alias("l2"), "rank", *more)


def _graph(spark: SparkSession, sf_dir: str) -> GraphIndex:
    index = GraphIndex(spark, 0.1)
    index.insert(embeddings(spark, sf_dir))
    return index


@query("graph_query", _NEAR.format("", "", ""))
def graph_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(_graph(spark, sf_dir).query(_asked(spark, sf_dir, ALL), 10))


@query("graph_query_metadata", _NEAR.format("", "", ", label::VARCHAR AS label"))
def graph_query_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(_graph(spark, sf_dir).query(_asked(spark, sf_dir, ALL), 10, metadata=True), F.col("metadata")["label"].alias("label"))


@query("graph_walk", _NEAR.format("", "o0,", "").replace("o.label,", "o.label, o.vec_id <> 0 AS o0,"))
def graph_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With as many links as vectors the graph is complete, and the walk has its closed form over the whole table."""
    e = embeddings(spark, sf_dir)
    index = GraphIndex(spark, 0.1, max(1, e.count()))
    index.insert(e)
    return _near(index.query(_asked(spark, sf_dir, ALL), 10, walk=True))


@query("graph_iterate", f"{E} SELECT row_number() OVER (ORDER BY vec_id) - 1 AS node_id, vec_id, label::VARCHAR AS label FROM e")
def graph_iterate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).nodes().select("node_id", "vec_id", F.col("metadata")["label"].alias("label"))


@query("graph_count", "SELECT count(DISTINCT embedding)::BIGINT AS n FROM embeddings")
def graph_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir).nodes().agg(F.count(F.lit(1)).alias("n"))


@query("graph_shards")
def graph_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks over real graphs; their neighbour lists have no SQL form."""
    return search_shards(build_shards(embeddings(spark, sf_dir)), _asked(spark, sf_dir, ALL), 10, 0.1, beam=4)


@query("graph_walk_all")
def graph_walk_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walks over the stored graphs of an index that was filled in two inserts; no SQL form."""
    store = ParquetStore(spark, mode="temporary")
    index, e = GraphIndex(spark, 0.1, store=store, links=True), embeddings(spark, sf_dir)
    index.insert(e.where("vec_id % 2 = 0"))
    index.insert(e)
    again = GraphIndex(spark, 0.1, store=ParquetStore(spark, store.path, "readonly"))
    return _near(again.query(_asked(spark, sf_dir, ALL), 10, walk=True))


# k-means with the first two vectors as centroids

_KM = f"""{E}, c AS (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::INTEGER AS i, v AS c FROM e WHERE vec_id IN (0, 1)),
d AS (SELECT vec_id, v, i, list_distance(v, c) AS d FROM e, c),
a AS (SELECT vec_id, any_value(v) AS v, arg_min(i, (d, i)) AS cluster, min(d) AS d FROM d GROUP BY vec_id)"""


def _centroids(spark: SparkSession, sf_dir: str) -> np.ndarray:
    return np.array([r[0] for r in embeddings(spark, sf_dir).where("vec_id in (0, 1)").orderBy("vec_id").select("vec").collect()])


@query("kmeans_assign", f"{_KM} SELECT vec_id, cluster, round(d, 6) AS distance FROM a")
def kmeans_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.assign(embeddings(spark, sf_dir), _centroids(spark, sf_dir)).select("vec_id", "cluster", F.round("distance", 6).alias("distance"))


@query("kmeans_assign_native", f"{_KM} SELECT vec_id, cluster FROM a")
def kmeans_assign_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select("vec_id", kmeans.nearest_expr(F.col("vec"), _centroids(spark, sf_dir)).alias("cluster"))


@query("kmeans_step", f"{_KM}, x AS (SELECT cluster, unnest(range(len(v)))::INTEGER AS pos, unnest(v) AS x FROM a) SELECT cluster, pos, round(avg(x), 6) + 0.0 AS value FROM x GROUP BY cluster, pos")
def kmeans_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = kmeans.cluster_sums(embeddings(spark, sf_dir), _centroids(spark, sf_dir))
    return sums.select("cluster", "pos", rounded(F.col("total") / F.col("n")).alias("value"))


@query("kmeans_dispersion", f"{_KM} SELECT cluster, count(*)::BIGINT AS n, round(sum(d), 5) AS inertia, round(avg(d * d), 6) AS spread FROM a GROUP BY cluster")
def kmeans_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = kmeans.cluster_sums(embeddings(spark, sf_dir), _centroids(spark, sf_dir)).where("pos = 0")
    return sums.select("cluster", "n", F.round("inertia", 5).alias("inertia"), F.round(F.col("squares") / F.col("n"), 6).alias("spread"))


@query("kmeans_cluster_sizes", f"{_KM} SELECT cluster, count(*)::BIGINT AS n FROM a GROUP BY cluster")
def kmeans_cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.assign(embeddings(spark, sf_dir), _centroids(spark, sf_dir)).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("kmeans_should_grow", f"{_KM}, s AS (SELECT cluster, count(*) AS n, avg(d * d) AS m FROM a GROUP BY cluster) SELECT sum(n) >= 12 AND min(n) >= 3 AND (max(n) / (sum(n) // 2) > 1.5 OR max(m) > 100 OR max(m) / avg(m) > 1.3) AS grow FROM s")
def kmeans_should_grow(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = kmeans.step(embeddings(spark, sf_dir), _centroids(spark, sf_dir))[1]
    return spark.createDataFrame([(bool(kmeans.should_grow(stats, 2)),)], "grow boolean")


@query("kmeans_query", f"{_KM}, t AS (SELECT vec_id, v, cluster, row_number() OVER (PARTITION BY cluster ORDER BY vec_id) AS rank FROM a) SELECT s.vec_id AS query_id, t.vec_id, t.rank::INTEGER AS rank FROM a s JOIN t USING (cluster) WHERE s.vec_id % 20 = 0 AND t.rank <= 10 AND t.v <> s.v")
def kmeans_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = kmeans.KMeans(spark, DIM)
    model.centroids = list(_centroids(spark, sf_dir))
    model.add(embeddings(spark, sf_dir).drop("metadata"))
    return model.query(_asked(spark, sf_dir, ALL), 10).select("query_id", "vec_id", "rank")


@query("kmeans_fit")
def kmeans_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five steps with growth; the number of centroids depends on the data, so there is no SQL form."""
    model = kmeans.KMeans(spark, DIM)
    model.add(embeddings(spark, sf_dir).drop("metadata"))
    model.fit(5)
    return model.results().select("vec_id", "cluster")


# the handle over all backends

def _answers(db: VectorDatabase, spark: SparkSession, sf_dir: str, e: DataFrame, n: int, *more) -> DataFrame:
    """Insert with metadata where that is offered, then ask for the query set."""
    if "insert_with_metadata" in db.can:
        db.insert_with_metadata(e)
        return db.query_with_metadata(_asked(spark, sf_dir, ALL), n).select("query_id", "vec_id", "rank", F.col("metadata")["label"].alias("label"))
    db.insert(e)
    return db.query(_asked(spark, sf_dir, ALL), n).select("query_id", "vec_id", "rank")


_GRAPH = _NEAR.format("", "", "{}").replace("round(l2, 6) AS l2, ", "")


@query("db_lsh", f"SELECT query_id, vec_id, rank, label FROM ({_sign_query_sql('uniform', ALL, 5, 0.1, True)})")
def db_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(VectorDatabase.with_lsh(spark, HASHES, BANDS, DIM, 0.1), spark, sf_dir, embeddings(spark, sf_dir), 5)


@query("db_temporary_lsh", f"SELECT query_id, vec_id, rank, label FROM ({_sign_query_sql('gaussian', ALL, 5, 0.1, True)})")
def db_temporary_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    with VectorDatabase.with_temporary_lsh(spark, HASHES, BANDS, DIM, 0.1, planes="gaussian") as db:
        return materialized(_answers(db, spark, sf_dir, embeddings(spark, sf_dir), 5))


@query("db_persistent_lsh", f"SELECT query_id, vec_id, rank, label FROM ({_sign_query_sql('gaussian', ALL, 5, 0.1, True)})")
def db_persistent_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filled through one handle, compacted, and asked through a read-only one."""
    path = shared_path(spark, "db")
    db = VectorDatabase.with_persistent_lsh(spark, HASHES, BANDS, DIM, 0.1, path, planes="gaussian")
    db.insert_with_metadata(embeddings(spark, sf_dir))
    db.compact()
    again = VectorDatabase.with_persistent_lsh(spark, HASHES, BANDS, DIM, 0.1, path, readonly=True, planes="gaussian")
    return again.query_with_metadata(_asked(spark, sf_dir, ALL), 5).select("query_id", "vec_id", "rank", F.col("metadata")["label"].alias("label"))


@query("db_minhash", f"{_MINHASH} SELECT query_id, vec_id, rank::INTEGER AS rank, vec_id::VARCHAR AS id FROM t WHERE rank <= 10")
def db_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, sets = VectorDatabase.with_min_hash(spark, _MH, _MB, 0.1), _sets(spark, sf_dir)
    db.insert_with_metadata(sets)
    asked = sets.where(ALL.format("vec_id")).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("q"))
    return db.query_with_metadata(asked, 10).select("query_id", "vec_id", "rank", F.col("metadata")["id"].alias("id"))


@query("db_persistent_minhash", f"{_SETS}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim, vec_id) AS rank FROM {_AGREE} WHERE sim < 1) SELECT query_id, vec_id, rank::INTEGER AS rank, vec_id::VARCHAR AS id FROM t WHERE rank <= 200")
def db_persistent_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least similar, from a stored index."""
    db, sets = VectorDatabase.with_persistent_min_hash(spark, _MH, _MB, 0.1, shared_path(spark, "db")), _sets(spark, sf_dir)
    db.insert_with_metadata(sets)
    asked = sets.where(ALL.format("vec_id")).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("q"))
    return db.query_dissimilar_with_metadata(asked, 200).select("query_id", "vec_id", "rank", F.col("metadata")["id"].alias("id"))


@query("db_graph", _GRAPH.format(""))
def db_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(VectorDatabase.with_graph(spark, 0.1), spark, sf_dir, embeddings(spark, sf_dir), 10)


@query("db_persistent_graph", _GRAPH.format(", label::VARCHAR AS label"))
def db_persistent_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(VectorDatabase.with_persistent_graph(spark, 64, 0.1, shared_path(spark, "db")), spark, sf_dir, embeddings(spark, sf_dir), 10)


@query("db_capabilities", """SELECT * FROM (VALUES
  ('kmeans', 'insert'), ('kmeans', 'query'), ('minhash', 'insert'), ('minhash', 'insert_with_metadata'), ('minhash', 'query'), ('minhash', 'query_with_metadata'), ('minhash', 'query_dissimilar'),
  ('lsh', 'insert'), ('lsh', 'insert_with_metadata'), ('lsh', 'query'), ('lsh', 'query_with_metadata'), ('lsh', 'query_dissimilar'),
  ('lsh (temporary)', 'insert'), ('lsh (temporary)', 'insert_with_metadata'), ('lsh (temporary)', 'query'), ('lsh (temporary)', 'query_with_metadata'), ('lsh (temporary)', 'query_dissimilar'), ('lsh (temporary)', 'compact'),
  ('graph', 'insert'), ('graph', 'query'), ('graph', 'iterate')) t(backend, operation)""")
def db_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = [VectorDatabase.with_kmeans(spark, 4), VectorDatabase.with_min_hash(spark, 4, 2, 0.5), VectorDatabase.with_lsh(spark, 4, 2, 4, 0.5), VectorDatabase.with_temporary_lsh(spark, 4, 2, 4, 0.5), VectorDatabase.with_graph(spark, 0.5)]
    return spark.createDataFrame([(db.name, what) for db in made for what in sorted(db.can)], "backend string, operation string")


_STEPS = 3


@query("kmeans_steps", _KM.replace("SELECT vec_id, v, i, list_distance(v, c) AS d FROM e, c", "SELECT vec_id, v, i, list_distance(v, c) AS d FROM e, c").split("d AS (")[0].rstrip().rstrip(",") + "".join(
    f""",
d{k} AS (SELECT vec_id, v, arg_min(i, (d, i)) AS cluster FROM (SELECT vec_id, v, i, list_distance(v, c) AS d FROM e, {"c" if not k else f"c{k}"}) GROUP BY vec_id, v),
c{k + 1} AS (SELECT cluster AS i, list(m ORDER BY pos) AS c FROM (SELECT cluster, pos, avg(x) AS m FROM (SELECT cluster, unnest(range(len(v))) AS pos, unnest(v) AS x FROM d{k}) GROUP BY cluster, pos) GROUP BY cluster)"""
    for k in range(_STEPS)
) + f" SELECT i::INTEGER AS cluster, unnest(range(len(c)))::INTEGER AS pos, round(unnest(c), 6) + 0.0 AS value FROM c{_STEPS}")
def kmeans_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three steps from two given centroids; growth, which depends on random ones, is left to ``kmeans_fit``."""
    points, centroids = embeddings(spark, sf_dir), _centroids(spark, sf_dir)
    for _ in range(_STEPS):
        centroids, _ = kmeans.step(points, centroids)
    return spark.createDataFrame([(k, i, round(float(x), 6) + 0.0) for k, c in enumerate(centroids) for i, x in enumerate(c)], "cluster int, pos int, value double")
