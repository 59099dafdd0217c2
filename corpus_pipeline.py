"""A corpus pipeline of five stages; each reads the table that the one before wrote.

All stages but the last return the columns of their ``docs``. An empty table gives an empty table in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiverlake.llm import bpe, decontaminate, line_dedup, quality, simhash
from quiverlake.llm.common import materialize, prepare, remove
from quiverlake.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go, each by its own text: repeated rows share their fate, rows that share a doc_id or have none do not. Null and empty texts are judged as empty."""
    prepare(spark)
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; ``n_chars`` follows the text. All rows stay: null texts as empty ones, rows with one doc_id as one document, null doc_ids as the last one."""
    prepare(spark)
    out = line_dedup.dedup_lines(docs)
    return out.select(*[F.char_length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else c for c in docs.columns])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest doc_id stays, with all its rows. Null and empty texts are a group of their own; rows with a null doc_id stay."""
    prepare(spark)
    gone = simhash.simhash_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, each by its own text; null and empty texts hold none."""
    prepare(spark)
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each row its text's token ids, the digest of what they decode to, and whether that is the text. Null and empty texts have no tokens; null and repeated doc_ids stay."""
    prepare(spark)
    return bpe.round_trip(docs, tokenizer_path()).select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"), "intact")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", bpe_stage),
]

#: Fingerprints, pseudo-labels and the tokenizer have no SQL form; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, was = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs, path = materialize(stage(spark, docs, sf_dir), "stage")
        if was:
            remove(spark, was)
        was = path
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: ``run`` with its integer columns and digests."""
    return run(spark, sf_dir).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256", "intact")
