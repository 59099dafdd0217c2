"""Line dedup: levelled sorted runs of line hashes, compacted periodically.

The corpus comes in batches of rising doc_id. A batch's line keys are reduced to one row per key with the
smallest document that has it; these are merge-anti-joined with every run there is, and what is left (keys never
seen before) becomes a new sorted run. When a level holds ``fanout`` runs they are merged into one of the next
level. Runs are bucketed and sorted by key, so a later batch alone is shuffled, not the runs.

Every key lives in exactly one run, with its owner: the smallest doc_id that holds it. A line goes if its key has another
owner. That test joins on key and document together, so a line that a third of all documents share is no hot key.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, lower_ascii, materialize, partitions, remove, scratch_path, text_of

_LAST = 9223372036854775807


@contextmanager
def _in_order(spark: SparkSession):
    """Let Spark use that the files of a run are sorted: by default it sorts bucketed tables again for every join."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was) if was is not None else spark.conf.unset(name)


class LineRuns:
    """The store of runs. ``add`` takes a batch of ``(h1, h2, owner)`` whose owners are larger than those of earlier batches."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout, self.levels, self.buckets = spark, fanout, [[]], partitions(spark)

    def _write(self, df: DataFrame) -> tuple[str, str]:
        path, name = scratch_path(self.spark, "run"), f"quiverlake_run_{uuid.uuid4().hex}"
        df.repartition(self.buckets, "h1", "h2").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        return name, path

    def runs(self) -> list[str]:
        return [name for level in self.levels for name, _ in level]

    def add(self, firsts: DataFrame) -> None:
        """Anti-join the batch with every run and add the rest as a run of level 0; compact full levels."""
        with _in_order(self.spark):
            for run in self.runs():
                firsts = firsts.join(self.spark.table(run).select("h1", "h2"), ["h1", "h2"], "left_anti")
            self.levels[0].append(self._write(firsts))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(self._union([name for name, _ in full])))
            self._drop(full)
            level += 1

    def _union(self, names: list[str]) -> DataFrame:
        out = self.spark.table(names[0])
        for name in names[1:]:
            out = out.unionByName(self.spark.table(name))
        return out

    def owners(self) -> DataFrame:
        """All keys with their owners."""
        return self._union(self.runs())

    def _drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, path)

    def close(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = [[]]


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 6, fanout: int = 3) -> DataFrame:
    r"""Drop every line whose key an earlier document holds; keys are stripped and lower-cased (ASCII), of ``min_chars`` code points at least.

    Returns the columns of ``docs`` with ``text`` replaced by the lines that stay, joined by ``\n``, and
    ``n_lines``, ``n_dropped`` (long); columns of those two names in ``docs`` are replaced, others kept.

    Null or empty text: one empty line, kept. A document keeps all repeats of a line that it owns. Rows with one doc_id are one
    document; each row gives a row. A null doc_id comes after all others, and all such rows are one document.
    An empty table gives an empty table.
    """
    spark = docs.sparkSession
    text, owner, mark = text_of(), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)), F.xxhash64(text_of())
    cuts = sorted({float(x) for x in docs.select(owner.cast("double").alias("d")).approxQuantile("d", [i / batches for i in range(1, batches)] or [1.0], 0.01)})
    batch = F.lit(0)
    for c in cuts:
        batch = batch + (F.col("owner") > F.lit(c)).cast("int")
    key = lower_ascii(F.btrim("line", F.lit(SPACE)))
    lines = (
        docs.select(owner.alias("owner"), mark.alias("mark"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
        .select("owner", "mark", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("owner", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), batch.alias("batch"))
    )
    lines, lines_path = materialize(lines, "lines", "batch")
    store = LineRuns(spark, fanout)
    try:
        for b in range(len(cuts) + 1):
            store.add(lines.where(F.col("batch") == b).groupBy("h1", "h2").agg(F.min("owner").alias("owner")))
        dropped = lines.join(store.owners(), ["h1", "h2", "owner"], "left_anti").groupBy("owner", "mark").agg(F.collect_set("pos").alias("gone"))
        dropped, _ = materialize(dropped, "dropped")  # stays, as the result reads it
    finally:
        store.close()
        remove(spark, lines_path)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "text")]
    rows = docs.select(F.struct(*names).alias("row"), text.alias("text"), owner.alias("owner"), mark.alias("mark"))
    rows = rows.join(dropped, ["owner", "mark"], "left").withColumn("kept", F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without(F.col("text"), F.col("gone"))))
    out = {c: F.col(f"row.`{c}`") for c in names} | {"text": F.col("kept")}
    return rows.select(*[out[c].alias(c) for c in docs.columns if c in out], F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"))


def _without(text, gone):
    @F.pandas_udf("string")
    def without(texts: pd.Series, gone: pd.Series) -> pd.Series:
        def one(text, gone):
            if gone is None:
                return text
            gone = set(gone)
            return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)

        return pd.Series([one(t, g) for t, g in zip(texts, gone, strict=True)])

    return without(text, gone)
