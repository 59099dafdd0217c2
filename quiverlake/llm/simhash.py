"""SimHash near-dedup: a byte-position inverted index with count filtering.

Fingerprints within 3 bits differ in at most 3 of 8 bytes, so they share at least 5 bytes at their positions. Postings of single
bytes would be as long as the table over 256, so the index keeps intersected postings: a row per fingerprint for each three positions inside a
half (8 in all). Any 5 shared positions hold 3 in one half, so every such pair meets. Each pair that meets is tallied (shared bytes over
all 8 positions), kept at 5 or more, and verified by its differing bits.

Equal fingerprints are one row of the index, whatever the number of documents. A posting longer than ``chunk`` is dealt into
pairs of chunks, so a task holds two chunks at most; each group gives back a spanning forest of its links and not all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import materialize, partitions, remove
from .components import connected_components

_SEED = 42
_SLICE = 1 << 16
_SMALL = 12

#: Three of four bytes of either half of a fingerprint.
MASKS = [sum(0xFF << (8 * p) for p in range(half, half + 4) if p != out) for half in (0, 4) for out in range(half, half + 4)]


def fingerprint(text: bytes, k: int = 3) -> int:
    """64 majority bits over XXH64 (seed 42) of all ``k``-word shingles, repeats included; fewer words: the whole sequence; none: zero."""
    words = text.lower().split()
    if not words:
        return 0
    k = min(k, len(words))
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts, ends = (ends - sizes)[: len(words) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist()
    ones, n, digest = np.zeros(64, np.int64), len(starts), xxhash.xxh64_intdigest
    for at in range(0, n, _SLICE):
        h = np.array([digest(line[s:e], _SEED) for s, e in zip(starts[at : at + _SLICE], ends[at : at + _SLICE], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = 3) -> DataFrame:
    """``(doc_id, fp)`` for each row of ``docs``; ``fp`` holds the 64 bits as a signed long. Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in tv.slices(b, "text", 1 << 22):
                texts = part.column("text").cast(pa.binary()).to_pylist()
                fp = np.array([fingerprint(t or b"", k) for t in texts], np.uint64).view(np.int64)
                yield pa.record_batch([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])
        tv.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _linked(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """The count filter, then the verification."""
    x = np.ascontiguousarray(a ^ b)
    near = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - bits
    near[near] = np.bitwise_count(x[near]) <= bits
    return near


def _forest(fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest, by a breadth-first walk that compares each fingerprint once with those not yet reached."""
    left, out = np.arange(len(fp)), ([], [])
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            hit = _linked(fp[left], np.broadcast_to(fp[at], len(left)), bits)
            got = left[hit]
            if len(got):
                out[0].append(np.full(len(got), at))
                out[1].append(got)
                front.extend(got.tolist())
                left = left[~hit]
    return (np.concatenate(out[0]), np.concatenate(out[1])) if out[0] else (np.zeros(0, int), np.zeros(0, int))


def _links(bits: int):
    def groups(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        fp, rep = table.column("fp").to_numpy().view(np.uint64), table.column("rep").to_numpy()
        same = np.ones(len(fp) - 1, bool)
        for c in ("slot", "part", "a", "b"):
            x = table.column(c).to_numpy()
            same &= x[1:] == x[:-1]
        starts = np.concatenate(([0], np.flatnonzero(~same) + 1))
        sizes = np.diff(np.append(starts, len(fp)))
        small, src, dst = np.repeat(np.where(sizes <= _SMALL, np.arange(len(sizes)), -1), sizes), [], []
        for shift in range(1, min(_SMALL, int(sizes.max(initial=1)))):
            i = np.flatnonzero((small[shift:] == small[:-shift]) & (small[shift:] >= 0))
            i = i[_linked(fp[i], fp[i + shift], bits)] if len(i) else i
            src.append(rep[i])
            dst.append(rep[i + shift])
        for g in np.flatnonzero(sizes > _SMALL):
            own = slice(starts[g], starts[g] + sizes[g])
            s, d = _forest(fp[own], bits)
            src.append(rep[own][s])
            dst.append(rep[own][d])
        return (np.concatenate(src), np.concatenate(dst)) if src else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(tables: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(tables)
            if t.num_rows > 1:
                s, d = groups(t.combine_chunks())
                yield pa.record_batch([pa.array(s), pa.array(d)], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(c).to_numpy() for c in ("slot", "part", "a", "b")]
            last = np.ones(b.num_rows, bool)
            for x in keys:
                last &= x == x[-1]
            cut = b.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
            begun = held and any(held[-1].column(c)[held[-1].num_rows - 1].as_py() != x[0] for c, x in zip(("slot", "part", "a", "b"), keys, strict=True))
            if begun:
                yield from flush(held)
                held = []
            if cut:
                yield from flush([*held, b.slice(0, cut)])
                held = []
            held.append(b.slice(cut))
        if held:
            yield from flush(held)

    return run


def fingerprint_links(classes: DataFrame, bits: int = 3, chunk: int = 2048) -> DataFrame:
    """``classes(fp, rep)`` with distinct ``fp`` and ``rep`` -> links ``(a, b)`` between reps; their components equal those of all pairs within ``bits`` (3 at most)."""
    if not 0 <= bits <= 3:
        raise ValueError("bits must be from 0 to 3")
    spark = classes.sparkSession
    index = classes.select("fp", "rep", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in MASKS])).alias("slot", "part"))
    lists = index.groupBy("slot", "part").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("slot", "part", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    index = index.join(lists, ["slot", "part"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    index = index.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    index = index.select("fp", "rep", "slot", "part", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    key = ["slot", "part", "a", "b"]
    return index.repartition(partitions(spark), *key).sortWithinPartitions(*key).mapInArrow(_links(bits), "a long, b long")


def simhash_components(docs: DataFrame, bits: int = 3, k: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``docs``: 16 hex digits, and the smallest doc_id reachable over links of ``bits`` or fewer differing bits.

    Null and empty texts have fingerprint zero and link like any other. Rows with one doc_id are one node with several
    fingerprints, all linked. A row with a null doc_id takes no part in linking: its component_id is null. Other columns of
    ``docs`` are not read. An empty table gives an empty table.
    """
    prints, prints_path = materialize(fingerprints(docs, k), "prints")
    known = prints.where("doc_id is not null")
    classes = known.groupBy("fp").agg(F.min("doc_id").alias("node"))
    shared = known.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id")
    repeated = known.join(shared, "doc_id").join(classes, "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    # a doc_id may be the smallest of several fingerprints; the links then run between fingerprints' nodes all the same
    links, links_path = materialize(fingerprint_links(classes.withColumnRenamed("node", "rep"), bits).unionByName(repeated), "pairs")
    found = connected_components(links)
    classes, classes_path = materialize(classes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "classes")
    out = prints.join(classes, "fp", "left")  # both sides are plain tables here, so that a fingerprint of very many documents can be split
    out = out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    out, _ = materialize(out, "components")
    remove(prints.sparkSession, prints_path, links_path, classes_path)
    return out
