"""Benchmark decontamination: size-partitioned MinHash containment search.

A short item inside a long document has a Jaccard similarity near zero, which no banding finds. So the search is partitioned by size: items
with ``s`` to ``2s - 1`` shingles (s a power of two) are a partition, and for each partition a document is seen as overlapping windows of ``3s``
shingles, ``s`` apart (a shorter one: whole). Any stretch of ``2s`` shingles lies in one window, so containment ``t`` means a Jaccard similarity of
``t / (3.2)`` or more in some window, and single-row bands find it but for odds of ``(1 - t / 3.2) ** bands`` (under 0.0002 at 0.8 and 32 bands).

A candidate is verified at once by exact containment of its word shingles in the whole document. One pass over the documents,
without a shuffle. Items are sent to the executors in blocks of about ``block`` items and 16 MB of text (the number of blocks follows both); more items mean more passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

_TABLE = 1 << 20
_BYTES = 16 << 20
_COLUMNS = "doc_id long, item_id long, n_item long, n_shared long, containment double"


def _families(bands: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(1, 1 << 63, bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, bands, dtype=np.uint64)


def _prepare(items: list[tuple[int, str]], k: int, bands: int) -> dict:
    """By shingle length (below ``k`` only for items with fewer words) and size class: signatures, and the items' exact shingles."""
    mul, add = _families(bands)
    classes: dict[tuple[int, int], list] = {}
    for item_id, text in items:
        buf, _ = tv.joined([(text or "").lower().encode()])
        s, e = tv.words(buf, tv.PUNCTUATION)
        if not len(s):
            continue
        n = min(k, len(s))
        raw = buf.tobytes()
        own = [raw[a:b] for a, b in zip(s.tolist(), e.tolist(), strict=True)]
        exact = frozenset(b" ".join(own[i : i + n]) for i in range(len(own) - n + 1))
        h = np.unique(tv.shingles(tv.hashes(buf, s, e), n))
        least = (h[None, :] * mul[:, None] + add[:, None]).min(axis=1)
        classes.setdefault((n, len(exact).bit_length() - 1), []).append((item_id, exact, least))
    out: dict[int, dict[int, tuple]] = {}
    for (n, c), rows in classes.items():
        values = np.stack([r[2] for r in rows])
        table = np.zeros(_TABLE, bool)
        table[(values & np.uint64(_TABLE - 1)).ravel()] = True
        order = np.argsort(values, axis=0, kind="stable")
        out.setdefault(n, {})[c] = (table, np.take_along_axis(values, order, 0), order, [r[:2] for r in rows])
    return out


def _candidates(sh: np.ndarray, doc: np.ndarray, classes: dict[int, tuple], bands: int) -> set[tuple[int, int, int]]:
    """``(document, class, item)`` that share a window's minimum under some band."""
    mul, add = _families(bands)
    found: set[tuple[int, int, int]] = set()
    if not len(sh):
        return found
    first = np.concatenate(([True], doc[1:] != doc[:-1]))
    begin = np.flatnonzero(first)
    at = np.arange(len(sh)) - np.repeat(begin, np.diff(np.append(begin, len(sh))))
    low = min(classes)
    blocks, shape = {low: np.flatnonzero(at % (1 << low) == 0)}, {low: doc}  # blocks: where each begins among the blocks of the class below
    for c in range(low, max(classes) + 1):
        if c > low:
            blocks[c] = np.flatnonzero(at % (1 << c) == 0)
        at, shape[c] = at[blocks[c]], (doc if c == low else shape[c - 1])[blocks[c]]
    for j in range(bands):
        x = sh * mul[j]
        x += add[j]
        least = np.minimum.reduceat(x, blocks[low])
        for c in range(low, max(classes) + 1):
            if c > low:
                least = np.minimum.reduceat(least, blocks[c])
            if c not in classes:
                continue
            table, values, order, _ = classes[c]
            owner, window = shape[c], least.copy()
            for step in (1, 2):
                if len(owner) > step:
                    same = owner[step:] == owner[:-step]
                    np.minimum(window[:-step], least[step:], out=window[:-step], where=same)
            hit = np.flatnonzero(table[window & np.uint64(_TABLE - 1)])
            if not len(hit):
                continue
            v = window[hit]
            lo, hi = np.searchsorted(values[:, j], v, "left"), np.searchsorted(values[:, j], v, "right")
            for w, a, b in zip(hit[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                found.update((int(owner[w]), c, int(i)) for i in order[a:b, j])
    return found


def _search(prepared, k: int, bands: int, least: float, whole: list[str] | None = None):
    """The found pairs; with ``whole``, these columns of the rows without one."""

    def hits(b: pa.RecordBatch) -> list[tuple]:
        """By place in the batch."""
        rows: list[tuple] = []
        texts = [(t or "").lower().encode() for t in b.column("text" if whole is None else "__text").to_pylist()]
        buf, offsets = tv.joined(texts)
        s, e = tv.words(buf, tv.PUNCTUATION)
        h, doc = tv.hashes(buf, s, e), np.searchsorted(offsets, s, "right") - 1
        for n, classes in prepared.value.items():
            if len(h) < n:
                continue
            inside = doc[n - 1 :] == doc[: len(doc) - n + 1]
            found = _candidates(tv.shingles(h, n)[inside], doc[: len(doc) - n + 1][inside], classes, bands)
            for d in {x[0] for x in found}:
                lo, hi = np.searchsorted(doc, [d, d + 1])
                base, raw = offsets[d], texts[d]
                own = [raw[x:y] for x, y in zip((s[lo:hi] - base).tolist(), (e[lo:hi] - base).tolist(), strict=True)]
                all_own = {b" ".join(own[i : i + n]) for i in range(len(own) - n + 1)}
                for _, c, i in (x for x in found if x[0] == d):
                    item, exact = classes[c][3][i]
                    shared = len(exact & all_own)
                    if shared >= least * len(exact):
                        rows.append((d, item, len(exact), shared, shared / len(exact)))
        return rows

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        rows, ids = hits(b), b.column("doc_id").to_pylist() if whole is None else []
        if whole is not None:
            clean = np.ones(b.num_rows, bool)
            clean[[r[0] for r in rows]] = False
            return b.filter(pa.array(clean)).select(whole)
        rows = [(ids[r[0]], *r[1:]) for r in rows]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "n_item", "n_shared", "containment"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in tv.slices(b, "text" if whole is None else "__text", 1 << 22):
                yield batch(part)
        tv.release()

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, containment: float = 0.8, bands: int = 32, block: int = 5000) -> DataFrame:
    """``(doc_id, item_id, n_item, n_shared, containment)``: each document row and item with at least ``containment`` of the item's distinct ``k``-word shingles in the document.

    Words are lower-cased runs of letters, digits and non-ASCII characters. An item of fewer than ``k`` words is one shingle. Items or documents
    without a word (null and empty ones too) match nothing. Repeated document rows or items give a row each; null ids are passed
    on. Either table empty: no rows. Other columns are not read.
    """
    if not 0 < containment <= 1:
        raise ValueError("containment must be in (0, 1]")
    texts, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), None
    for prepared in _blocks(benchmark, k, bands, block):
        found = texts.mapInArrow(_search(prepared, k, bands, containment), _COLUMNS)
        out = found if out is None else out.unionByName(found)
    return out


def _blocks(benchmark: DataFrame, k: int, bands: int, block: int):
    """The items, prepared and broadcast in blocks."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    passes = max(1, -(-n // block), -(-size // _BYTES))
    passes = 2 * passes if passes > 1 else 1  # twice as many blocks as needed: hashed blocks vary in size
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(passes))
    for p in range(passes):
        yield benchmark.sparkSession.sparkContext.broadcast(_prepare([tuple(r) for r in items.where(part == p).collect()], k, bands))


def clean_documents(docs: DataFrame, benchmark: DataFrame, k: int = 5, containment: float = 0.8, bands: int = 32, block: int = 5000) -> DataFrame:
    """The rows of ``docs`` that hold no item as ``contaminated`` has it, with all their columns: each row is judged where it lies, without a join."""
    names, out = docs.columns, docs
    if "__text" in names:
        raise ValueError("the column name __text is taken")
    for prepared in _blocks(benchmark, k, bands, block):
        judged = out.select("*", F.col("text").cast("string").alias("__text"))
        out = judged.mapInArrow(_search(prepared, k, bands, containment, names), docs.schema)
    return out
