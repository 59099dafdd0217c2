"""Substring dedup: paragraph MinHash banding.

Words are runs between ASCII white space, ASCII-lower-cased. Two kinds of paragraph are looked at.

Paragraphs of the text: lines and blocks (lines between blank ones) of ``min_words`` or more, and whole texts of five words or more. They are banded by MinHash
over five-word shingles; paragraphs that meet in a band are verified by exact Jaccard similarity of their shingle sets, and links become components. One
changed word inside a paragraph costs five shingles, so a paragraph of 49 words or more stays at 0.8. Bands: 8 of 3 rows, which find a similarity
of 0.8 with odds of 0.997.

Sliding paragraphs, for passages that lie inside longer lines: ``width`` words from a position whose three-word hash is the least of some ``spread`` neighbouring
ones (winnowing). They are compared for equality alone, so their one band is their content. Any ``width + spread + 2`` equal words (50)
hold a whole one, at the same place in each copy. At the ends of a passage inside a line fewer than ``spread`` words can be left over.

Equal content is equal by 128 bits of hash; shingles are told apart by 64 bits inside one comparison. Of each component, the smallest doc_id keeps its paragraphs; in all
other documents they are removals, merged where they touch. All paragraphs are written once; what follows are joins and grouped minima
of that table, and the texts of colliding paragraphs alone are fetched again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import free_shuffles, materialize, partitions, remove
from .components import connected_components

_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)
_K = 5
_SEED = 3
_BYTES = 1 << 23


def _slide(x: np.ndarray, w: int, least=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of ``x[i : i + w]`` for every ``i`` that has ``w`` values."""
    done, out = 1, x
    while done < w:
        step = min(done, w - done)
        out = least(out[:-step], out[step:])
        done += step
    return out


def winnowed(h: np.ndarray, doc: np.ndarray, spread: int) -> np.ndarray:
    """Word positions whose three-word hash is the least of some ``spread`` neighbouring ones of the document; of equal ones closer than that, one in ``spread`` words."""
    if len(h) < _SEED:
        return np.zeros(0, np.int64)
    v = np.full(len(h), _MAX)
    inside = doc[_SEED - 1 :] == doc[: len(doc) - _SEED + 1]
    v[: len(inside)][inside] = tv.shingles(h, _SEED)[inside]
    at = np.arange(len(h)) + (doc - doc[0] + 1) * spread  # places before and between documents hold the largest value
    padded = np.full(int(at[-1]) + 2 * spread, _MAX)
    padded[at] = v
    low = np.concatenate((np.zeros(spread - 1, np.uint64), _slide(padded, spread)))
    pos = np.flatnonzero((_slide(low, spread, np.maximum)[at] == v) & (v != _MAX))
    if not len(pos):
        return pos
    new = np.append(True, (v[pos[1:]] != v[pos[:-1]]) | (doc[pos[1:]] != doc[pos[:-1]]) | (pos[1:] - pos[:-1] >= spread))
    first = np.maximum.accumulate(np.where(new, pos, 0))
    step = (pos - first) // spread
    return pos[np.append(True, new[1:] | (step[1:] != step[:-1]))]


def natural_units(raw: np.ndarray, start: np.ndarray, doc: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First words, and the words after the last, of lines, of blocks of several lines, and of texts that are neither."""
    ends = np.flatnonzero(raw == 10)
    line = np.searchsorted(ends, start)
    filled = np.concatenate(([0], np.cumsum(~tv.SPACES[raw])))[ends]
    block = np.cumsum(np.diff(filled, prepend=0) == 0)[line]
    new_doc = doc[1:] != doc[:-1]
    first, last = [], []
    for cut, below in ((line[1:] != line[:-1], None), (new_doc | (block[1:] != block[:-1]), line), (new_doc, block)):
        at = np.concatenate(([0], np.flatnonzero(cut) + 1, [len(start)]))
        lo, hi = at[:-1], at[1:]
        if below is line or below is None:
            ok = hi - lo >= min_words
        else:
            ok = hi - lo >= _K
        if below is not None:  # what lies in one line or block is that line or block, if it is long enough to be a unit
            ok &= (below[lo] != below[hi - 1]) | (hi - lo < min_words)
        first.append(lo[ok])
        last.append(hi[ok])
    return np.concatenate(first), np.concatenate(last)


class Words:
    """The words of a batch of texts: byte spans, document, hashes, and the hash of any span of words."""

    def __init__(self, texts: list[bytes]):
        self.raw, self.offsets = tv.joined([t.lower() for t in texts])
        self.s, self.e = tv.words(self.raw)
        self.doc = np.searchsorted(self.offsets, self.s, "right") - 1
        self.h = tv.hashes(self.raw, self.s, self.e)
        power, self.inverse = tv._powers(len(self.h) + 1)
        self.totals = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x * power[: len(x)], dtype=np.uint64))) for x in (self.h, tv.mix(self.h ^ np.uint64(0x5851F42D4C957F2D)))]

    def content(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """128 bits for each span, as two columns."""
        size = tv.mix((hi - lo).astype(np.uint64))
        return np.stack([tv.mix((t[hi] - t[lo]) * self.inverse[lo] ^ size) for t in self.totals], 1)


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())


def _minima(sh: np.ndarray, first: np.ndarray, last: np.ndarray, bands: int, rows: int) -> Iterator[np.ndarray]:
    """For each band, the key of every unit."""
    rng = np.random.default_rng(977)
    at = np.stack((first, last - _K + 1), axis=1).ravel()
    for b in range(bands):
        key = np.full(len(first), np.uint64(b + 1))
        for _ in range(rows):
            mul, add = rng.integers(1, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            low = np.minimum.reduceat(np.append(sh * mul + add, _MAX), at)[::2] if len(at) else np.zeros(0, np.uint64)
            key = tv.mix(key * np.uint64(0xD1342543DE82EF95) ^ low)
        yield key.view(np.int64)


def _scan(width: int, spread: int, min_words: int, bands: int, rows: int):
    def units(part: pa.RecordBatch) -> pa.RecordBatch:
        own = Words([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()])
        lo, hi = natural_units(own.raw, own.s, own.doc, min_words) if len(own.h) else (np.zeros(0, np.int64),) * 2
        at = winnowed(own.h, own.doc, spread)
        at = at[at + width <= len(own.h)]
        at = at[own.doc[at] == own.doc[at + width - 1]]
        keys = [pa.concat_arrays([pa.array(k), pa.nulls(len(at), pa.int64())]) for k in _minima(tv.shingles(own.h, _K), lo, hi, bands, rows)]
        lo, hi = np.concatenate((lo, at)), np.concatenate((hi, at + width))
        lead = np.concatenate(([0], np.cumsum((own.raw & 0xC0) != 0x80)))
        doc = own.doc[lo] if len(lo) else lo
        base = lead[own.offsets[doc]] if len(lo) else lo
        start, end = (lead[x] - base if len(lo) else lo for x in ((own.s[lo], own.e[hi - 1]) if len(lo) else (lo, lo)))
        columns = [_binary(own.content(lo, hi)), part.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(start, pa.int32()), pa.array(end, pa.int32()), *keys]
        return pa.record_batch(columns, ["content", "doc_id", "start", "end", *_keys(bands)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in tv.slices(b, "text", 1 << 21):
                yield units(part)
        tv.release()

    return run


def _keys(bands: int) -> list[str]:
    return [f"k{b}" for b in range(bands)]


def _forest(contents: list[bytes], sets: list[np.ndarray], similarity: float) -> list[tuple[bytes, bytes]]:
    """Links from the least content to all others of each component under this similarity: each set is compared with those not yet reached."""
    sizes = np.array([len(s) for s in sets])
    left, out = np.arange(len(sets)), []
    held, flat, bound = left[:0], None, None
    while len(left):
        front, left, reached = [left[0]], left[1:], [left[0]]
        while front and len(left):
            at = front.pop()
            if flat is None or 2 * len(left) < len(held):
                held, flat = left, np.concatenate([sets[i] for i in left])
                bound = np.cumsum(sizes[held]) - sizes[held]
            place = np.minimum(np.searchsorted(sets[at], flat), sizes[at] - 1)
            shared = np.add.reduceat((sets[at][place] == flat).astype(np.int64), bound)[np.searchsorted(held, left)]
            hit = shared >= similarity * (sizes[left] + sizes[at] - shared) - 1e-9
            reached += left[hit].tolist()
            front.extend(left[hit].tolist())
            left = left[~hit]
        least = min(contents[i] for i in reached)
        out += [(least, contents[i]) for i in reached if contents[i] != least]
    return out


def _verify(similarity: float):
    """Groups of paragraphs that meet: a spanning forest of the links of this similarity. A text that is not its content's (of another row with that doc_id) is left out."""

    def links(t: pa.Table) -> list[tuple[bytes, bytes]]:
        own = Words([x or b"" for x in t.column("text").cast(pa.binary()).to_pylist()])
        rows = np.arange(t.num_rows)
        lo, hi = np.searchsorted(own.doc, rows), np.searchsorted(own.doc, rows, "right")
        contents, found = t.column("content").to_pylist(), own.content(lo, hi)
        right = [hi[i] - lo[i] >= _K and found[i].tobytes() == contents[i] for i in rows]
        sh, out = tv.shingles(own.h, _K), []
        for a, b in tv.bounds(t, ("id", "a", "b")):
            pick = [i for i in range(a, b) if right[i]]
            if len(pick) > 1:
                out += _forest([contents[i] for i in pick], [np.unique(sh[lo[i] : hi[i] - _K + 1]) for i in pick], similarity)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tv.runs(batches, ("id", "a", "b")):
            a, b = zip(*found, strict=True) if (found := links(t)) else ((), ())
            yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
        tv.release()

    return run


def _compared(pairs: DataFrame, similarity: float) -> DataFrame:
    return pairs.repartition(partitions(pairs.sparkSession), "id", "a", "b").sortWithinPartitions("id", "a", "b").mapInArrow(_verify(similarity), "a binary, b binary")


def similar_contents(texts: DataFrame, units: DataFrame, bands: int, similarity: float, chunk: int) -> tuple[DataFrame, list[str]]:
    """``(content, component)`` of all paragraphs with a link to another content, and the folders to remove in the end.

    A bucket of over ``chunk`` contents is dealt into chunks, in another way for each band, and compared inside them; near copies of one another become one
    component by the bands together. Only buckets that still hold several components are compared across all pairs of their chunks.
    """
    natural = units.where("k0 is not null")
    contents, contents_path = materialize(natural.groupBy("content").agg(F.max(F.col("end") - F.col("start")).cast("long").alias("size"), *[F.min(k).alias(k) for k in _keys(bands)]), "contents")
    free_shuffles(texts.sparkSession)
    keyed = contents.select("content", "size", F.explode(F.array(*_keys(bands))).alias("key"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.bit_xor(F.xxhash64("content")).alias("bucket")).where("n > 1")
    chunks = F.greatest(F.ceil(F.col("n") / chunk), F.ceil(F.col("size") / _BYTES)).cast("int")
    buckets = buckets.select("key", chunks.alias("chunks"), F.when(chunks == 1, F.col("bucket")).otherwise(F.col("key")).alias("id"))  # small buckets of the same contents are compared once
    members, members_path = materialize(keyed.drop("size").join(buckets, "key").select("content", "id", "chunks").distinct(), "members")
    del keyed, buckets
    remove(texts.sparkSession, contents_path)
    free_shuffles(texts.sparkSession)
    wanted = natural.select("content", "doc_id", "start", "end").join(members.select("content").distinct(), "content", "left_semi")
    wanted = wanted.groupBy("content").agg(F.min(F.struct("doc_id", "start", "end")).alias("at")).groupBy("at.doc_id").agg(F.collect_list(F.struct("content", "at.start", "at.end")).alias("wanted"))
    given = F.transform("wanted", lambda w: F.struct(w["content"].alias("content"), F.substr("text", w["start"] + 1, w["end"] - w["start"]).alias("text")))
    sets, sets_path = materialize(texts.join(wanted, "doc_id").select(F.explode(given).alias("given")).select("given.*"), "sets")
    free_shuffles(texts.sparkSession)
    pairs = members.join(sets, "content").withColumn("a", F.pmod(F.xxhash64("content", "id"), F.col("chunks")).cast("int"))
    links, links_path = materialize(_compared(pairs.select("id", "a", F.col("a").alias("b"), "content", "text"), similarity), "links")
    groups, groups_path = materialize(connected_components(links).select(F.col("node").alias("content"), "component"), "groups")
    paths = [members_path, sets_path, links_path, groups_path]
    crowded = members.where("chunks > 1").join(groups, "content", "left").groupBy("id").agg(F.min(F.coalesce("component", "content")).alias("a"), F.max(F.coalesce("component", "content")).alias("b"))
    crowded, crowded_path = materialize(crowded.where("a <> b").select("id"), "crowded")
    if not crowded.isEmpty():
        across = pairs.join(crowded, "id", "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("other <> a")
        more = _compared(across.select("id", F.least("a", "other").alias("a"), F.greatest("a", "other").alias("b"), "content", "text"), similarity)
        more, more_path = materialize(more, "links")
        known = groups.select(F.col("content").alias("a"), F.col("component").alias("b"))  # stands for the links it was made of
        groups, groups_path = materialize(connected_components(known.unionByName(more)).select(F.col("node").alias("content"), "component"), "groups")
        paths += [more_path, groups_path]
    remove(texts.sparkSession, *paths[:-1], crowded_path)
    return groups, paths[-1:]


def repeated_passages(docs: DataFrame, width: int = 28, spread: int = 20, min_words: int = 40, bands: int = 8, rows: int = 3, similarity: float = 0.8, chunk: int = 256) -> DataFrame:
    """``(doc_id, start, end, kept_doc_id, n_paragraphs)``: passages to remove, as spans of code points, and the smallest document that keeps one of their paragraphs.

    A paragraph that repeats inside one document alone is no removal. Null and empty texts and those of fewer than five words have no paragraph; a text of fewer than
    ``min_words`` words is a paragraph as a whole, but its lines are not. Repeats of fewer words than ``min_words`` inside longer texts are found by sliding paragraphs
    or not at all; a smaller ``min_words`` finds lines of five words on. Rows with one doc_id are one document (equal rows give one set of
    spans); a null doc_id takes no part. Other columns are not read; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "content binary, doc_id long, start int, end int, " + ", ".join(f"{k} long" for k in _keys(bands))
    units, units_path = materialize(texts.mapInArrow(_scan(width, spread, min_words, bands, rows), schema), "units")
    groups, temporary = similar_contents(texts, units, bands, similarity, chunk)
    repeated = units.groupBy("content").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("content")
    found = repeated.unionByName(groups.select("content")).distinct().join(groups, "content", "left").select("content", F.coalesce("component", "content").alias("component"))
    found, found_path = materialize(found, "repeated")
    del repeated
    free_shuffles(spark)
    where, where_path = materialize(units.select("content", "doc_id", "start", "end").join(found, "content").select("component", "doc_id", "start", "end"), "where")
    free_shuffles(spark)
    remove(spark, units_path, found_path, *temporary)
    owners = where.groupBy("component").agg(F.min("doc_id").alias("kept_doc_id"), F.max("doc_id").alias("last")).where("kept_doc_id < last")
    owners, owners_path = materialize(owners.drop("last"), "owners")  # a table of its own, so that the join below can split a hot component
    gone = where.join(owners, "component").where("doc_id <> kept_doc_id").select("doc_id", "start", "end", "kept_doc_id").distinct()
    order = Window.partitionBy("doc_id").orderBy("start", "end", "kept_doc_id")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = gone.withColumn("new", F.when(before >= F.col("start"), 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    out = islands.groupBy("doc_id", "island").agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), F.min("kept_doc_id").alias("kept_doc_id"), F.count(F.lit(1)).alias("n_paragraphs")).drop("island")
    out, _ = materialize(out, "passages")
    remove(spark, where_path, owners_path)
    return out


def cut(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with the passages taken out of ``text``: all its rows and columns, in any order.

    Null texts stay null, rows with a null doc_id or without a passage stay as they are, and rows with one doc_id lose the same spans (as far as their texts reach).
    """
    spans = passages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("__spans"))

    @F.pandas_udf("string")
    def without(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text, spans):
            if text is None or spans is None:
                return text
            out, at = [], 0
            for s in spans:
                out.append(text[at : s["start"]])
                at = max(at, s["end"])
            return "".join([*out, text[at:]])

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    joined = docs.join(spans, "doc_id", "left").withColumn("text", without("text", "__spans"))
    return joined.select(*docs.columns)
