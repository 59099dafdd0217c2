"""LM scoring with a weighted backoff automaton over n-grams.

States are contexts of up to ``order - 1`` words that training holds, and the root. A state has an arc for every word that followed its context, and a failure
arc to the state of the longest shorter context; the root has an arc for every word. An arc leads to the longest state that ends
the words read. Weights are interpolated absolute discounting: an arc of a context ``h`` has ``max(c(hw) - D, 0) / c(h) + f(h) p(w | shorter)``, its failure arc
``f(h) = D n(h) / c(h)``, a root arc add-one unigrams; each order's ``D`` comes from its numbers of n-grams seen once and twice. One left-to-right traversal carries
the state, follows arcs and failure arcs, and adds up their weights.

The automaton grows with the corpus and is nowhere whole. Documents are split into words once, packed into blocks of about ``block`` bytes of text as numbers
of words beside the hashes of the block's distinct words, compressed, and written in buckets; they do not move after that. Order by order, a block sends its distinct contexts and arcs with their training counts to the parts of the hashed contexts; a part adds
them up over all blocks and answers with the totals, in the block's own order. From the third order on, a context that no other
block holds, as the order below has told, is not sent. With the totals a block compiles the states and arcs that its texts can reach, and is traversed: long
texts in pieces side by side, each led in by the ``order - 1`` words before it. Contexts are 64-bit hashes, arcs 40 bits inside their context. No message is
empty, so there are never more than n-grams in the corpus, however many blocks and parts there are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import free_shuffles, materialize, partitions, remove, scratch_path, text_of

_END, _BEGIN = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_ZSTD = "zstd"
_PIECE = 256
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_ANSWER = "part int, block long, phase int, n long, v long, once long, twice long, blob binary"


def _pack(*arrays: np.ndarray) -> bytes:
    """Sizes, then the arrays with the bytes of a place together, compressed."""
    head = np.array([len(a) for a in arrays], "<u8").tobytes()
    plain = [np.ascontiguousarray(a).view(f"<u{a.itemsize}") for a in arrays]
    raw = head + b"".join((a >> a.dtype.type(8 * i)).astype(np.uint8).tobytes() for a in plain for i in range(a.itemsize))
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec=_ZSTD, asbytes=True)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec=_ZSTD, asbytes=True)
    sizes, at, out = np.frombuffer(raw, "<u8", len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        held = np.empty((n, np.dtype(kind).itemsize), np.uint8)
        for i in range(held.shape[1]):
            held[:, i] = np.frombuffer(raw, np.uint8, n, at)
            at += n
        out.append(held.reshape(-1).view(kind))
    return out


def _ranks(count: np.ndarray) -> np.ndarray:
    """Each word's number: the most frequent first, equals in order."""
    bits = len(count).bit_length()
    rank = np.empty(len(count), np.int64)
    rank[np.sort((count.max(initial=0) - count) << bits | np.arange(len(count))) & ((1 << bits) - 1)] = np.arange(len(count))
    return rank


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of tokens, the hashes of the distinct ones and of the beginning in order, how often each occurs, and the tokens by ``_ranks``."""
    buf, offsets = tv.joined([t.lower() for t in texts])
    s, e = tv.words(buf, tv.SPACES)
    doc = np.searchsorted(offsets, s, "right") - 1
    sizes = np.bincount(doc, minlength=len(texts)) + 1
    ends = np.cumsum(sizes)
    tokens = np.empty(int(ends[-1]) + 1, np.uint64)
    tokens[np.arange(len(s)) + doc] = tv.hashes(buf, s, e)
    tokens[ends - 1] = _END
    tokens[-1] = _BEGIN
    keys, word = np.unique(tokens, return_inverse=True)
    count = np.bincount(word)
    return sizes, keys, count, _ranks(count)[word[:-1]]


def _packed(block: int):
    """Rows (doc_id, text, held_out) as blocks: ids, null ids, held-out flags, numbers of tokens, hashes and counts of distinct tokens, and tokens."""

    def one(number: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        texts = t.column("text").cast(pa.binary()).to_pylist()
        ids = t.column("doc_id").combine_chunks()
        sizes, keys, count, word = _words(texts)
        arrays = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), t.column("held_out").to_numpy(), sizes.astype("<u4"), np.diff(keys, prepend=np.uint64(0)), count.astype("<u4"), word.astype("<u4")
        return pa.record_batch([pa.array([number], pa.int64()), pa.array([sum(map(len, texts)) + 8 * len(texts)], pa.int64()), pa.array([_pack(*arrays)], pa.binary())], ["block", "size", "texts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            for part in tv.slices(b, "text", 1 << 18):
                held.append(part)
                size += part.column("text").nbytes
                if size >= block:
                    yield one(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield one(number, held)
        tv.release()

    return run


def _distinct(code: np.ndarray, limit: int, where: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct ones of codes below ``limit`` in order; each of ``size`` positions' place among them (-1: none), if code ``i`` is at ``where[i]``; where each is first.

    A code and its position are sorted as one number if they fit.
    """
    place, bits = np.full(size, -1, np.int32), size.bit_length()
    if limit.bit_length() + bits > 63:
        distinct, first, place[where] = np.unique(code, return_index=True, return_inverse=True)
        return distinct, place, where[first]
    both = np.sort(code << bits | where)
    position = both & ((1 << bits) - 1)
    both >>= bits
    new = np.ones(len(code), bool)
    np.not_equal(both[1:], both[:-1], out=new[1:])
    place[position] = np.cumsum(new, dtype=np.int32) - 1
    return both[new], place, position[new]


def _running(x: np.ndarray) -> np.ndarray:
    """Zero, then the running sums."""
    out = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=out[1:])
    return out


class Level:
    """The distinct n-grams of a block: context (a gram of the level below) and word, where each position has its gram (-1: none), where each gram is first, training counts."""

    def __init__(self, block: Block, below: Level | None):
        size, self.below, self.keys = len(block.keys), below, block.keys
        if below is None:
            self.at, self.ctx, self.word = block.word, None, None
            self.seen = np.bincount(block.word, block.train, size).astype(np.int64)
            self.seen[block.begin] = block.n_train
        else:
            ctx = np.full(len(block.word), -1, np.int64)
            if below.ctx is None:
                ctx[1:] = block.word[:-1]
                ctx[block.starts] = block.begin
            else:
                ctx[1:] = below.at[:-1]
                ctx[block.starts] = -1
            where, wide = np.flatnonzero(ctx >= 0), size.bit_length()
            code, self.at, first = _distinct(ctx[where] << wide | block.word[where], len(below) << wide, where, len(ctx))
            self.ctx, self.word = (code >> wide).astype(np.int32), (code & ((1 << wide) - 1)).astype(np.int32)
            self.first = first.astype(np.int32)
            self.seen = np.bincount(self.at[block.train] + 1, minlength=len(code) + 1)[1:]
            self.arcs = np.bincount(self.ctx, minlength=len(below))
            self.upto = _running(self.arcs)
            self.ctx_seen = self.sums(self.seen)
        self.total = None

    def __len__(self) -> int:
        return len(self.seen)

    def sums(self, x: np.ndarray) -> np.ndarray:
        """For each context the sum over its arcs."""
        return np.diff(_running(x)[self.upto])

    @cached_property
    def shorter(self) -> np.ndarray:
        """Each gram without its first word, in the level below."""
        return self.below.at[self.first]

    def hashes(self, at: np.ndarray) -> np.ndarray:
        return self.keys[at] if self.below is None else tv.mix(self.below.hashes(self.ctx[at]) * np.uint64(0xD1342543DE82EF95) ^ self.keys[self.word[at]])


class Block:
    """A block's tokens and its n-grams up to an order; ``fill`` takes the totals of one order after the other."""

    def __init__(self, blob: bytes, order: int):
        ids, null, held, sizes, keys, count, word = _unpack(blob, "<i8", "?", "?", "<u4", "<u8", "<u4", "<u4")
        self.ids, self.held, self.sizes = pa.array(ids, pa.int64(), mask=null), held, sizes.astype(np.int64)
        keys, self.by_hash, self.word = np.cumsum(keys, dtype=np.uint64), _ranks(count.astype(np.int64)), word.astype(np.int64)
        self.end, self.begin = self.by_hash[np.searchsorted(keys, [_END, _BEGIN])].tolist()
        self.keys = np.empty_like(keys)
        self.keys[self.by_hash] = keys
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(sizes)), self.sizes)
        self.train, self.n_train = ~held[self.doc], int((~held).sum())
        self.levels = [Level(self, None)]
        for _ in range(order - 1):
            self.levels.append(Level(self, self.levels[-1]))

    def _sent(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For order ``n``: the contexts that other blocks hold too (all words at order 2), in the order of the upper 32 bits of their hashes at least; the hashes, their numbers of arcs, and the arcs."""
        level, below = self.levels[n - 1], self.levels[n - 2]
        if n == 2:
            own, h = self.by_hash, self.keys[self.by_hash]
        else:
            own = np.flatnonzero((level.arcs > 0) & ~below.alone)
            h, bits = below.hashes(own), np.uint64(len(own).bit_length())
            at = np.sort(h >> bits << bits | np.arange(len(own), dtype=np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))
            own, h = own[at], h[at]
        size = level.arcs[own]
        arcs = np.repeat(level.upto[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return own, h, size, arcs

    def requests(self, n: int, parts: int) -> list[tuple[int, bytes, tuple[int, int, int, int]]]:
        """``(part, message, counts)``; the first message carries what the block counts on its own: training tokens, and arcs not sent that were seen once and twice."""
        level, below = self.levels[n - 1], self.levels[n - 2]
        own, h, size, arcs = self._sent(n)
        kept = np.ones(len(level), bool)
        kept[arcs] = False
        counts, out = (int(self.train.sum()) if n == 2 else 0, 0, int((level.seen[kept] == 1).sum()), int((level.seen[kept] == 2).sum())), []
        ctx_seen, x, seen = (below.seen if n == 2 else level.ctx_seen)[own].astype("<u4"), level.hashes(arcs), level.seen[arcs].astype("<u4")
        low, high = x.astype("<u4"), (x >> np.uint64(32)).astype("u1")
        for p, a, b, c, d in self._parts(h, size, parts):
            out.append((p, _pack(np.diff(h[a:b], prepend=np.uint64(0)), ctx_seen[a:b], size[a:b].astype("<u4"), low[c:d], high[c:d], seen[c:d]), counts))
            counts = (0, 0, 0, 0)
        return out or [(0, _pack(*(np.zeros(0, k) for k in ("<u8", "<u4", "<u4", "<u4", "u1", "<u4"))), counts)]

    @staticmethod
    def _parts(h: np.ndarray, size: np.ndarray, parts: int) -> list[tuple[int, int, int, int, int]]:
        """Parts that are not empty, with the bounds of their contexts and arcs."""
        part = ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        cuts = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)])) if len(part) else np.zeros(1, int)
        upto = _running(size)
        return [(int(part[a]), int(a), int(b), int(upto[a]), int(upto[b])) for a, b in zip(cuts, cuts[1:], strict=False)]

    def fill(self, n: int, answers: dict[int, bytes], parts: int) -> None:
        """Totals of order ``n``: contexts (count, arcs seen) and arcs (count, whether no other block holds it); those not sent are the block's own."""
        level, below = self.levels[n - 1], self.levels[n - 2]
        own, h, size, arcs = self._sent(n)
        level.ctx_total, level.total, level.alone = level.ctx_seen.copy(), level.seen.copy(), np.ones(len(level), bool)
        level.fan = level.sums(level.seen > 0)
        for p, a, b, c, d in self._parts(h, size, parts):
            level.ctx_total[own[a:b]], level.fan[own[a:b]], level.total[arcs[c:d]], level.alone[arcs[c:d]] = _unpack(answers[p], "<u4", "<u4", "<u4", "?")
        if n == 2:
            below.total = level.ctx_total.copy()
            level.ctx_total[self.end] = 0  # the end is no context


def _totals(parts_of: list[bytes]) -> tuple[list[bytes], tuple[int, int, int]]:
    """Answers to the blocks' requests for one part; the part's distinct contexts (but the beginning) seen, and its arcs seen once and twice."""
    asked = [_unpack(b, "<u8", "<u4", "<u4", "<u4", "u1", "<u4") for b in parts_of]
    keys, at = np.unique(np.concatenate([np.cumsum(a[0], dtype=np.uint64) for a in asked]), return_inverse=True)
    seen = np.bincount(at, np.concatenate([a[1] for a in asked]), len(keys)).astype(np.int64)
    owner = np.repeat(at, np.concatenate([a[2] for a in asked])).astype(np.uint64)
    arc = np.concatenate([a[3] for a in asked]).astype(np.uint64) | np.concatenate([a[4] for a in asked]).astype(np.uint64) << np.uint64(32) | owner << np.uint64(40)
    arc, place = np.unique(arc, return_inverse=True)
    arc_seen = np.bincount(place, np.concatenate([a[5] for a in asked]), len(arc)).astype(np.int64)
    alone = np.bincount(place, minlength=len(arc)) == 1
    fan = np.bincount((arc >> np.uint64(40)).astype(np.int64), arc_seen > 0, len(keys)).astype(np.int64)
    out, i, j = [], 0, 0
    for a in asked:
        own, arcs = at[i : i + len(a[0])], place[j : j + len(a[3])]
        out.append(_pack(seen[own].astype("<u4"), fan[own].astype("<u4"), arc_seen[arcs].astype("<u4"), alone[arcs]))
        i, j = i + len(own), j + len(arcs)
    return out, (int(((seen > 0) & (keys != _BEGIN)).sum()), int((arc_seen == 1).sum()), int((arc_seen == 2).sum()))


class Automaton:
    """The states and arcs that a block's texts can reach. States are numbered by level, the root last."""

    def __init__(self, block: Block, n: int, v: int, discounts: list[float]):
        self.block, levels, size = block, block.levels, len(block.keys)
        self.root = (levels[0].total + 1) / (n + v + 1)
        offsets = np.cumsum([0, *(len(x) for x in levels[:-1])])
        self.n_states = int(offsets[-1])
        self.failure, self.failure_weight = np.full(self.n_states, self.n_states, np.int64), np.zeros(self.n_states)
        p, target, keys, weights, targets, arcs = self.root, None, [], [], [], []
        for k, level in enumerate(levels):
            if k:
                total, fan = level.ctx_total, level.fan
                f = np.where(total > 0, discounts[k - 1] * fan / np.maximum(total, 1), 1.0)  # a context that training lacks leaves the weight as it is
                self.failure_weight[offsets[k - 1] : offsets[k - 1] + len(f)] = np.log10(f)
                p = np.maximum(level.total - discounts[k - 1], 0) / np.maximum(total, 1)[level.ctx] + f[level.ctx] * p[level.shorter]
            follow = levels[k + 1].ctx_total > 0 if k + 1 < len(levels) else np.zeros(len(level), bool)
            shorter = np.full(len(level), self.n_states) if k == 0 else target[level.shorter]
            target = np.where(follow, (offsets[k] if k + 1 < len(levels) else 0) + np.arange(len(level)), shorter)
            if k + 1 < len(levels):
                self.failure[offsets[k] : offsets[k] + len(level)] = shorter
            if k:
                there = level.total > 0
                keys.append((offsets[k - 1] + level.ctx[there]) * size + level.word[there])
                weights.append(np.log10(p[there]))
                targets.append(target[there])
                arcs.append(level.sums(there))
            else:
                self.first = target
        self.keys, self.weights, self.targets = (np.concatenate(x) for x in (keys, weights, targets))
        self.arcs = np.concatenate(arcs)
        self.arc = np.minimum(np.cumsum(self.arcs) - self.arcs, max(0, len(self.keys) - 1))  # a state's first; most states have one
        self.lead = len(levels) - 1

    def traverse(self) -> np.ndarray:
        """The sum of weights for each document."""
        own, size, root = self.block, len(self.block.keys), np.log10(self.root)
        pieces = -(-own.sizes // _PIECE)
        doc = np.repeat(np.arange(len(pieces)), pieces)
        begin = own.starts[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * _PIECE
        stop = np.minimum(begin + _PIECE, own.starts[doc] + own.sizes[doc])
        at = np.maximum(begin - self.lead, own.starts[doc])  # words that lead in are read without being scored
        state = np.where(at == own.starts[doc], self.first[own.begin], self.n_states)
        order = np.argsort(at - stop, kind="stable")
        doc, begin, stop, at, state = (x[order] for x in (doc, begin, stop, at, state))
        length, total = stop - at, np.zeros(len(doc))
        alive = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left")
        for t, n in enumerate(alive.tolist()):
            word, now, said = own.word[at[:n] + t], state[:n].copy(), np.zeros(n)
            todo = np.arange(n)
            while len(todo):
                here, w = now[todo], word[todo]
                top = here == self.n_states
                said[todo[top]] += root[w[top]]
                now[todo[top]] = self.first[w[top]]
                todo, here, w = todo[~top], here[~top], w[~top]
                key = here * size + w
                place = self.arc[here]
                hit = self.keys[place] == key if len(self.keys) else np.zeros(len(key), bool)
                rest = np.flatnonzero(~hit & (self.arcs[here] > 1))
                place[rest] = np.minimum(np.searchsorted(self.keys, key[rest]), max(0, len(self.keys) - 1))
                hit[rest] = self.keys[place[rest]] == key[rest]
                said[todo[hit]] += self.weights[place[hit]]
                now[todo[hit]] = self.targets[place[hit]]
                todo, here = todo[~hit], here[~hit]
                said[todo] += self.failure_weight[here]
                now[todo] = self.failure[here]
            state[:n] = now
            total[:n] += np.where(at[:n] + t >= begin[:n], said, 0.0)
        return np.bincount(doc, total, len(own.sizes))


def score_documents(docs: DataFrame, fold: int = 7, held: int = 2, order: int = 4, block: int = 4 << 20, part: int = 16 << 20) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row of ``docs``.

    Trained on rows whose ``crc32(doc_id as text) mod fold`` is not ``held``. Words are ASCII-lower-cased and split at ASCII white space; each text ends with an end token.
    ``base_score`` is the add-one unigram and ``score`` the automaton's log10 probability. Null text counts as
    empty: its end token alone. A null doc_id is in training. Repeated rows count and are scored each. Other columns are not read; an empty
    table gives an empty table.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == held, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), out.alias("held_out"))
    name, blocks_path, n_buckets = f"quiverlake_blocks_{uuid.uuid4().hex}", scratch_path(spark, "blocks"), partitions(spark)
    packed = rows.mapInArrow(_packed(block), "block long, size long, texts binary").repartition(n_buckets, "block")
    packed.write.bucketBy(n_buckets, "block").option("path", blocks_path).saveAsTable(name)  # so that blocks meet their answers without being shuffled again
    del packed
    free_shuffles(spark)
    blocks = spark.table(name)
    parts = max(1, -(-(blocks.agg(F.sum("size")).first()[0] or 0) // part))
    blocks = blocks.select("block", "texts")

    def filled(texts: pa.Table, answers: pa.Table | None, n: int) -> Block:
        """The block with the totals of all orders below ``n``."""
        own, said = Block(texts.column("texts")[0].as_py(), min(n, order)), {}
        for phase, p, blob in zip(*(answers.column(c).to_pylist() for c in ("phase", "part", "blob")), strict=True) if answers is not None else ():
            said.setdefault(phase, {})[p] = blob
        for k in range(2, n):
            own.fill(k, said.get(k, {}), parts)
        return own

    def ask(n: int):
        def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
            p, blob, counts = zip(*filled(texts, answers, n).requests(n, parts), strict=True)
            number = texts.column("block")[0].as_py()
            tv.release()
            return pa.table([pa.array(p, pa.int32()), pa.array([number] * len(p), pa.int64()), pa.array([n] * len(p), pa.int32()), *(pa.array(x, pa.int64()) for x in zip(*counts, strict=True)), pa.array(blob, pa.binary())], [x.split(" ")[0] for x in _ANSWER.split(", ")])

        return run

    def ask_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield from ask(2)(pa.Table.from_batches([b.slice(i, 1)]), None).to_batches()

    def answer(table: pa.Table) -> pa.Table:
        blobs, (v, once, twice) = _totals(table.column("blob").to_pylist())
        phase, rest = table.column("phase")[0].as_py(), [0] * (len(blobs) - 1)
        n, once, twice = (x + sum(table.column(c).to_pylist()) for c, x in (("n", 0), ("once", once), ("twice", twice)))
        tv.release()
        stats = [pa.array([x, *rest], pa.int64()) for x in (n, v if phase == 2 else 0, once, twice)]  # a part's counts are in one of its rows
        return pa.table([table.column("part"), table.column("block"), table.column("phase"), *stats, pa.array(blobs, pa.binary())], table.column_names)

    answers, paths, counted = None, [blocks_path], []
    for n in range(2, order + 1):
        asked = blocks.mapInArrow(ask_first, _ANSWER) if answers is None else blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(ask(n), _ANSWER)
        answered, path = materialize(asked.groupBy("part").applyInArrow(answer, _ANSWER), "answers")
        counted.append(answered.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "once", "twice")]).first())
        answers = answered if answers is None else answers.unionByName(answered)
        paths.append(path)
        del asked, answered
        free_shuffles(spark)
    n_train, n_words = counted[0][0], counted[0][1]
    discounts = [min(0.95, max(0.05, c[2] / (c[2] + 2 * c[3]))) if c[2] and c[3] else 0.5 for c in counted]

    def traverse(texts: pa.Table, answers: pa.Table) -> pa.Table:
        own = filled(texts, answers, order + 1)
        score, k = Automaton(own, n_train, n_words, discounts).traverse(), len(own.sizes)
        seen = own.levels[0].total
        base = np.bincount(own.doc, np.log10((seen + 1) / (n_train + n_words + 1))[own.word], k)
        known = np.bincount(own.doc, seen[own.word] > 0, k).astype(np.int64)
        tv.release()
        return pa.table([own.ids, pa.array(own.held), pa.array(own.sizes.astype(np.int64)), pa.array(known), pa.array(np.full(k, n_train, np.int64)), pa.array(base), pa.array(score)], [x.split(" ")[0] for x in _SCORED.split(", ")])

    scored, _ = materialize(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(traverse, _SCORED), "scores")
    spark.sql(f"DROP TABLE {name}")
    remove(spark, *paths)
    return scored
