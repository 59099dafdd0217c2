"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts just those sequences that the merges produce. It starts as one state with a loop for each byte. Each merge (u, v), in order, is a
gadget: where an arc u leads to a state with an arc v, a new arc uv goes to a new state, a copy of v's, and the state after u loses its arc v. As a state
is known by the token that led to it, a gadget is one new row (a copy of v's), one new column (a copy of u's, without the arc just lost) and one
lost arc. Rows and columns are kept as they are made: a copy is a default, the row or column copied and the time, and what is written out are the
lost arcs, one a gadget, in place of the square of the vocabulary. A merge that finds no arc v after u makes no state. Reading an arc goes from a row or column to
what it was copied from, until it meets a lost arc or two bytes; arcs that were read are kept in a bounded table.

Every prefix of a word has one accepted sequence. A word is read byte by byte, from left to right: a table of all labels (Aho-Corasick) gives the arcs that could
end at a byte, and the one that the state at its beginning has gives the state here. Nothing is taken back. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

#: How the byte-level format splits a text into words.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_CACHE = 100_000
_ARCS = 250_000
_LONG = 64


_ID = struct.Struct("<I")


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _byte_letters() -> dict[str, int]:
    """The format writes a byte as its Latin-1 letter if that is printable and no space, others as letters from U+0100 in turn."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown}
    for b in range(256):
        if b not in shown:
            letters[chr(0x100 + len(letters) - len(shown))] = b
    return letters


class Automaton:
    """Compiled from a tokenizer file of the byte-level BPE kind."""

    def __init__(self, spec: str | bytes):
        spec = json.loads(spec)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError("only byte-level BPE without a normalizer is supported")
        if any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("added tokens that strip or need whole words are not supported")
        letters = _byte_letters()
        self.labels = [b""] * (1 + max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]))
        ids = model["vocab"]
        for token, i in ids.items():
            self.labels[i] = bytes(letters[c] for c in token)
        self.time, self.row, self.column, self.lost = {}, {}, {}, {}
        self.states = {i for i in ids.values() if len(self.labels[i]) == 1}
        for time, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self._gadget(time, ids[a], ids[b], ids[a + b])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            self.labels[i] = token.encode()
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.ending = ahocorasick.Automaton()
        for token in self.states:
            self.ending.add_word(self.labels[token].decode("latin-1"), (len(self.labels[token]), token))
        self.ending.make_automaton()
        self.arcs: dict[int, bool] = {}
        self.words = _Words(self)

    def _gadget(self, time: int, u: int, v: int, uv: int) -> None:
        if uv in self.states or u not in self.states or v not in self.states or not self._read(u, v, time):
            return
        self.states.add(uv)
        self.time[uv], self.row[uv], self.column[uv] = time, v, u
        self.lost[u, v] = time

    def _read(self, x: int, y: int, time: float) -> bool:
        """Whether the state after token ``x`` had an arc ``y`` before the gadget of that time."""
        lost, made = self.lost.get, self.time.get
        while lost((x, y), time) >= time:
            at_x, at_y = made(x, -1), made(y, -1)
            if at_x < 0 and at_y < 0:
                return True
            if at_y >= at_x:
                time, y = at_y + 0.5, self.column[y]  # copied after the gadget's loss
            else:
                time, x = at_x, self.row[x]  # copied before it
        return False

    def arc(self, x: int, y: int) -> bool:
        """Whether the state after token ``x`` has an arc ``y``."""
        key = x << 24 | y
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= _ARCS:
                self.arcs.clear()
            known = self.arcs[key] = self._read(x, y, float("inf"))
        return known

    def word(self, word: bytes) -> list[int]:
        """The accepted sequence of a word."""
        known, arc, states, begins, here = self.arcs.get, self.arc, [-1], [0], 0
        for end, (size, token) in self.ending.iter(word.decode("latin-1")):
            if end == here - 1:
                continue  # the state here is known
            at = end + 1 - size
            if at:
                x = states[at]
                ok = known(x << 24 | token)
                if ok is None:
                    ok = arc(x, token)
                if not ok:
                    continue
            states.append(token)
            begins.append(at)
            here += 1
            if here != end + 1:
                break
        if here != len(word):
            raise ValueError("the vocabulary lacks a byte")
        out = []
        while here:
            out.append(states[here])
            here = begins[here]
        out.reverse()
        return out

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if self.split_added is None or not any(t in text for t in self.added):
            return self._plain(text)
        return b"".join(self.added[p].to_bytes(4, "little") if p in self.added else self._plain(p) for p in self.split_added.split(text) if p)

    def _plain(self, text: str) -> bytes:
        if len(self.words) > _CACHE:
            self.words.turn()
        return b"".join(map(self.words.__getitem__, WORDS.findall(text)))

    def decode(self, ids: bytes) -> str:
        labels = self.labels
        return b"".join([labels[i] for (i,) in _ID.iter_unpack(ids)]).decode("utf-8", "replace")


class _Words(dict):
    """Encoded words in two generations, so frequent ones stay; long ones are not kept."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton, self.before = automaton, {}

    def turn(self) -> None:
        self.before = dict(self)
        self.clear()

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            ids = _packed(self.automaton.word(word.encode()))
        if len(word) <= _LONG:
            self[word] = ids
        return ids


@lru_cache(2)
def automaton(spec: bytes) -> Automaton:
    return Automaton(spec)


def _mapped(df: DataFrame, path: str, schema: str, step) -> DataFrame:
    with open(path, "rb") as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = automaton(spec.value)
        for b in batches:
            for part in tv.slices(b, b.schema.names[-1], 1 << 21):
                yield step(own, part)
        tv.release()

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids)`` for each row: the whole text's token ids as little-endian unsigned 32-bit integers.

    ``path`` names a byte-level BPE tokenizer file on the driver. Null text counts as empty and gives no tokens. Strings of added tokens inside a
    text become those tokens. Rows are independent: repeated and null doc_ids are kept; other columns are not read.
    """

    def step(own: Automaton, b: pa.RecordBatch) -> pa.RecordBatch:
        ids = [own.encode(t or "") for t in b.column(1).to_pylist()]
        return pa.record_batch([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return _mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), path, "doc_id long, n_tokens long, ids binary", step)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded(doc_id, n_tokens, ids)`` -> the same with ``decoded``, the text of the tokens' bytes (malformed UTF-8 replaced). Null ids: empty text."""

    def step(own: Automaton, b: pa.RecordBatch) -> pa.RecordBatch:
        text = [own.decode(x or b"") for x in b.column(2).to_pylist()]
        return pa.record_batch([*b.columns, pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return _mapped(encoded.select("doc_id", "n_tokens", "ids"), path, "doc_id long, n_tokens long, ids binary, decoded string", step)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded, intact)`` for each row: ``encode`` and ``decode`` in one pass, and whether the text came back. Edge cases are theirs."""

    def step(own: Automaton, b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in b.column(1).to_pylist()]
        ids = [own.encode(t) for t in texts]
        back = [own.decode(x) for x in ids]
        return pa.record_batch([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(back, pa.string()), pa.array([x == t for x, t in zip(back, texts, strict=True)], pa.bool_())], ["doc_id", "n_tokens", "ids", "decoded", "intact"])

    return _mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), path, "doc_id long, n_tokens long, ids binary, decoded string, intact boolean", step)
