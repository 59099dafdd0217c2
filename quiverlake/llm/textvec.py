"""Words of many texts at once: byte positions and 64-bit hashes by whole-array operations.

A word's hash is a polynomial in its bytes modulo 2**64, taken from one running sum, and then mixed. It
depends on the word alone. Equal words have equal hashes; for different words equality has odds of about 2**-64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)
_SLICE = 1 << 18
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: Byte classes: True where a byte separates words.
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[128:] = False
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    PUNCTUATION[_lo:_hi] = False


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_SLICE * 2, 1 << (n - 1).bit_length() if n > 1 else 1)
    if size not in _tables:
        out = []
        for base in (_P, _INV):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x, dtype=np.uint64))
        if size > _SLICE * 2:
            return out[0], out[1]
        _tables[size] = (out[0], out[1])
    return _tables[size]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, a newline after each; the offset at which each begins."""
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    offsets = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1] if len(texts) else np.zeros(0, np.int64)
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), offsets


def words(buf: np.ndarray, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``buf``, which ends with a separator."""
    inside = ~separators[buf]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edges = np.concatenate(([0], edges))
    return edges[::2], edges[1::2]


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash for each word, in slices of about 256 KB that are cut between words, so memory is bounded."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        k = max(i + 1, int(np.searchsorted(ends, lo + _SLICE, "right")))
        part = buf[lo : int(ends[k - 1])]
        power, inverse = _powers(len(part) + 1)
        total = np.empty(len(part) + 1, np.uint64)
        total[0] = 0
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=total[1:])
        s, e = starts[i:k] - lo, ends[i:k] - lo
        out[i:k] = mix((total[e] - total[s]) * inverse[s])
        i = k
    return out


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of ``k`` consecutive words; shorter by ``k - 1``. Callers drop those that cross a text's end."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(_P)
    return mix(out)


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in order, in slices whose texts hold about ``limit`` bytes (a longer text is a slice of its own)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def release() -> None:
    """Give memory that Arrow and the C library keep back to the system: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def bounds(table: pa.Table | pa.RecordBatch, keys: tuple[str, ...]) -> list[tuple[int, int]]:
    """Where each run of equal keys begins and ends."""
    if not table.num_rows:
        return []
    same = np.ones(table.num_rows - 1, bool)
    for c in keys:
        x = table.column(c).to_numpy()
        same &= x[1:] == x[:-1]
    cuts = [0, *(np.flatnonzero(~same) + 1).tolist(), table.num_rows]
    return list(zip(cuts, cuts[1:], strict=False))


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Sorted batches as tables that hold runs of equal keys whole."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        own = bounds(b, keys)
        key = lambda i, b=b: tuple(b.column(c)[i].as_py() for c in keys)
        if held and key(0) != last:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        if len(own) > 1:
            yield pa.Table.from_batches([*held, b.slice(0, own[-1][0])]).combine_chunks()
            held = []
        held.append(b.slice(own[-1][0]))
        last = key(b.num_rows - 1)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
