"""Signatures and bands: sign projections and MinHash."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The step between MinHash seeds and the multiplier.
SEED_STEP, MULTIPLIER = 0x517CC1B727220A95, 0x9E3779B97F4A7C15


def rows_per_band(num_hashes: int, num_bands: int) -> int:
    if num_hashes < 1 or num_bands < 1 or num_hashes % num_bands:
        raise ValueError(f"the number of hashes ({num_hashes}) must be divisible by the number of bands ({num_bands})")
    return num_hashes // num_bands


def planes(num_hashes: int, dim: int, kind: str = "uniform", seed: int = 12345) -> np.ndarray:
    """Unit normals of the hyperplanes, from uniform [0, 1) components (so vectors without negative components share all bits) or Gaussian ones."""
    rng = np.random.default_rng(seed)
    if kind not in ("uniform", "gaussian"):
        raise ValueError(f"unknown kind of planes: {kind}")
    p = rng.random((num_hashes, dim)) if kind == "uniform" else rng.standard_normal((num_hashes, dim))
    return p / np.linalg.norm(p, axis=1)[:, None]


def sign_signature(vec: Column, p: np.ndarray) -> Column:
    """Bit i is 1 if the vector's dot product with plane i is not negative; an Arrow batch is one matrix product."""

    @F.pandas_udf("array<int>")
    def signature(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        return pd.Series(list((np.stack(v.to_numpy()) @ p.T >= 0).astype(np.int32)))

    return signature(vec)


def sign_signature_expr(vec: Column, p: np.ndarray) -> Column:
    """The same without Python workers."""
    table = F.from_json(F.lit(str(p.tolist())), "array<array<double>>")
    return F.transform(table, lambda row: (F.aggregate(F.zip_with(row, vec, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) >= 0).cast("int"))


def as_set(vec: Column) -> Column:
    """Components as whole numbers, cut toward zero; negative ones and NaN are 0, those of 2**63 or more are 2**63 - 1; each once."""
    one = lambda x: F.when(F.isnan(x) | (x < 0), F.lit(0).cast("long")).when(x >= 2.0**63, F.lit(2**63 - 1)).otherwise(x.cast("long"))
    return F.array_distinct(F.transform(vec, one))


def minhash_signature(elements: Column, num_hashes: int) -> Column:
    """Slot i: the least of ``(e + i * step) * multiplier`` modulo 2**64 over the set, as the long with those bits; an empty set has zeros."""
    seeds = np.array([i * SEED_STEP % 2**64 for i in range(num_hashes)], np.uint64)

    @F.pandas_udf("array<long>")
    def signature(sets: pd.Series) -> pd.Series:
        sizes = np.array([len(s) for s in sets], np.int64)
        out = np.zeros((len(sets), num_hashes), np.uint64)
        full = sizes > 0
        if full.any():
            e = np.concatenate([s for s in sets if len(s)]).astype(np.int64).view(np.uint64)
            starts = np.concatenate(([0], np.cumsum(sizes[full])[:-1]))
            for i, s in enumerate(seeds):
                out[full, i] = np.minimum.reduceat((e + s) * np.uint64(MULTIPLIER), starts)
        return pd.Series(list(out.view(np.int64)))

    return signature(elements)


def sign_bands(signature: Column, num_bands: int, rows: int) -> Column:
    """Keys ``b{band}_{bits}``."""
    return F.transform(F.sequence(F.lit(0), F.lit(num_bands - 1)), lambda b: F.concat(F.lit("b"), b.cast("string"), F.lit("_"), F.array_join(F.transform(F.slice(signature, b * rows + 1, F.lit(rows)), lambda x: x.cast("string")), "")))


def minhash_bands(signature: Column, num_bands: int, rows: int) -> Column:
    """Keys ``m{band}_`` and the slots in 16 hex digits each."""
    return F.transform(F.sequence(F.lit(0), F.lit(num_bands - 1)), lambda b: F.concat(F.lit("m"), b.cast("string"), F.lit("_"), F.array_join(F.transform(F.slice(signature, b * rows + 1, F.lit(rows)), lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")))


def agreement(a: Column, b: Column, num_hashes: int) -> Column:
    """Estimated Jaccard similarity: the share of equal slots."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(num_hashes)
