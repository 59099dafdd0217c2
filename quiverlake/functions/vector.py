"""Vector functions as Column expressions over ``ARRAY<DOUBLE>`` (and float or short arrays where named).

Two vectors of unlike length raise "Vector sizes does not match, a != b" when the row is evaluated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _same_size(a: Column, b: Column, value: Column) -> Column:
    said = F.concat(F.lit("Vector sizes does not match, "), F.size(a).cast("string"), F.lit(" != "), F.size(b).cast("string"))
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(said))


def _sum(v: Column, kind: str = "double") -> Column:
    return F.aggregate(v, F.lit(0).cast(kind), lambda s, x: s + x)


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def total(v) -> Column:
    """Sum of the components."""
    return _sum(_col(v))


def dot(a, b) -> Column:
    a, b = _col(a), _col(b)
    return _same_size(a, b, _sum(F.zip_with(a, b, lambda x, y: x * y)))


def l2_squared(a, b) -> Column:
    a, b = _col(a), _col(b)
    return _same_size(a, b, _sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def l2(a, b) -> Column:
    return F.sqrt(l2_squared(a, b))


def magnitude(v) -> Column:
    v = _col(v)
    return F.sqrt(_sum(F.transform(v, lambda x: x * x)))


def normalized(v) -> Column:
    """Scaled by the reciprocal of its length; a zero vector stays."""
    v = _col(v)
    return F.when(magnitude(v) > 0, scaled(v, F.lit(1.0) / F.nullif(magnitude(v), F.lit(0.0)))).otherwise(v)


def cosine(a, b) -> Column:
    """Zero if either vector is zero."""
    a, b = _col(a), _col(b)
    size = magnitude(a) * magnitude(b)
    return F.when((magnitude(a) == 0) | (magnitude(b) == 0), _same_size(a, b, F.lit(0.0))).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0)))


def _cosine(product: Column, a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), product * 0.0).otherwise(product / F.nullif(a * b, F.lit(0.0)))


def add(a, b) -> Column:
    a, b = _col(a), _col(b)
    return _same_size(a, b, F.zip_with(a, b, lambda x, y: x + y))


def subtract(a, b) -> Column:
    a, b = _col(a), _col(b)
    return _same_size(a, b, F.zip_with(a, b, lambda x, y: x - y))


def scaled(v, c) -> Column:
    c = c if isinstance(c, Column) else F.lit(float(c))
    return F.transform(_col(v), lambda x: x * c)


def divided(v, c: float) -> Column:
    """By the reciprocal, so the last bit can differ from a division."""
    return scaled(v, 1.0 / c)


def absolute(v) -> Column:
    return F.transform(_col(v), lambda x: F.abs(x))


def equal(a, b) -> Column:
    """False for unlike lengths. Spark's rules hold: 0.0 equals -0.0, and NaN equals NaN."""
    return _col(a) == _col(b)


def element(v, i: int) -> Column:
    """Null beyond the end."""
    return F.get(_col(v), F.lit(i))


def length(v) -> Column:
    return F.size(_col(v))


def is_empty(v) -> Column:
    return F.size(_col(v)) == 0


def display(v) -> Column:
    """``[1.0, 2.0]``."""
    return F.concat(F.lit("["), F.array_join(F.transform(_col(v), lambda x: x.cast("string")), ", "), F.lit("]"))


def content_hash(v) -> Column:
    return F.xxhash64(_col(v))


# single precision: differences and products are rounded to float, then summed as double


def f32_dot(a, b) -> Column:
    a, b = _col(a), _col(b)
    return _same_size(a, b, _sum(F.zip_with(a, b, lambda x, y: (x.cast("float") * y.cast("float")).cast("double"))))


def f32_l2_squared(a, b) -> Column:
    a, b = _col(a), _col(b)
    gap = lambda x, y: (x.cast("float") - y.cast("float")).cast("double")
    return _same_size(a, b, _sum(F.zip_with(a, b, lambda x, y: gap(x, y) * gap(x, y))))


def f32_add(a, b) -> Column:
    a, b = _col(a), _col(b)
    return _same_size(a, b, F.zip_with(a, b, lambda x, y: x.cast("float") + y.cast("float")))


def f32_subtract(a, b) -> Column:
    a, b = _col(a), _col(b)
    return _same_size(a, b, F.zip_with(a, b, lambda x, y: x.cast("float") - y.cast("float")))


def f32_magnitude(v) -> Column:
    return F.sqrt(f32_dot(v, v))


def f32_cosine(a, b) -> Column:
    """Zero if either vector is zero."""
    return _cosine(f32_dot(a, b), f32_magnitude(a), f32_magnitude(b))


def f32_scaled(v, c: float) -> Column:
    return F.transform(_col(v), lambda x: x.cast("float") * F.lit(c).cast("float"))


# unsigned bytes, held as shorts from 0 to 255


def _byte(x: Column) -> Column:
    return F.floor(F.least(F.greatest(x, F.lit(0)), F.lit(255))).cast("short")


def u8_add(a, b) -> Column:
    a, b = _col(a), _col(b)
    return _same_size(a, b, F.zip_with(a, b, lambda x, y: _byte(x.cast("int") + y.cast("int"))))


def u8_subtract(a, b) -> Column:
    a, b = _col(a), _col(b)
    return _same_size(a, b, F.zip_with(a, b, lambda x, y: _byte(x.cast("int") - y.cast("int"))))


def u8_scaled(v, c: float) -> Column:
    return F.transform(_col(v), lambda x: _byte(x.cast("double") * F.lit(c)))


def u8_dot(a, b) -> Column:
    a, b = _col(a), _col(b)
    return _same_size(a, b, _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def u8_magnitude(v) -> Column:
    return F.sqrt(u8_dot(v, v))


def u8_cosine(a, b) -> Column:
    """Zero if either vector is zero."""
    return _cosine(u8_dot(a, b), u8_magnitude(a), u8_magnitude(b))


def u8_normalized(v) -> Column:
    """Scaled by the reciprocal of its length and cut to whole bytes; a zero vector stays."""
    v = _col(v)
    size = u8_magnitude(v)
    return F.when(size > 0, F.transform(v, lambda x: _byte(x.cast("double") * (F.lit(1.0) / F.nullif(size, F.lit(0.0)))))).otherwise(v)


def u8_l2(a, b) -> Column:
    a, b = _col(a), _col(b)
    return F.sqrt(_same_size(a, b, _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))))


def quantized(v) -> Column:
    """Components clamped to 0..1, times 255, cut to whole bytes."""
    return F.transform(_col(v), lambda x: F.floor(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) * 255).cast("short"))


def mean_centered(df: DataFrame, vec: str = "vec") -> DataFrame:
    """``df`` with the mean vector taken off. The mean is a grouped average by position: one row per dimension is all that meets."""
    mean = df.select(F.posexplode(vec).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"))
    mean = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean_vec"))
    row = mean.first()
    return df.withColumn(vec, subtract(F.col(vec), F.array(*[F.lit(x) for x in (row[0] or [])]).cast("array<double>"))) if row[0] else df
