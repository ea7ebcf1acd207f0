"""Expressions on ARRAY<DOUBLE> vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-12


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Over the shorter of the two."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def valid(a: Column) -> Column:
    """Whether a is a usable vector: not empty, all numbers, longer than TINY."""
    return a.isNotNull() & (F.size(a) > 0) & ~F.exists(a, lambda x: x.isNull() | F.isnan(x)) & (norm(a) > TINY)


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def unit(a: Column) -> Column:
    """a at length 1; null if it isn't usable."""
    whole = a.isNotNull() & (F.size(a) > 0) & ~F.exists(a, lambda x: x.isNull() | F.isnan(x))
    return F.when(whole, let(norm(a), lambda n: F.when(n > TINY, F.transform(a, lambda x: x / n))))


def cosine(a: Column, b: Column) -> Column:
    """0 where either isn't usable."""
    return F.coalesce(F.when(valid(a) & valid(b), dot(a, b) / norm(a) / norm(b)), F.lit(0.0))


def unit_cosine(a: Column, b: Column) -> Column:
    """cosine() of vectors that are of length 1 or null."""
    return F.coalesce(dot(a, b), F.lit(0.0))


def rms_db(power: Column) -> Column:
    """Decibels of a mean square of 16-bit samples."""
    return F.when(power.isNull() | (power <= 0), F.lit(-120.0)).otherwise(20 * F.log10(F.sqrt(power) / 32768))


def total(p: Column) -> Column:
    return F.aggregate(p, F.lit(0.0), lambda s, x: s + x)


def softmax(p: Column) -> Column:
    e = let(F.array_max(p), lambda m: F.transform(p, lambda x: F.exp(x - m)))
    return let(e, lambda v: let(total(v), lambda t: F.transform(v, lambda x: x / t)))


def softmax_rows(df: DataFrame, column: str, matrix: tuple[str, ...]) -> DataFrame:
    """Adds shares and replaces column by its softmax, unless the whole matrix (the rows that agree in the columns `matrix`)
    already holds shares: numbers from 0 to 1, each row's sum above 0 and at most 1.2."""
    p = F.col(column)
    row = ~F.exists(p, lambda x: (x < 0) | (x > 1)) & (total(p) > 0) & (total(p) <= 1.2)
    rows = df.withColumn("shares", F.bool_and(row).over(Window.partitionBy(*matrix)))
    return rows.withColumn(column, F.when(F.col("shares"), p).otherwise(softmax(p)))


def int16_samples(pcm: Column) -> Column:
    """Little-endian 16-bit samples of a binary column as numbers from -1 to 1."""
    raw = F.hex(pcm)
    pair = lambda i: F.conv(F.concat(F.substring(raw, 4 * i + 3, F.lit(2)), F.substring(raw, 4 * i + 1, F.lit(2))), 16, 10).cast("int")
    n = F.floor(F.octet_length(pcm) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: let(pair(i), lambda v: F.when(v >= 32768, v - 65536).otherwise(v) / 32768.0))).otherwise(F.array().cast("array<double>"))
