"""Vector arithmetic on arrays, inside the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def l2_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distance_similarity(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)


def bm25_similarity(score: Column, strict: bool = True) -> Column:
    """1 / (1 - score) of a negative score.

    Strictly as the engine we match does it, stronger matches have smaller
    values; otherwise strength s = -score gives s / (1 + s).
    """
    return F.lit(1.0) / (F.lit(1.0) - score) if strict else -score / (F.lit(1.0) - score)


def to_bytes(vector: Column) -> Column:
    """A vector as little-endian 32-bit floats, for stores that keep vectors so; null stays null."""

    @F.pandas_udf("binary")
    def encode(column: pd.Series) -> pd.Series:
        return column.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return encode(vector)


def from_bytes(raw: Column) -> Column:
    """The vector that to_bytes has written; bytes after its last whole number are passed over."""

    @F.pandas_udf("array<float>")
    def decode(column: pd.Series) -> pd.Series:
        return column.map(lambda b: None if b is None else np.frombuffer(b, "<f4", len(b) // 4))

    return decode(raw)
