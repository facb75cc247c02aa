"""Vector expressions over array columns, in double precision and inside the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


def as_vector(values: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def dot(a: Column, b: Column) -> Column:
    """Inner product; null where the lengths differ or a side is null."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity clipped to [-1, 1]; 0 for a zero vector, an empty one or unequal lengths."""
    lengths = norm(a) * norm(b)
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / lengths))
    return F.when((F.size(a) == F.size(b)) & (lengths > 0), clipped).otherwise(F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)))


#: Score of each metric, larger is nearer.
METRICS = {"cosine": cosine, "l2": lambda a, b: 0.0 - l2(a, b), "ip": dot}


@F.pandas_udf(BinaryType())
def float_bytes(vectors: pd.Series) -> pd.Series:
    """A vector as the bytes of its little-endian 32-bit floats; null stays."""
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def bytes_vector(blobs: pd.Series) -> pd.Series:
    """The vector of such bytes; null where they aren't a whole number of floats."""
    return blobs.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))
