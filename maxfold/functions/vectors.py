"""Vector expressions on array<double> columns, in the JVM, and the view of them as matrices for Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NORM_FLOOR = 1e-8


def dot(a: Column, b: Column) -> Column:
    """Inner product; of unit vectors, the cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), the value being computed once: used as it is within a lambda, an expression is computed for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def normalize(v: Column, floor: float = NORM_FLOOR) -> Column:
    """v over its length, the length being at least ``floor``: a zero vector stays zero."""
    return let(v, lambda a: let(F.greatest(norm(a), F.lit(floor)), lambda n: F.transform(a, lambda x: x / n)))


def preview(v: Column, n: int = 3) -> Column:
    return F.slice(v, 1, n)


def quantize(v: Column) -> Column:
    """8-bit codes of components in [-1, 1], saturating."""
    return F.transform(v, lambda x: F.floor(F.least(F.greatest((x + 1.0) * 127.5, F.lit(0.0)), F.lit(255.0))).cast("int"))


def hash_uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by '#': the same in every engine and run."""
    digest = F.md5(F.concat_ws("#", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_vector(key: Column, dim: int) -> Column:
    """A seeded unit vector of uniform(-1, 1) components: a random projection of a token type."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: hash_uniform(key, d.cast("string")) * 2.0 - 1.0)
    return normalize(raw)


def mock_embedding(key: Column, dim: int) -> Column:
    """A unit vector of normal components (Box-Muller) from a key."""
    pi2 = 6.283185307179586

    def normal(d: Column) -> Column:
        u1 = F.greatest(hash_uniform(key, F.concat(F.lit("a"), d.cast("string"))), F.lit(1e-9))
        return F.sqrt(-2.0 * F.log(u1)) * F.cos(pi2 * hash_uniform(key, F.concat(F.lit("b"), d.cast("string"))))

    return normalize(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), normal))


def biased(base: Column, noise: float, key: Column) -> Column:
    """base + noise * uniform(-1, 1), normalised: a synthetic neighbour."""
    return normalize(F.transform(base, lambda x, i: x + noise * (hash_uniform(key, i.cast("string")) * 2.0 - 1.0)))


def string_hash(text: Column) -> Column:
    """h = h * 31 + byte over the UTF-8 bytes, modulo 2**32."""
    places = F.sequence(F.lit(1), F.octet_length(text).cast("int"))
    step = lambda digits: F.aggregate(places, F.lit(0).cast("long"), lambda h, i: (h * 31 + F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long")) % 4294967296)
    hashed = let(F.hex(text.cast("binary")), step)
    return F.when(F.length(text) > 0, hashed).otherwise(F.lit(0).cast("long"))


def mean_by(df: DataFrame, keys: list[str], vector: str, out: str, *, unit: bool = True) -> DataFrame:
    """Component-wise mean of a vector column per group, normalised if ``unit``.

    One aggregate whose buffer is a vector: partial sums before the shuffle, and no row per component.
    """
    d = df.select(*keys, array_to_vector(vector).alias("_v")).groupBy(*keys).agg(Summarizer.mean(F.col("_v")).alias("_m"))
    d = d.select(*keys, vector_to_array("_m").alias(out))
    return d.withColumn(out, normalize(F.col(out))) if unit else d


def matrix(column: pa.Array) -> np.ndarray:
    """An Arrow batch of equally long vectors as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64, copy=False) if len(column) else np.zeros((0, 0))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)
