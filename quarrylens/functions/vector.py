"""Vector arithmetic on array<float> columns, built from higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import let


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the common length of both arrays, in double precision."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def dot_f32(a: Column, b: Column) -> Column:
    """The same, multiplied and added in single precision, left to right."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: (x * y).cast("float"))
    return F.aggregate(products, F.lit(0.0).cast("float"), lambda s, x: (s + x).cast("float"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either norm is 0."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def l2_normalize(v: Column) -> Column:
    """Unit length; vectors of norm 1e-12 or less stay as they are."""
    return let(norm(v), lambda n: F.when(n > 1e-12, F.transform(v, lambda x: (x.cast("double") / n).cast("float"))).otherwise(v))


def quantize_int8(v: Column) -> Column:
    """struct(qvec array<tinyint>, scale float): symmetric quantisation to -127..127, halves away from zero.

    A zero vector gives zeros and scale 0, an empty one an empty array and scale 0, null gives null.
    """
    top = F.coalesce(F.array_max(F.transform(v, lambda x: F.abs(x))), F.lit(0.0).cast("float"))

    def quantized(scale: Column) -> Column:
        step = lambda x: F.round((x / scale).cast("float").cast("double"))
        whole = lambda x: F.when(scale == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(-127.0), F.least(F.lit(127.0), step(x))))
        return F.struct(F.transform(v, lambda x: whole(x).cast("tinyint")).alias("qvec"), scale.alias("scale"))

    return F.when(v.isNotNull(), let((top / F.lit(127.0).cast("float")).cast("float"), quantized))


def dequantize_int8(qvec: Column, scale: Column) -> Column:
    return F.transform(qvec, lambda x: (x.cast("float") * scale).cast("float"))


def int8_dot(qa: Column, qb: Column, scale_a: Column, scale_b: Column) -> Column:
    """Integer dot product over the common length, scaled back."""
    n = F.least(F.size(qa), F.size(qb))
    products = F.zip_with(F.slice(qa, 1, n), F.slice(qb, 1, n), lambda x, y: x.cast("int") * y.cast("int"))
    return F.aggregate(products, F.lit(0), lambda s, x: s + x).cast("double") * scale_a.cast("double") * scale_b.cast("double")


def sigmoid(logit: Column) -> Column:
    return (1 / (1 + F.exp(-logit.cast("double")))).cast("float")


def literal(values) -> Column:
    """A query vector as an array<float> literal."""
    return F.array(*(F.lit(float(x)).cast("float") for x in values))
