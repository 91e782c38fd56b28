"""Group-wise symmetric quantisation and vector functions on arrays, within the row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def groups(values: Column, size: int) -> Column:
    """The values in groups of so many; the last is filled up with zeros."""
    n = F.ceil(F.size(values) / size).cast("int")
    part = lambda i: F.slice(values, i * size + 1, size)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(part(i), F.array_repeat(F.lit(0.0), F.lit(size) - F.size(part(i)))))


def quantised(values: Column, size: int, top: int) -> Column:
    """array<struct<scale, codes>>: scale = largest magnitude / top (1 for zeros), codes rounded half to even within -top and top."""
    scale = lambda g: F.array_max(F.transform(g, F.abs)) / top
    safe = lambda g: F.when(scale(g) == 0, 1.0).otherwise(scale(g))
    code = lambda x, s: F.greatest(F.lit(-top), F.least(F.lit(top), F.rint(x / s).cast("int")))
    scaled = F.transform(groups(values, size), lambda g: F.struct(safe(g).alias("scale"), g.alias("g")))
    return F.transform(scaled, lambda p: F.struct(p["scale"].alias("scale"), F.transform(p["g"], lambda x: code(x, p["scale"])).alias("codes")))


def restored(packed: Column) -> Column:
    return F.flatten(F.transform(packed, lambda p: F.transform(p["codes"], lambda c: c * p["scale"])))


def packed_nibbles(codes: Column) -> Column:
    """Signed 4-bit codes as bytes (numbers), the first code in the low half."""
    pair = lambda i: F.element_at(codes, 2 * i + 1).bitwiseAND(15) + F.shiftleft(F.coalesce(F.try_element_at(codes, 2 * i + 2), F.lit(0)).bitwiseAND(15), 4)
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(codes) / 2).cast("int") - 1), pair)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: inside a lambda an expression would be computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def softmax(values: Column) -> Column:
    parts = _let(F.array_max(values), lambda top: F.transform(values, lambda x: F.exp(x - top)))
    return _let(parts, lambda p: _let(_sum(p), lambda total: F.transform(p, lambda x: x / total)))


def layer_norm(values: Column, epsilon: float = 1e-5) -> Column:
    centred = _let(_sum(values) / F.size(values), lambda mean: F.transform(values, lambda x: x - mean))
    return _let(centred, lambda c: _let(F.sqrt(dot(c, c) / F.size(c) + epsilon), lambda spread: F.transform(c, lambda x: x / spread)))


def gelu(x: Column) -> Column:
    return 0.5 * x * (1 + F.tanh(F.lit((2 / 3.141592653589793) ** 0.5) * (x + 0.044715 * x * x * x)))


def argmax(values: Column) -> Column:
    """The place (from 0) of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def unpacked_nibbles(packed: Column, n: Column) -> Column:
    """The n signed 4-bit codes in packed bytes, the low half of a byte first."""
    signed = lambda v: F.when(v > 7, v - 16).otherwise(v)
    both = F.flatten(F.transform(packed, lambda b: F.array(signed(b.bitwiseAND(15)), signed(F.shiftright(b, 4)))))
    return F.slice(both, 1, n)


def mixed_product(weights: Column, activations: Column) -> Column:
    """The product of two vectors in groups (scale, codes): whole numbers within a group, scaled and summed over groups."""
    inner = lambda a, b: F.aggregate(F.zip_with(a["codes"], b["codes"], lambda x, y: x * y), F.lit(0), lambda s, x: s + x) * a["scale"] * b["scale"]
    return _sum(F.zip_with(weights, activations, inner))


def matvec(matrix: Column, vector: Column) -> Column:
    """The products of each row of a matrix with a vector."""
    return F.transform(matrix, lambda row: dot(row, vector))


def group_means(values: Column, size: int) -> Column:
    """Neighbouring parts of so many values as their mean: the heads of keys and values shared by a group."""
    return F.transform(groups(values, size), lambda g: _sum(g) / size)
