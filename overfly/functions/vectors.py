"""Vector expressions over array columns, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a lambda binds it, so what reads it in a nested lambda does not repeat it for each element."""
    return F.transform(F.array(value), body)[0]


def _dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def dot(a: Column, b: Column) -> Column:
    return _dot(doubles(a), doubles(b))


def norm(a: Column) -> Column:
    return let(doubles(a), lambda v: F.sqrt(_dot(v, v)))


def _scaled(v: Column) -> Column:
    return let(F.struct(v.alias("v"), (F.sqrt(_dot(v, v)) + 1e-12).alias("n")), lambda s: F.transform(s["v"], lambda x: x / s["n"]))


def normalise(a: Column) -> Column:
    """Unit length; 1e-12 is added to the norm, so a zero vector stays zero."""
    return let(doubles(a), _scaled)


def fuse(a: Column, b: Column, alpha: Column) -> Column:
    """Normalised alpha*a + (1-alpha)*b."""
    mixed = lambda s: F.zip_with(s["a"], s["b"], lambda x, y: s["w"] * x + (1 - s["w"]) * y)
    return let(let(F.struct(doubles(a).alias("a"), doubles(b).alias("b"), alpha.alias("w")), mixed), _scaled)


def _pair(a: Column, b: Column, body) -> Column:
    return let(F.struct(doubles(a).alias("a"), doubles(b).alias("b")), lambda s: body(s["a"], s["b"]))


def cosine(a: Column, b: Column) -> Column:
    """The dot product of both scaled to unit length; 1e-12 is added to each norm."""
    return _pair(a, b, lambda x, y: _dot(x, y) / ((F.sqrt(_dot(x, x)) + 1e-12) * (F.sqrt(_dot(y, y)) + 1e-12)))


def root_l1(a: Column) -> Column:
    """Square roots of the vector scaled to sum 1 (1e-8 is added to the sum)."""
    root = lambda s: F.transform(s["v"], lambda x: F.sqrt(x / s["t"]))
    return let(F.transform(doubles(a), F.abs), lambda v: let(F.struct(v.alias("v"), (_sum(v) + 1e-8).alias("t")), root))


def _centred(v: Column) -> Column:
    return let(F.struct(v.alias("v"), (_sum(v) / F.size(v)).alias("m")), lambda s: F.transform(s["v"], lambda x: x - s["m"]))


def ncc(a: Column, b: Column) -> Column:
    """Normalised cross-correlation: the cosine of the mean-centred vectors; null if one is constant."""
    both = let(F.struct(doubles(a).alias("a"), doubles(b).alias("b")), lambda s: F.struct(_centred(s["a"]).alias("a"), _centred(s["b"]).alias("b")))
    return let(both, lambda s: F.try_divide(_dot(s["a"], s["b"]), F.sqrt(_dot(s["a"], s["a"])) * F.sqrt(_dot(s["b"], s["b"]))))


def unit_score(c: Column) -> Column:
    """A cosine as a score of [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (c + 1) / 2))
