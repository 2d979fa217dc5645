"""Ratios, vectors and generation arithmetic over columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once for each row and hand it to ``body``; inside of lambdas an expression is evaluated at each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v))


def softmax(a: Column) -> Column:
    """Softmax, shifted by the largest value."""
    shifted = let(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp(x.cast("double") - m)))
    return let(shifted, lambda e: let(F.aggregate(e, F.lit(0.0), lambda s, v: s + v), lambda total: F.transform(e, lambda x: x / total)))


def argmax(a: Column) -> Column:
    """Index of the first largest value; -1 for an empty array."""
    return (F.coalesce(F.array_position(a, F.array_max(a)), F.lit(0)) - 1).cast("int")


def standardise(a: Column, mean: Column, std: Column) -> Column:
    """(a - mean) / std by element."""
    return F.zip_with(F.zip_with(a, mean, lambda x, m: x.cast("double") - m), std, lambda x, s: x / s)


def unstandardise(a: Column, mean: Column, std: Column) -> Column:
    """a * std + mean by element."""
    return F.zip_with(F.zip_with(a, std, lambda x, s: x.cast("double") * s), mean, lambda x, m: x + m)


def interpolate(noise: Column, target: Column, t: float) -> Column:
    """(1 - t) * noise + t * target by element."""
    return F.zip_with(noise, target, lambda e, x: (1.0 - t) * e.cast("double") + t * x.cast("double"))


def velocity(noise: Column, target: Column) -> Column:
    """target - noise by element."""
    return F.zip_with(noise, target, lambda e, x: x.cast("double") - e.cast("double"))


def euler(start: Column, field, steps: int) -> Column:
    """Euler integration over [0, 1] of ``field(state, time)``, an expression."""
    if steps < 1:
        raise ValueError("at least one step")
    h = 1.0 / steps
    step = lambda z, k: F.zip_with(z, field(z, k * h), lambda a, v: a + h * v)
    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.transform(start, lambda x: x.cast("double")), step)


def time_embedding(t: Column, dim: int) -> Column:
    """Sines and cosines of a time; an odd dimension ends in 0."""
    half = dim // 2
    angles = [1000.0 * math.exp(-math.log(10000.0) * k / max(half, 1)) for k in range(half)]
    waves = [f(t * a) for f in (F.sin, F.cos) for a in angles]
    return F.array(*waves, *([F.lit(0.0)] if dim % 2 else []))


def beam_score(log_prob: Column, length: Column, alpha: float) -> Column:
    """Log probability by length to the power ``alpha``; the start mark doesn't count."""
    return log_prob / F.pow(F.greatest(length - 1, F.lit(1)).cast("double"), F.lit(alpha))
