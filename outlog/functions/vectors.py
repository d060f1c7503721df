"""Vector-valued Column expressions over ``array<double>`` columns.

These are the per-row maths of the detectors written as higher-order functions, so they run
inside whole-stage code generation; the dense distance searches against a model use numpy
inside Arrow batches instead (see ``outlog.operators.som``).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import _c, ColumnOrName


def as_double_array(c: ColumnOrName) -> Column:
    return F.transform(_c(c), lambda x: x.cast("double"))


def squared_distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)),
                       F.lit(0.0), lambda acc, x: acc + x)


def euclidean(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Euclidean distance of two equal-length arrays."""
    return F.sqrt(squared_distance(a, b))


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0),
                       lambda acc, x: acc + x)


def norm(a: ColumnOrName) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: ColumnOrName, b: ColumnOrName) -> Column:
    """``1 - a.b / (|a||b|)``; null when either vector has zero length."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def concat_vectors(cols: list[ColumnOrName], dim: int) -> Column:
    """Concatenate per-column embeddings; a missing embedding becomes ``dim`` zeros."""
    return F.flatten(F.array(*[F.coalesce(_c(c), zeros(dim)) for c in cols]))


def learning_rate(total: int, t: int) -> float:
    """Linear decay ``(T - t) / T``; 0 when ``T`` is 0 (an epoch-level constant)."""
    return 0.0 if total == 0 else (total - t) / total


def neighbourhood(grid_distance: ColumnOrName) -> Column:
    """Map-update kernel ``exp(-d / 2)`` on the grid distance between two nodes."""
    return F.exp(-_c(grid_distance) / F.lit(2.0))


def grid_distance(r1: ColumnOrName, c1: ColumnOrName, r2: ColumnOrName, c2: ColumnOrName) -> Column:
    dr = _c(r1) - _c(r2)
    dc = _c(c1) - _c(c2)
    return F.sqrt((dr * dr + dc * dc).cast("double"))


def hash_unit(key: Column) -> Column:
    """A deterministic number in [0, 1) from the first 32 bits of ``md5(key)``."""
    return F.conv(F.substr(F.md5(key), F.lit(1), F.lit(8)), 16, 10).cast("bigint") / F.lit(4294967296.0)


def hash_vector(word: ColumnOrName, dim: int, seed: int = 1) -> Column:
    """Seeded pseudo-random vector for a word, components in ``[-0.5/dim, 0.5/dim)``.

    Stands in for the random initial vector a word gets when it joins a vocabulary
    without training; being a pure function of (seed, word, i) it is the same on every
    executor and on every retry.
    """
    w = _c(word)
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda i: (hash_unit(F.concat_ws(":", F.lit(str(seed)), w, i.cast("string"))) - F.lit(0.5))
        / F.lit(float(dim)))
