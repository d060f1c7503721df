"""Subspace detector: what the leading principal components do not explain of a row is its score.

Mean and covariance are merged about the means (``som.weighted_moments``: nothing cancels).  The score is the
squared prediction error, the squared length of a row's part outside the normal subspace; its limit follows
from the eigenvalues left out (the approximation of Jackson and Mudholkar), so no quantile is counted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .som import weighted_moments


@dataclass
class Subspace:
    """A mean, orthonormal components as rows, and the eigenvalues of all directions, largest first."""

    mean: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray

    def limit(self, alpha: float = 0.001) -> float:
        """The squared error that a normal row exceeds with probability ``alpha``; 0 if nothing is left out."""
        rest = np.clip(self.eigenvalues[len(self.components):], 0, None)
        a, b, c = (float((rest ** k).sum()) for k in (1, 2, 3))
        if a <= 0:
            return 0.0
        h = 1 - 2 * a * c / (3 * b * b)
        z = NormalDist().inv_cdf(1 - alpha)
        if h <= 0:      # one far-leading direction: a scaled chi-square with its first two moments
            k = a * a / b
            return b / a * k * (1 - 2 / (9 * k) + z * math.sqrt(2 / (9 * k))) ** 3
        return a * max(0.0, z * math.sqrt(2 * b * h * h) / a + 1 + b * h * (h - 1) / (a * a)) ** (1 / h)


def fit(df: DataFrame, vec_col: str, explained: float = 0.95, weight_col: str | None = None) -> Subspace:
    """The fewest principal components that explain ``explained`` of the variance."""
    mean, cov = weighted_moments(df, vec_col, weight_col)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    values, vectors = np.clip(values[order], 0, None), vectors[:, order]
    total = values.sum()
    k = int(np.searchsorted(np.cumsum(values) / total, explained - 1e-12) + 1) if total > 0 else 0
    return Subspace(mean, vectors[:, :min(k, len(values))].T.copy(), values)


def score(df: DataFrame, vec_col: str, space: Subspace, out_col: str = "spe") -> DataFrame:
    """``df`` with the squared prediction error of each row (null vector: null); narrow, no shuffle."""
    mean, parts = space.mean, space.components

    def work(batches):
        for b in batches:
            v = b[vec_col]
            there = v.is_valid().to_numpy(zero_copy_only=False)
            x = v.drop_null().flatten().to_numpy().reshape(-1, len(mean)) - mean
            rest = x - (x @ parts.T) @ parts if len(parts) else x
            out = np.zeros(b.num_rows)
            out[there] = (rest * rest).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, mask=~there)], [*b.schema.names, out_col])

    return df.mapInArrow(work, T.StructType(df.schema.fields + [T.StructField(out_col, T.DoubleType())]))
