"""Invariants of event counts: sparse linear relations with small whole coefficients that windows obey.

A window (a session, an order, a minute) has a vector x of how often each event occurs in it; a relation
theta holds there if theta . x = 0.  The mean square of theta . x over all windows is theta' G theta / n with
the Gram matrix G = sum x x', whole numbers summed in one distributed pass.  A set of events can only carry
a relation if the smallest eigenvalue of its part of G is small enough (theta' G theta >= lambda |theta|^2), so
the sets are pruned by their near-null vectors and the few left are tried with all small coefficients.
A second pass counts where each relation holds, and lists the windows that break it.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

MAX_EVENTS = 256      # events the Gram matrix is built for: 256 x 256 numbers reach the driver
MAX_TERMS, MAX_COEF = 5, 2


def window_vectors(events: DataFrame, window_col: str, event_col: str) -> tuple[DataFrame, list[str]]:
    """(window, x) of all windows and the events behind the places of x, in order of their names.

    Rows without window or event are left out.  More than ``MAX_EVENTS`` different events are refused:
    pass templates of a known set, as a relation of rare events needs no matrix of all of them.
    """
    rows = events.where(F.col(window_col).isNotNull() & F.col(event_col).isNotNull()) \
        .groupBy(F.col(window_col).alias("window"), F.col(event_col).cast("string").alias("event")).agg(F.count("*").alias("n"))
    rows = cut_lineage(rows)
    names = [r[0] for r in rows.select("event").distinct().limit(MAX_EVENTS + 1).collect()]
    if len(names) > MAX_EVENTS:
        raise ValueError(f"more than {MAX_EVENTS} different events")
    names.sort()
    each = [F.sum(F.when(F.col("event") == e, F.col("n")).otherwise(0)) for e in names]
    return cut_lineage(rows.groupBy("window").agg(F.array(*each).cast("array<bigint>").alias("x"))), names


def gram(vectors: DataFrame, m: int) -> tuple[np.ndarray, int]:
    """Sum of x x' over all windows, in whole numbers, and their count."""
    def part(batches):
        g, n = np.zeros((m, m), np.int64), 0
        for b in batches:
            if b.num_rows:
                x = b["x"].flatten().to_numpy().reshape(b.num_rows, m)
                g += x.T @ x
                n += b.num_rows
        if n:
            i, j = np.nonzero(g)
            yield pa.record_batch([pa.array(np.append(i, m)), pa.array(np.append(j, m)), pa.array(np.append(g[i, j], n))], ["i", "j", "s"])

    got = vectors.select("x").mapInArrow(part, "i long, j long, s long").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    g, n = np.zeros((m, m), np.int64), 0
    for r in got:
        if r["i"] == m:
            n = r["s"]
        else:
            g[r["i"], r["j"]] = r["s"]
    return g, n


def relations(g: np.ndarray, n: int, tolerance: float, max_terms: int = MAX_TERMS, max_coef: int = MAX_COEF) -> list[tuple[int, ...]]:
    """All minimal relations of 2 to ``max_terms`` events whose mean square is at most ``tolerance``.

    Coefficients lie within ``max_coef``, have no common divisor, and the first is positive; a set of events
    that contains the events of a smaller relation is passed over.
    """
    m, found, taken = len(g), [], []
    coefs = [c for c in range(-max_coef, max_coef + 1) if c]
    limit = tolerance * n
    for size in range(2, min(max_terms, m) + 1):
        new = []
        for events in itertools.combinations(range(m), size):
            if any(t <= set(events) for t in taken):
                continue
            part = g[np.ix_(events, events)]
            scale = float(np.trace(part))
            if np.linalg.eigvalsh(part.astype(float))[0] * size > limit + 1e-9 * scale:
                continue            # every relation of all these events has |theta|^2 >= size
            for theta in itertools.product(coefs[len(coefs) // 2:], *[coefs] * (size - 1)):
                t = np.array(theta, np.int64)
                if math.gcd(*theta) == 1 and int(t @ part @ t) <= limit:
                    full = [0] * m
                    for e, c in zip(events, theta, strict=True):
                        full[e] = c
                    found.append(tuple(full))
                    new.append(set(events))
        taken += new
    return found


def spelled(theta: tuple[int, ...], names: list[str]) -> str:
    return " + ".join(f"{c}*{e}" for c, e in zip(theta, names, strict=True) if c)


def mine(events: DataFrame, window_col: str, event_col: str, tolerance: float = 0.02, max_terms: int = MAX_TERMS,
         max_coef: int = MAX_COEF) -> tuple[DataFrame, DataFrame]:
    """Relations (invariant, n_terms, n_windows, n_broken, mean_square), and the windows that break them
    (window, invariant, value).  ``tolerance`` bounds the mean square, and so the share of broken windows."""
    vectors, names = window_vectors(events, window_col, event_col)
    spark, m = vectors.sparkSession, len(names)
    g, n = gram(vectors, m) if m else (np.zeros((0, 0), np.int64), 0)
    kept = relations(g, n, tolerance, max_terms, max_coef) if n else []
    theta = np.array(kept, np.int64).reshape(len(kept), m)
    text = [spelled(t, names) for t in kept]

    def broken(batches):
        for b in batches:
            if not b.num_rows or not len(theta):
                continue
            v = b["x"].flatten().to_numpy().reshape(b.num_rows, m) @ theta.T
            row, rel = np.nonzero(v)
            if len(row):
                yield pa.record_batch([b["window"].take(pa.array(row)), pa.array([text[k] for k in rel], pa.string()), pa.array(v[row, rel])],
                                      ["window", "invariant", "value"])

    kind = vectors.schema["window"].dataType.simpleString()
    breaks = cut_lineage(vectors.select("window", "x").mapInArrow(broken, f"window {kind}, invariant string, value long"))
    told = spark.createDataFrame([(s, sum(c != 0 for c in t), n) for s, t in zip(text, kept, strict=True)],
                                 "invariant string, n_terms int, n_windows long")
    sums = breaks.groupBy("invariant").agg(F.count("*").alias("n_broken"), F.sum(F.col("value") * F.col("value")).alias("squares"))
    out = told.join(sums, "invariant", "left").select(
        "invariant", "n_terms", "n_windows", F.coalesce("n_broken", F.lit(0)).cast("long").alias("n_broken"),
        (F.coalesce("squares", F.lit(0)) / F.col("n_windows")).alias("mean_square"))
    return out, breaks
