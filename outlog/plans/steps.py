"""Composable pipeline steps and the encoder catalog.

A step is any callable ``DataFrame -> DataFrame``; a pipeline is a list of steps applied in
order with ``DataFrame.transform``.  Anything that is not callable is rejected up front.
"""

from __future__ import annotations

from typing import Callable, Iterable

from pyspark.sql import DataFrame

Step = Callable[[DataFrame], DataFrame]

ENCODERS = {"w2v_encoder": "word2vec", "hash_encoder": "hash"}


def check_steps(steps: Iterable) -> list[Step]:
    out = list(steps)
    for s in out:
        if not callable(s):
            raise TypeError(f"pipeline step {s!r} is not a callable DataFrame -> DataFrame")
    return out


def run_steps(df: DataFrame, steps: Iterable[Step]) -> DataFrame:
    """Apply every step in order; a step must return a DataFrame."""
    for s in check_steps(steps):
        out = s(df)
        if not isinstance(out, DataFrame):
            raise TypeError(f"pipeline step {s!r} returned {type(out).__name__}, not a DataFrame")
        df = out
    return df


def get_encoder(name: str) -> str:
    """Encoder kind for a configured name; unknown names are an error."""
    if name not in ENCODERS:
        raise ValueError(f"unknown encoder {name!r} (known: {sorted(ENCODERS)})")
    return ENCODERS[name]
