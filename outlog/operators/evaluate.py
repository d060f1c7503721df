"""Labelled validation data and evaluation against labels.

The validation set keeps the first 80 % of each service's lines (in line order) clean and
corrupts about one in ten of the remaining lines: ``round(len * entropy)`` random positions
are overwritten with random characters from ``chr(65)`` to ``chr(123)``.  Randomness comes
from seeded hashes of the line id, so a rerun or a retried task yields the same set.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..functions.ids import seeded_int
from ..functions.text import clean_whitespace
from .prefix import ordered_position


def _seeded(seed: int, tag: str, key: str, i: int) -> float:
    """Same number as ``functions.ids.seeded_unit(seed, tag, key parts..., i)``."""
    h = hashlib.md5(f"{seed}:{tag}:{key}:{i}".encode()).hexdigest()
    return int(h[:8], 16) / 4294967296.0


def corrupt_text(message: str | None, key: str, entropy: float, seed: int) -> str | None:
    """The per-line helper: ``round(len * entropy)`` sequential overwrites of seeded
    positions with seeded characters (a later write to a position wins)."""
    if message is None:
        return None
    chars = list(message)
    n = len(chars)
    span = C.VALIDATION_CHAR_HIGH - C.VALIDATION_CHAR_LOW + 1
    for i in range(round(n * entropy)):
        p = int(_seeded(seed, "pos", key, i) * n)
        chars[p] = chr(C.VALIDATION_CHAR_LOW + int(_seeded(seed, "chr", key, i) * span))
    return "".join(chars)


def corrupt(message: Column, id_cols: list[str], entropy: float = C.VALIDATION_ENTROPY,
            seed: int = C.VALIDATION_SEED) -> Column:
    """Corrupted message (an Arrow-batched pandas UDF around ``corrupt_text``).

    The overwrite loop is sequential per line and the positions come from seeded hashes,
    so a small vectorised Python helper is the direct form; it runs only on the rows
    chosen for corruption (see ``validation_set``).  Entropy above 1 is an error.
    """
    if entropy > 1:
        raise ValueError("entropy should be a real valued number between 0 and 1")

    @F.pandas_udf("string")
    def _corrupt(msg: pd.Series, key: pd.Series) -> pd.Series:
        return pd.Series([corrupt_text(m, k, entropy, seed) for m, k in zip(msg, key)], dtype=object)

    key = F.concat_ws(":", *[F.col(c).cast("string") for c in id_cols])
    return _corrupt(message, key)


def split_by_position(lines: DataFrame, group_col: str, order_cols: list[str],
                      share: float = C.VALIDATION_TRAIN_SHARE) -> DataFrame:
    """``(group, order cols..., position, is_test)``: position in line order per group and
    ``is_test`` for lines after the first ``share``.  Only the key columns take part (the
    message text is joined back by the caller when needed)."""
    keys = lines.select(group_col, *order_cols)
    pos = ordered_position(keys, order_cols, [group_col], "position")
    n = pos.groupBy(group_col).agg(F.max("position").alias("__n"))
    return (pos.join(n, group_col)
               .withColumn("is_test", (F.col("position") > F.bround(F.col("__n") * F.lit(share))).cast("int"))
               .drop("__n"))


def validation_set(lines: DataFrame, group_col: str, id_cols: list[str], seed: int = C.VALIDATION_SEED,
                   gate: int = C.VALIDATION_GATE, entropy: float = C.VALIDATION_ENTROPY) -> DataFrame:
    """``(ids..., message, label)``: stripped messages, the test part partly corrupted."""
    s = split_by_position(lines, group_col, id_cols).join(lines.select(*id_cols, "message"), id_cols)
    draw = seeded_int(seed, 1, 100, F.lit("gate"), *[F.col(c) for c in id_cols])
    label = F.when((F.col("is_test") == 1) & (draw >= gate), 1).otherwise(0)
    from ..session import cut_lineage

    msg = clean_whitespace(F.col("message"))
    out = cut_lineage(s.withColumn("label", label).withColumn("message", msg).select(*id_cols, "message", "label"))
    # a Python UDF would be evaluated for every row even under a CASE, so the corrupted
    # rows are split off, rewritten, and put back
    bad = out.where(F.col("label") == 1).withColumn("message", corrupt(F.col("message"), id_cols, entropy, seed))
    return out.where(F.col("label") == 0).unionByName(bad)


def confusion(predicted: DataFrame, actual: DataFrame, key: list[str], pred_col: str = "predicted",
              label_col: str = "actual") -> DataFrame:
    """TP, FP, FN, TN, precision and recall of 0/1 predictions against 0/1 labels."""
    j = predicted.join(actual, key)
    p, a = F.col(pred_col) == 1, F.col(label_col) == 1
    out = j.agg(F.sum((p & a).cast("long")).alias("tp"), F.sum((p & ~a).cast("long")).alias("fp"),
                F.sum((~p & a).cast("long")).alias("fn"), F.sum((~p & ~a).cast("long")).alias("tn"))
    return out.withColumn("precision", F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))) \
              .withColumn("recall", F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")))
