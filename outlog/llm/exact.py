"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Every step only looks closer at the groups that the step before left with two rows or more:

1. *length*: rows are counted by the length of their normalised text, a number per row.  There are at
   most ``sqrt(2 * characters)`` different lengths (a corpus holding lengths 1 .. m has m^2/2 characters),
   so the set of lengths with company is small; it is broadcast behind a check of its size.
2. *prefix hash*: rows of those lengths are counted by (length, hash of the first ``PREFIX`` characters).
3. *full hash*: rows whose prefix has company get the SHA-256 of their whole normalised text.

Texts move in no exchange unless the set of step 2 outgrows the broadcast limit; then that one join
shuffles.  After step 3 a row is its id, two numbers and a hash.  The groups of equal texts are reduced by
a partial aggregation; the few groups that hold more than a thousandth of the rows are broadcast to tell
their rows, all others are joined by hash (``common.join_groups``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import broadcast_if_small, cut_lineage
from .common import join_groups

PREFIX = 256       # characters of the normalised text behind the prefix hash
SPACES = " \t\n\x0b\x0c\r"
RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    """The text without white space of ASCII; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _with_company(keys: DataFrame, cols: list[str]) -> DataFrame:
    """The keys that two rows or more have, written out."""
    n = keys.groupBy(*cols).agg(F.count("*").alias("n"))
    return cut_lineage(n.where(F.col("n") > 1).select(*cols, F.lit(True).alias("company")))


def refine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False,
           keep_text: bool = True) -> DataFrame:
    """Rows of ``docs`` as ``row`` with ``id``, ``points``, ``len``, ``full`` (null: settled before step 3).

    ``hash_all`` gives the settled rows their full hash too, where their text is at hand anyway.
    """
    kept = [c for c in docs.columns if keep_text or c != text_col]
    row = F.struct(*[F.col(c) for c in kept]).alias("row") if kept else F.lit(None).cast("string").alias("row")
    norm = normalised(F.col("text"))
    base = docs.select(row, F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    base = base.withColumn("len", F.length(norm))

    lengths = _with_company(base.select("len"), ["len"])
    by_length = base.join(broadcast_if_small(lengths, row_bytes=32).withColumnRenamed("company", "same_len"),
                          "len", "left")
    prefix = F.when(F.col("same_len"), F.xxhash64(F.substring(norm, 1, PREFIX))).alias("prefix")
    by_length = by_length.select("row", "id", "text", "len", prefix)

    prefixes = _with_company(by_length.where(F.col("prefix").isNotNull()).select("len", "prefix"), ["len", "prefix"])
    by_prefix = by_length.join(broadcast_if_small(prefixes, row_bytes=48), ["len", "prefix"], "left")
    full = F.sha2(norm, 256)
    return by_prefix.select(
        "row", "id", "len", F.length(F.coalesce("text", F.lit(""))).alias("points"),
        F.coalesce("company", F.lit(False)).alias("open"),
        full.alias("full") if hash_all else F.when(F.col("company"), full).alias("full"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False,
                     keep_text: bool = True) -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical after deleting space, tab, newline, vertical tab, form feed and return.
    The row with the most code points in its original text stays, then the one with the smallest id (no id:
    last).  Null texts are empty, and empty texts are equal to each other.  Of rows that tie in all of this
    (a row repeated with its id) exactly one stays.  Columns of ``docs`` named like a result are replaced;
    all others, null or not, come back unchanged (the text only if ``keep_text``).  An empty table gives an
    empty result.  ``text_sha256`` is null for rows that length or prefix settled, unless ``hash_all``.
    """
    seen = refine(docs, id_col, text_col, hash_all, keep_text)
    seen = cut_lineage(seen.withColumn("n", F.monotonically_increasing_id()))   # numbers are fixed once written
    best = F.min(F.struct((-F.col("points")).alias("minus_points"), F.col("id").isNull().alias("no_id"), "id", "n"))
    groups = cut_lineage(seen.where("open").groupBy("len", "full")
                         .agg(best.alias("best"), F.count("*").alias("size")).where(F.col("size") > 1)
                         .select("len", "full", F.col("best.id").alias("best_id"), F.col("best.n").alias("best_n"), "size"))
    out = join_groups(seen, groups, ["len", "full"], "size", seen.count())
    alone = F.col("size").isNull()
    kept_cols = [c for c in docs.columns if (keep_text or c != text_col) and c not in RESULT]
    return out.select(
        *[F.col(f"row.`{c}`").alias(c) for c in kept_cols],
        F.when(alone, F.col("id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("best_n") == F.col("n"))).alias("kept"),
        F.col("full").alias("text_sha256"))
