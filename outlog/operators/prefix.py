"""Running sums and row positions over a long ordered sequence without a one-task window.

``sum(x) OVER (PARTITION BY p ORDER BY o ROWS UNBOUNDED PRECEDING)`` puts every row of a
partition key into one task.  When a key is a whole batch or a whole service that task
holds a large share of the data.  Here the order is cut into blocks (sampled ranges
of key and order columns): running sums are taken inside each ``(key, block)``, block totals are
prefix-summed (a table of one row per block, broadcast back), and the two are added.
The result is exactly the running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


ROWS_PER_BLOCK = 50_000


def running_sum(df: DataFrame, value: Column | str, order_cols: list[str], partition_cols: list[str] = (),
                out_col: str = "running", block: Column | None = None, n_blocks: int | None = None) -> DataFrame:
    """``out_col`` = running sum of ``value`` along ``order_cols`` within ``partition_cols``.

    Blocks are sampled ranges over all partition and order columns, so a constant or skewed
    first order column does not fill one block; their number follows the row count.  Rows with
    null keys form a group of their own and null order values come first, as in an ascending
    sort.  ``block``, if given, must not decrease along ``order_cols``.  ``order_cols`` should
    be unique within a partition.  The input is written out once with its block numbers.
    """
    from ..session import broadcast_if_small, cut_lineage
    partition_cols = list(partition_cols)
    v = F.col(value) if isinstance(value, str) else value
    if block is None:
        n = n_blocks or max(1, -(-df.count() // ROWS_PER_BLOCK))
        placed = df.repartitionByRange(n, *partition_cols, *order_cols).withColumn("__blk", F.spark_partition_id())
    else:
        placed = df.withColumn("__blk", block)
    base = cut_lineage(placed.withColumn("__v", v))
    local = (Window.partitionBy(*partition_cols, "__blk").orderBy(*[F.col(c) for c in order_cols])
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    with_local = base.withColumn("__local", F.sum("__v").over(local))
    totals = base.groupBy(*partition_cols, "__blk").agg(F.sum("__v").alias("__tot"))
    prior = (Window.partitionBy(*partition_cols).orderBy("__blk")
             .rowsBetween(Window.unboundedPreceding, -1))
    keys = partition_cols + ["__blk"]
    offsets = totals.select(*[F.col(c).alias(f"__k_{c}") for c in keys],
                            F.coalesce(F.sum("__tot").over(prior), F.lit(0)).alias("__off"))
    offsets = broadcast_if_small(cut_lineage(offsets), row_bytes=64)        # one row per (key, block)
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"__k_{c}"))
    out = with_local.join(offsets, same)
    return (out.withColumn(out_col, F.col("__local") + F.col("__off"))
            .drop("__blk", "__v", "__local", "__off", *[f"__k_{c}" for c in keys]))


def ordered_position(df: DataFrame, order_cols: list[str], partition_cols: list[str] = (),
                     out_col: str = "position", block: Column | None = None, n_blocks: int | None = None) -> DataFrame:
    """1-based row position along ``order_cols`` (``row_number``) within ``partition_cols``."""
    return running_sum(df, F.lit(1), order_cols, partition_cols, out_col, block, n_blocks)
