"""Proportional stratified interleaving: every shard gets the mixture of the whole table.

Rows of a source are ranked in a seeded shuffled order; the fractional rank (rank + 1/2) / n
spreads each source evenly over (0, 1), so any contiguous cut of the order by fractional rank
holds every source in its share.  The law kept is ``rows``: shard counts differ by at most one.

Ranks come from two levels - a bucket number taken from the row's uniform key and a window
inside the bucket - so a source with a third of all rows is spread over many buckets and no
window holds more than about ``bucket_rows`` rows, at any input size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import hex_prefix, null_key, shuffle_key

BUCKET_ROWS = 2048


def _bucket_offsets(rows: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Rows before each bucket (within ``keys``): one row per bucket, no table data."""
    counts = rows.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return counts.select(*keys, bucket, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))


def interleave(df: DataFrame, n_shards: int, id_col: str = "doc_id", source_col: str = "source",
               seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``shard`` (int), ``slot`` (long, gapless from 0 in each shard) and ``frac`` to ``df``.

    A null source is a stratum of its own, a null id is an ordinary value, and repeated rows
    each take a slot of their own (their order among themselves is free).  An empty table
    gives an empty result.  All other columns are carried through untouched; columns that
    already bear the names ``shard``, ``slot`` or ``frac`` are replaced.  Texts travel through
    two exchanges if ``df`` has them, so pass the narrow columns and join back where that is
    cheaper.
    """
    own = [c for c in df.columns if c not in ("shard", "slot", "frac")]
    total = df.count()
    n_buckets = max(1, -(-total // bucket_rows))
    keyed = df.select(
        F.struct(*own).alias("_row"),
        null_key(F.col(source_col)).alias("_src"),
        shuffle_key(F.col(id_col), seed).alias("_key"),
    ).withColumn("_b", F.floor(hex_prefix(F.col("_key")) * n_buckets / F.lit(1 << 32)).cast("long"))

    before = _bucket_offsets(keyed, ["_src"], "_b")
    sizes = keyed.groupBy("_src").agg(F.count(F.lit(1)).alias("_size"))
    in_bucket = W.partitionBy("_src", "_b").orderBy("_key")
    ranked = (keyed.withColumn("_r", F.row_number().over(in_bucket) - 1)
              .join(before.join(sizes, "_src"), ["_src", "_b"])
              .withColumn("frac", (F.col("_before") + F.col("_r") + F.lit(0.5)) / F.col("_size"))
              .select("_row", "_src", "_key", "frac",
                      F.least(F.floor(F.col("frac") * n_buckets), F.lit(n_buckets - 1)).alias("_f")))

    offsets = _bucket_offsets(ranked.withColumn("_all", F.lit(0)), ["_all"], "_f").drop("_all")
    in_cut = W.partitionBy("_f").orderBy("frac", "_src", "_key")
    placed = (ranked.withColumn("_i", F.row_number().over(in_cut) - 1)
              .join(offsets, "_f")
              .withColumn("_pos", F.col("_before") + F.col("_i")))
    # the first position of shard s is ceil(s * n / shards)
    shard = F.expr(f"(_pos * {n_shards}L) div {max(total, 1)}L")
    first = F.expr(f"(shard * {max(total, 1)}L + {n_shards - 1}L) div {n_shards}L")
    return (placed.withColumn("shard", shard)
            .select("_row.*", F.col("shard").cast("int").alias("shard"),
                    (F.col("_pos") - first).cast("long").alias("slot"), "frac"))
