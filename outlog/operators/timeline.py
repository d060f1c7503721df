"""Event-time operators that stay parallel when one key holds much of the data.

* ``trailing_count`` - rows of the same key in ``[ts - width, ts]`` (a RANGE window),
* ``next_at_or_after`` - for each probe time, the first row of the same key at or after it,
* ``greedy_gap`` - keep the first row, then the first row at least ``gap`` after the last
  kept one, and so on (alert re-notification suppression).

A plain ``Window.partitionBy(key)`` would send each key to one task.  Here time is cut
into buckets of the window width: a window reaches back at most one bucket, so every sort
happens inside ``(key, bucket)`` and the buckets' partial answers are joined.  The greedy
walk is composed from slices of time: each is walked by itself, and pointer doubling links
only the rows at which a walk can enter a slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage

SLICE_GAPS = 256  # gaps in a time slice of the greedy walk (work only, never results)


def _micros(ts_col: str):
    return F.unix_micros(F.col(ts_col).cast("timestamp"))


def trailing_count(df: DataFrame, ts_col: str, key_cols: list[str], width_s: float, id_col: str,
                   out_col: str = "trailing") -> DataFrame:
    """Add the number of rows with the same key and ``ts - width <= ts' <= ts``.

    Equal to ``count(*) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN width PRECEDING
    AND CURRENT ROW)``.  Rows are carried through the windows, so null keys form a group of
    their own and repeated ids stay apart.  ``id_col`` is not needed and kept for callers.
    """
    wm = int(round(width_s * 1_000_000))
    keys = list(key_cols)
    base = df.select(F.struct(*df.columns).alias("__row"), *[F.col(k) for k in keys], _micros(ts_col).alias("__t"))
    base = base.withColumn("__b", F.floor(F.col("__t") / F.lit(wm)))
    # rows of the own bucket up to and including ts (peers included)
    own = Window.partitionBy(*keys, "__b").orderBy("__t").rangeBetween(Window.unboundedPreceding, 0)
    rows = base.withColumn("__a", F.count(F.lit(1)).over(own))
    # each row is also a probe of the previous bucket: rows there at or after ts - width
    events = rows.select(*keys, "__b", "__t", F.lit(1).alias("__tag"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"),
                         F.lit(None).cast("long").alias("__a"))
    probes = rows.select(*keys, (F.col("__b") - 1).alias("__b"), (F.col("__t") - F.lit(wm)).alias("__t"), F.lit(0).alias("__tag"), "__row", "__a")
    later = (Window.partitionBy(*keys, "__b").orderBy(F.col("__t").desc(), F.col("__tag").desc())
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = events.unionByName(probes).withColumn("__prev", F.sum("__tag").over(later)).where(F.col("__tag") == 0)
    return both.select("__row.*", (F.col("__a") + F.col("__prev")).cast("long").alias(out_col))


def next_at_or_after(cands: DataFrame, probes: DataFrame, key_cols: list[str], bucket_us: int) -> DataFrame:
    """For each probe ``(key, __pid, __p)`` the first candidate ``(key, __cid, __ct)`` with
    ``(__ct, __cid) >= (__p, -inf)``; returns ``(__pid, __nid)`` (null when none exists).

    ``bucket_us`` is the bucket width in microseconds; a probe looks in its own bucket
    first, then in the first non-empty later bucket (a table of one row per bucket).
    """
    keys = list(key_cols)
    c = cands.select(*keys, F.col("__ct").alias("__t"), F.col("__cid").alias("__id"),
                     F.lit(1).alias("__tag"), F.lit(None).cast("string").alias("__pid"))
    c = c.withColumn("__b", F.floor(F.col("__t") / F.lit(bucket_us)))
    p = probes.select(*keys, F.col("__p").alias("__t"), F.lit(None).cast(cands.schema["__cid"].dataType).alias("__id"),
                      F.lit(0).alias("__tag"), F.col("__pid").cast("string").alias("__pid"))
    p = p.withColumn("__b", F.floor(F.col("__t") / F.lit(bucket_us)))
    # same bucket: scan newest-first, the last candidate seen is the nearest one at/after the probe
    w = (Window.partitionBy(*keys, "__b").orderBy(F.col("__t").desc(), F.col("__tag").desc(), F.col("__id").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inb = (c.unionByName(p).withColumn("__near", F.last("__id", ignorenulls=True).over(w))
             .where(F.col("__tag") == 0).select("__pid", *keys, "__b", "__near"))
    # later buckets: first candidate of the first non-empty bucket after the probe's bucket
    firsts = (c.groupBy(*keys, "__b").agg(F.min(F.struct("__t", "__id")).alias("__f"))
               .select(*keys, "__b", F.col("__f.__id").alias("__fid"), F.lit(1).alias("__tag")))
    pb = p.select(*keys, "__b").distinct().withColumn("__fid", F.lit(None).cast(firsts.schema["__fid"].dataType)) \
          .withColumn("__tag", F.lit(0))
    wb = (Window.partitionBy(*keys).orderBy(F.col("__b").desc(), F.col("__tag"))
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    later = (firsts.unionByName(pb).withColumn("__later", F.last("__fid", ignorenulls=True).over(wb))
                   .where(F.col("__tag") == 0).select(*keys, "__b", "__later"))
    return (inb.join(later, keys + ["__b"], "left")
               .select(F.col("__pid"), F.coalesce("__near", "__later").alias("__nid")))


def greedy_gap(df: DataFrame, ts_col: str, key_cols: list[str], gap_s: float, id_col: str,
               slice_gaps: int = SLICE_GAPS) -> DataFrame:
    """Rows kept by greedy minimum-gap selection per key (ties by ``id_col``).

    The first row of each key is kept; after a kept row at ``t`` the next kept row is the first one at ``t + gap``
    or later.  Null keys are a group of their own, rows without a time are never kept, and a gap of zero or
    less keeps every row with a time.  No key is gathered: time is cut into slices of ``slice_gaps`` gaps.  One pass from the latest to the
    earliest row of a (key, slice) finds for every row the last row kept in the slice when the walk enters
    there; only rows at which a walk can enter a slice are linked by pointer doubling, which finds each slice's true
    entry, and a second pass walks every slice from it.  The walk itself touches (key, time) pairs, not rows.
    """
    gm = int(round(gap_s * 1_000_000))
    if gm <= 0:
        return df.where(F.col(ts_col).isNotNull())
    # null keys are a group of their own: joins and groups below see one never-null text key
    key = F.concat_ws(",", *[F.coalesce(F.concat(F.length(F.col(k).cast("string")), F.lit("="), F.col(k).cast("string")), F.lit("-"))
                             for k in key_cols]).alias("__k")
    rows = df.select(key, F.col(id_col).alias("__cid"), _micros(ts_col).alias("__t")).where(F.col("__t").isNotNull())
    # of equal times only the smallest id can be kept
    times = rows.groupBy("__k", "__t").agg(F.min("__cid").alias("__id"))
    times = cut_lineage(times.withColumn("__s", F.floor(F.col("__t") / F.lit(gm * slice_gaps))))
    starts = _slice_entries(times, gm, slice_gaps)
    walked = (times.join(starts, ["__k", "__s"]).repartition("__k", "__s").sortWithinPartitions("__k", "__s", "__t")
                   .select("__k", "__s", "__t", "__e", "__id"))
    kept = walked.mapInPandas(_walk_slices(gm), walked.select("__id").schema)
    kept = cut_lineage(kept)
    return df.join(kept, df[id_col] == kept["__id"], "left_semi")


def _slice_entries(times: DataFrame, gm: int, slice_gaps: int) -> DataFrame:
    """``(__k, __s, __e)``: the time at which the walk of a key enters a slice (slices it skips are left out)."""
    late_first = times.select("__k", "__s", "__t").repartition("__k", "__s") \
                      .sortWithinPartitions("__k", "__s", F.col("__t").desc())
    exits = late_first.mapInPandas(_slice_exits(gm), "__k string, __s long, __t long, __x long")
    # a walk leaves a slice less than a gap before the next one, so it enters within that one's first gap or, when
    # no row is left there, at the first row behind it
    early = F.col("__t") - F.col("__s") * F.lit(gm * slice_gaps) < F.lit(gm)
    exits = exits.withColumn("__early", early)
    first_late = Window.partitionBy("__k", "__s", "__early").orderBy("__t")
    doors = cut_lineage(exits.withColumn("__n", F.row_number().over(first_late))
                             .where(F.col("__early") | (F.col("__n") == 1)).select("__k", "__s", "__t", "__x"))
    probes = doors.select("__k", F.concat_ws("@", F.col("__x"), F.col("__k")).alias("__pid"),
                          (F.col("__x") + F.lit(gm)).alias("__p"), "__x").distinct()
    after = next_at_or_after(doors.select("__k", F.col("__t").alias("__cid"), F.col("__t").alias("__ct")),
                             probes.select("__k", "__pid", "__p"), ["__k"], gm)
    following = (probes.join(after, "__pid").where(F.col("__nid").isNotNull())
                       .select("__k", "__x", F.col("__nid").alias("__to")))
    links = doors.join(following, ["__k", "__x"]).select("__k", F.col("__t").alias("__from"), "__to")
    heads = doors.groupBy("__k").agg(F.min("__t").alias("__e"))
    # only heads and rows that some exit leads to are ever entered
    entered = heads.unionByName(links.select("__k", F.col("__to").alias("__e"))).distinct()
    links = cut_lineage(links.join(entered.withColumnRenamed("__e", "__from"), ["__k", "__from"], "left_semi"))
    on_walk = _orbit(cut_lineage(heads), links)
    return on_walk.select("__k", F.floor(F.col("__e") / F.lit(gm * slice_gaps)).alias("__s"), "__e")


def _orbit(heads: DataFrame, links: DataFrame) -> DataFrame:
    """Every ``(__k, __e)`` reached from the heads by ``links``: ``A <- A + J(A)``, ``J <- J o J``.

    Before round r the set holds the first 2^r steps of every walk and J jumps 2^r, so a step is never
    met twice and a round adds only what is new; it ends when no jump of that length is left.
    """
    found = heads
    while not links.isEmpty():
        step = (found.join(links, (found["__k"] == links["__k"]) & (found["__e"] == links["__from"]))
                     .select(links["__k"], F.col("__to").alias("__e")))
        found = cut_lineage(found.unionByName(step))
        a, b = links.alias("a"), links.alias("b")
        links = cut_lineage(a.join(b, (F.col("a.__k") == F.col("b.__k")) & (F.col("a.__to") == F.col("b.__from")))
                             .select("a.__k", "a.__from", "b.__to"))
    return found


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Pieces of batches that lie in one (key, slice); a slice may span many batches."""
    for b in batches:
        if len(b):
            k, s = b["__k"].to_numpy(), b["__s"].to_numpy()
            cut = np.flatnonzero((k[1:] != k[:-1]) | (s[1:] != s[:-1])) + 1
            for lo, hi in zip([0, *cut], [*cut, len(b)]):
                yield (k[lo], s[lo]), b.iloc[lo:hi]


def _slice_exits(gm: int):
    """Rows of a slice, latest first -> the time of the last row kept when the walk enters at the row.

    Rows less than a gap apart do not meet, so they are judged together.  Of the later rows only those up to a gap away
    are held, as steps of equal exits.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ends, exits = None, None, None
        for name, part in _segments(batches):
            if name != at:
                at, ends, exits = name, np.empty(0, np.int64), np.empty(0, np.int64)
            t = part["__t"].to_numpy()
            x, lo = np.empty_like(t), 0
            while lo < len(t):
                hi = lo + int(np.searchsorted(-t[lo:], gm - t[lo], "left"))
                own, j = t[lo:hi], np.searchsorted(ends, t[lo:hi] + gm, "left")
                x[lo:hi] = np.append(exits, 0)[j]
                x[lo:hi][j == len(ends)] = own[j == len(ends)]
                far = int(np.searchsorted(ends, own[-1] + gm, "left")) + 1
                ends, exits = np.append(own[::-1], ends[:far]), np.append(x[lo:hi][::-1], exits[:far])
                last = np.append(exits[1:] != exits[:-1], True)
                ends, exits, lo = ends[last], exits[last], hi
            yield part[["__k", "__s", "__t"]].assign(__x=x)

    return run


def _walk_slices(gm: int):
    """Rows of a slice, earliest first, with its entry -> ids of the rows that the walk keeps."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, due = None, 0
        for name, part in _segments(batches):
            if name != at:
                at, due = name, int(part["__e"].iloc[0])
            t, keep = part["__t"].to_numpy(), []
            i = int(np.searchsorted(t, due, "left"))
            while i < len(t):
                keep.append(i)
                due = int(t[i]) + gm
                i = int(np.searchsorted(t, due, "left"))
            if keep:
                yield part[["__id"]].iloc[keep]

    return run
