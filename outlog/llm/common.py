"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A word is a run of bytes other than space, tab, newline, vertical tab, form feed, return.
# bytes.split() without arguments splits at exactly this set.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = " \t\n\x0b\x0c\r"
_WORD_RE = re.compile(WORD)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(c: Column) -> Column:
    """Array of the words of a text (null: empty array)."""
    parts = F.split(F.coalesce(c, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def word_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _WORD_RE.finditer(text)]


def null_key(c: Column) -> Column:
    """A never-null string key for a nullable column (null and the text 'null' stay apart)."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))


def tasks(df: DataFrame) -> int:
    """How many tasks a Python pass after an exchange should have: the session's setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def shuffle_key(row_id: Column, seed: int) -> Column:
    """32 hex digits that order rows in a seeded pseudorandom way, the same on every run."""
    return F.md5(F.concat(F.lit(f"{seed}:"), null_key(row_id)))


def hex_prefix(key: Column) -> Column:
    """The first eight hex digits of a shuffle key as a number in 0 .. 2^32-1."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


HOT_SHARE = 1024   # groups that hold more than one row in 1,024: there are fewer than 1,024 of them


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """``rows`` left-joined with ``groups`` (one row per key) by keys that may hold any share of the rows.

    ``size`` of a group is its number of rows, ``total`` that of all.  Groups above ``total / HOT_SHARE`` are
    broadcast, as there are fewer than ``HOT_SHARE``; all others meet in a shuffle join without hot keys.
    Both tables should be written ones; other columns of ``groups`` must not be named like those of ``rows``.
    """
    limit = max(1, total // HOT_SHARE)
    more = [c for c in groups.columns if c not in keys]
    hot = F.broadcast(groups.where(F.col(size) > limit).select(*keys, F.struct(*more).alias("_hot")))
    met = rows.join(hot, keys, "left")
    rest = met.where(F.col("_hot").isNull()).drop("_hot").join(groups.where(F.col(size) <= limit), keys, "left")
    return met.where(F.col("_hot").isNotNull()).select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in more]) \
        .unionByName(rest)


def gives_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a pass of ``mapInArrow``, whose freed memory goes back to the system when a task ends.

    Spark keeps Python workers for later tasks, and a worker keeps what its allocators have freed: the tables of
    one step would stand beside those of the next, and beside a JVM that needs them.
    """
    @functools.wraps(run)
    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
                ctypes.CDLL(None).malloc_trim(0)

    return passes


BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``, after lowering the session's limits for Arrow batches to a few MB of text.

    A batch is held several times at once (by the JVM, by pyarrow, as Python strings), so its size
    sets the working memory of a task.  Smaller limits of the session stay; results never depend on them.
    """
    conf = df.sparkSession.conf
    for name, limit in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = conf.get(key).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= limit):
            conf.set(key, str(limit))
    return df


def slices(batch: pa.RecordBatch, column: str, budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch holding about ``budget`` characters or values of ``column`` (one row at least)."""
    kind = batch.schema.field(column).type
    size = pc.list_value_length(batch[column]) if pa.types.is_list(kind) else pc.binary_length(batch[column])
    sizes = size.fill_null(0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > budget:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


def contiguous_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal keys, from batches of a partition sorted by them."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b[k].to_pylist() for k in keys]
        rows = list(zip(*cols, strict=True))
        start = 0
        for i in range(1, len(rows) + 1):
            if i < len(rows) and rows[i] == rows[start]:
                continue
            if held and held_key != rows[start]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(start, i - start))
            held_key = rows[start]
            start = i
    if held:
        yield pa.Table.from_batches(held)


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold every row of each of their keys, from a partition sorted by ``key``.

    Only the rows of the last key met so far are held back.
    """
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        first = pc.index(t[key], t[key][t.num_rows - 1]).as_py()
        if first:
            yield t.slice(0, first).combine_chunks()
        held = t.slice(first)
    if held is not None:
        yield held.combine_chunks()


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (counts[i] numbers) for every i, one after the other."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))
