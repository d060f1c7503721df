"""Mixing sources to target weights over fixed-length blocks of words.

The documents of a source, in a seeded shuffled order, form one stream of words that is cut
into blocks of ``block_words`` words.  Source targets become whole numbers of block slots; the
slots are dealt to output shards by multinomial draws whose sums are corrected to the targets;
the slots of a source are numbered through and mapped, one epoch after the other, through
pseudorandom permutations of its block indices; slots and blocks are joined by index.  Every
epoch uses a block at most once, so no document is taken more often than its source's epochs.

Only per-source totals (one row per source) reach the driver.  Offsets in a stream are two-level
prefix sums over hash buckets, so a source with a third of all rows is no hot task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import gives_back, hex_prefix, null_key, shuffle_key, word_spans, words

WEIGHTS = (5, 2, 1)  # by code point of the source, null last, repeating
MAX_EPOCHS = 3  # a target stops at this many times its source's size
BLOCK_WORDS = 64
BUCKET_ROWS = 2048
SLOTS_PER_TASK = 1 << 20


@dataclass(frozen=True)
class Mix:
    """A drawn mixture: numbers per source and shard; a few numbers per source, no data."""

    keys: list[str]  # null_key of the sources, in weight order
    sizes: list[int]  # words
    targets: list[float]
    blocks: list[int]  # blocks of a source
    slots: list[int]  # slots of a source
    counts: np.ndarray  # slots by shard and source
    seed: int
    block_words: int


def share(sizes: list[int], weights: list[float], cap: float = MAX_EPOCHS) -> list[float]:
    """Split the sum of sizes by weight; shares stop at ``cap`` times the own size and the excess
    is shared again by weight among the others until none is above."""
    left, target = float(sum(sizes)), [0.0] * len(sizes)
    active = [i for i in range(len(sizes))]
    while active:
        total = sum(weights[i] for i in active)
        over = [i for i in active if left * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in active:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = float(cap * sizes[i])
        left -= sum(target[i] for i in over)
        active = [i for i in active if i not in set(over)]
    return target


def draw_counts(slots: list[int], n_shards: int, seed: int) -> np.ndarray:
    """Multinomial slot counts of each shard, corrected so that every source's sum is its slots.

    What a source's draws miss (or exceed) is spread evenly over the shards; a count that would
    fall below zero hands the rest to the next shard.
    """
    total = sum(slots)
    counts = np.zeros((n_shards, len(slots)), np.int64)
    if not total:
        return counts
    p = np.array(slots, float) / total
    for k in range(n_shards):
        size = total * (k + 1) // n_shards - total * k // n_shards
        counts[k] = np.random.default_rng([seed, k]).multinomial(size, p)
    for s, want in enumerate(slots):
        miss, carry = want - int(counts[:, s].sum()), 0
        for k in range(n_shards):
            x = int(counts[k, s]) + miss * (k + 1) // n_shards - miss * k // n_shards + carry
            counts[k, s], carry = max(x, 0), min(x, 0)
        for k in range(n_shards):  # a rest below zero at the last shard
            take = min(-carry, int(counts[k, s]))
            counts[k, s] -= take
            carry += take
    return counts


def permute(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A keyed pseudorandom permutation of 0 .. n-1 at the indices ``i`` (a Feistel network over
    the next power of four, walked until the value is inside)."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(float))).astype(np.int64) + 1) // 2)
    half = np.where((np.int64(1) << (2 * half)) < n, half + 1, half).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, n, key = i.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    todo = np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            h, m, k = half[todo], mask[todo], key[todo]
            left, right = x[todo] >> h, x[todo] & m
            for r in range(4):
                z = right + k + np.uint64((0x9E3779B97F4A7C15 * (r + 1)) & 0xFFFFFFFFFFFFFFFF)
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & m)
            x[todo] = (left << h) | right
            todo = todo[x[todo] >= n[todo]]
    return x.astype(np.int64)


def numbered(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
             seed: int = 29, keep_text: bool = True) -> DataFrame:
    """Rows of ``df`` with a number of their own, written once: ``_row`` (all columns, the text only if
    ``keep_text``), ``_n``, ``_src``, ``_size`` (words), and what orders them, ``_key`` and ``_tie``.

    A null text has no words, a null source is a source of its own, rows without id share one key.  Rows
    that share an id are ordered by size and text; rows that repeat wholly are interchangeable, so reruns
    agree.  All columns of ``df`` stay in ``_row``, whatever their names.  Empty tables stay empty.
    """
    kept = [c for c in df.columns if keep_text or c != text_col]
    rows = df.select(F.struct(*kept).alias("_row"), null_key(F.col(source_col)).alias("_src"),
                     F.size(words(F.col(text_col))).cast("long").alias("_size"),
                     shuffle_key(F.col(id_col), seed).alias("_key"), F.xxhash64(text_col).alias("_tie"))
    return cut_lineage(rows.withColumn("_n", F.monotonically_increasing_id()))


def streams(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``_n``, ``_src``, ``_size`` and ``_start`` of ``numbered`` rows: each row's place in its source's
    stream of words.  Written to the shared folder, so later steps see the same places; texts stay behind."""
    n_buckets = max(1, -(-rows.count() // bucket_rows))
    rows = rows.select("_n", "_src", "_size", "_key", "_tie") \
        .withColumn("_b", F.floor(hex_prefix(F.col("_key")) * n_buckets / F.lit(1 << 32)))
    w = W.partitionBy("_src", "_b").orderBy("_key", "_size", "_tie", "_n").rowsBetween(W.unboundedPreceding, -1)
    rows = cut_lineage(rows.withColumn("_in", F.coalesce(F.sum("_size").over(w), F.lit(0))))
    totals = rows.groupBy("_src", "_b").agg(F.sum("_size").alias("_t"))
    before = W.partitionBy("_src").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_src", "_b", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_before"))
    return cut_lineage(rows.join(totals, ["_src", "_b"])
                       .select("_n", "_src", "_size", (F.col("_before") + F.col("_in")).alias("_start")))


def draw(placed: DataFrame, weights=WEIGHTS, n_shards: int = 64, seed: int = 29,
         block_words: int = BLOCK_WORDS, cap: int = MAX_EPOCHS) -> Mix:
    """Draw the mixture for the sources of ``streams`` rows (one row per source comes to the driver)."""
    got = {r["_src"]: r["n"] or 0 for r in placed.groupBy("_src").agg(F.sum("_size").alias("n")).collect()}
    keys = sorted(got, key=lambda k: (k == "-", k))
    sizes = [int(got[k]) for k in keys]
    targets = share(sizes, [weights[i % len(weights)] for i in range(len(keys))], cap)
    blocks = [-(-s // block_words) for s in sizes]
    slots = []
    for size, target, n in zip(sizes, targets, blocks, strict=True):
        epochs = math.floor(target / size) if size else 0
        slots.append(epochs * n + (min(n, round((target - epochs * size) / block_words)) if size else 0))
    return Mix(keys, sizes, targets, blocks, slots, draw_counts(slots, n_shards, seed), seed, block_words)


def slots(spark, mix: Mix) -> DataFrame:
    """One row per slot of the output: shard, slot (in the shard), src (index), epoch, block."""
    flat = mix.counts.ravel()  # shard by shard, source by source
    ends = np.cumsum(flat)
    n_src = max(1, len(mix.keys))
    first = np.cumsum(mix.counts, axis=0) - mix.counts  # slots of the source in earlier shards
    n_blocks, seed = np.array(mix.blocks, np.int64), mix.seed

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b["id"].to_numpy()
            cell = np.searchsorted(ends, i, side="right")
            shard, src = cell // n_src, cell % n_src
            j = i - (ends[cell] - flat[cell]) + first[shard, src]
            n = n_blocks[src]
            epoch = j // n
            block = permute(j % n, n, (src * 1_000_003 + epoch) * 7919 + seed)
            in_shard = i - np.append(0, ends)[shard * n_src]
            # the order inside a shard: another permutation of its slots
            size = np.append(0, ends)[(shard + 1) * n_src] - np.append(0, ends)[shard * n_src]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.astype(np.int32)), pa.array(permute(in_shard, size, shard * 31 + seed)),
                 pa.array(src.astype(np.int32)), pa.array(epoch.astype(np.int32)), pa.array(block)],
                ["shard", "slot", "src", "epoch", "block"])

    total = int(ends[-1]) if len(ends) else 0
    ids = spark.range(0, total, 1, max(1, -(-total // SLOTS_PER_TASK)))
    return ids.mapInArrow(run, "shard int, slot long, src int, epoch int, block long")


def pieces(placed: DataFrame, mix: Mix) -> DataFrame:
    """Rows with words, cut at block edges: _n, src, block, ``lo``/``hi`` (words of the row)."""
    spark = placed.sparkSession
    names = spark.createDataFrame([(k, i) for i, k in enumerate(mix.keys)] or [("", -1)], "_src string, src int")
    b = mix.block_words
    spans = placed.where("_size > 0").join(names, "_src").select(
        "_n", "src", "_start", "_size",
        F.explode(F.sequence(F.expr(f"_start div {b}"), F.expr(f"(_start + _size - 1) div {b}"))).alias("block"))
    lo, hi = F.greatest(F.col("block") * b, F.col("_start")), F.least((F.col("block") + 1) * b, F.col("_start") + F.col("_size"))
    return spans.select("_n", "src", "block", (lo - F.col("_start")).alias("lo"), (hi - F.col("_start")).alias("hi"))


def taken_words(rows: DataFrame, placed: DataFrame, mix: Mix) -> DataFrame:
    """``_row`` of all ``numbered`` rows with size, source_size, target, taken (words the mix takes of the
    row) and ``shards``: how many of these each output shard receives, by the shards' drawn counts.

    Rows without words take nothing; a null source is a source of its own (last in the order).
    """
    spark = placed.sparkSession
    uses = slots(spark, mix).groupBy("src", "block", "shard").agg(F.count(F.lit(1)).alias("uses"))
    each = pieces(placed, mix).join(uses, ["src", "block"]).groupBy("_n", "shard") \
        .agg(F.sum((F.col("hi") - F.col("lo")) * F.col("uses")).alias("words"))
    taken = each.groupBy("_n").agg(F.sum("words").alias("taken"), F.array_sort(F.collect_list(F.struct("shard", "words"))).alias("shards"))
    sources = spark.createDataFrame([(k, s, t) for k, s, t in zip(mix.keys, mix.sizes, mix.targets, strict=True)],
                                    "_src string, source_size long, target double")
    told = placed.join(sources, "_src").join(taken, "_n", "left")
    return rows.select("_n", "_row").join(told, "_n").select(
        "_row", F.col("_size").alias("size"), "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "shards")


def mixed_rows(rows: DataFrame, placed: DataFrame, mix: Mix, text_col: str = "text") -> DataFrame:
    """The mix itself: one row per row and epoch that takes words of it, with the columns of the
    input; the text holds the taken words of that epoch (the whole text if all are taken).

    ``rows`` are ``numbered`` ones with their texts, which move once: to the spans taken of them.
    """
    from pyspark.sql import types as T

    spark = placed.sparkSession
    own = rows.schema["_row"].dataType
    taken = (pieces(placed, mix).join(slots(spark, mix).select("src", "block", "epoch"), ["src", "block"])
             .groupBy("_n", "epoch").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("_spans"))
             .groupBy("_n").agg(F.collect_list("_spans").alias("_epochs")))
    rows = rows.select("_n", "_row", "_size").join(taken, "_n").select("_row", "_size", "_epochs")

    def cut(text: str, size: int, spans: list[dict]) -> str:
        if sum(s["hi"] - s["lo"] for s in spans) == size:
            return text
        at = word_spans(text)
        runs: list[list[int]] = []
        for s in spans:
            if runs and runs[-1][1] == s["lo"]:
                runs[-1][1] = s["hi"]
            else:
                runs.append([s["lo"], s["hi"]])
        return "\n".join(text[at[lo][0]:at[hi - 1][1]] for lo, hi in runs)

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                b = whole.slice(k, 256)
                row = pa.RecordBatch.from_struct_array(b["_row"])
                texts, sizes, epochs = row[text_col].to_pylist(), b["_size"].to_pylist(), b["_epochs"].to_pylist()
                take = [i for i, e in enumerate(epochs) for _ in e]
                new = pa.array([cut(texts[i], sizes[i], spans) for i, e in enumerate(epochs) for spans in e], pa.string())
                t = pa.Table.from_batches([row]).take(pa.array(take, pa.int64()))
                t = t.set_column(own.names.index(text_col), text_col, new)
                yield from t.combine_chunks().to_batches()

    return rows.mapInArrow(run, T.StructType(own.fields))
