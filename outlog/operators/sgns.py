"""Skip-gram with negative sampling on sharded parameters: words and documents in one pass.

Training data is a table of counted pairs (row key, column key): a word and a word near it, or a document
and a word in it.  Row and column vectors are cut into B blocks by a hash of the key.  An epoch has B
turns; in turn t, row block i meets column block (i + t) mod B and the pairs of that cell, so the B tasks of
a turn touch disjoint parameters, and after B turns every pair was seen once.  No vocabulary and no vector
ever reaches the driver; a task holds two blocks and one cell.

Between turns the parameters of a block lie in a few rows of packed numbers (single precision), as do the pairs of
a cell, so a turn moves bytes and no row per key.  A single block runs all its epochs in one task.
The number of blocks follows the keys and pairs (``BLOCK_KEYS``, ``CELL_PAIRS``), and every order and draw is
seeded by key, epoch and cell, so the vectors are equal on every run and for every number of tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, cut_over, drop_path, scratch_path, shuffles_dropped

BLOCK_KEYS, CELL_PAIRS = 1 << 16, 1 << 21
FULL_BLOCKS = 16          # beyond that many blocks, each holds up to four times as many keys: turns move all parameters
PACK_KEYS = 1 << 12       # keys or pairs in a packed row
PAIRS_AT_ONCE = 1 << 18   # pairs of a cell whose draws a task holds at once
NOISE_POWER = 0.75
MASS_UNIT = 1 << 20       # the noise of all columns is summed in whole units, so its sum has no order
STEP_PAIRS = 512
STATE = "task long, kind int, part int, keys array<string>, others array<string>, n binary, vec binary, acc binary"
ROW, COL, PAIR, LOSS = range(4)


def word_pairs(counts: DataFrame) -> DataFrame:
    """Counted neighbours (word, context, n), both ways, as training pairs of words."""
    both = counts.select("word", "context", "n").unionByName(counts.select(F.col("context").alias("word"), F.col("word").alias("context"), "n"))
    return both.groupBy(F.concat(F.lit("w:"), "word").alias("row"), F.col("context").alias("col")).agg(F.sum("n").alias("n"))


def document_pairs(words: DataFrame, doc_col: str, word_col: str) -> DataFrame:
    """(document, word, n): documents predict their words and share the words' column vectors."""
    return words.groupBy(F.concat(F.lit("d:"), F.col(doc_col).cast("string")).alias("row"), F.col(word_col).alias("col")) \
        .agg(F.count("*").alias("n"))


def _alias(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Alias table of a distribution: (share kept, other outcome) per outcome; a draw takes constant time."""
    q, other = p * len(p) / p.sum(), np.arange(len(p))
    small, large = [i for i in range(len(q)) if q[i] < 1], [i for i in range(len(q)) if q[i] >= 1]
    while small and large:
        s, g = small.pop(), large[-1]
        other[s] = g
        q[g] -= 1 - q[s]
        if q[g] < 1:
            small.append(large.pop())
    return np.minimum(q, 1.0), other


def _draws(noise: np.ndarray, seen: np.ndarray, idle: np.ndarray, chunk: np.ndarray, negatives: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the negatives of some pairs, whose rows are ``chunk``, and of the ``idle`` rows."""
    times = negatives * (np.bincount(chunk, minlength=len(seen)) + idle)
    keep, other = noise
    at = np.repeat(np.arange(len(seen)), times)
    pick = rng.integers(0, len(keep), len(at))
    return at, np.where(rng.random(len(at)) < keep[pick], pick, other[pick])


def train_cell(w: np.ndarray, aw: np.ndarray, c: np.ndarray, ac: np.ndarray, noise: np.ndarray, share: float, total: np.ndarray,
               rows: np.ndarray, cols: np.ndarray, n: np.ndarray, negatives: int, rate: float, rng) -> float:
    """One pass over a cell, in place; the loss summed over its pairs and their expected negatives.

    ``share`` is the block's part of the noise of all columns, ``total`` the pairs of each row in all cells: a
    row expects ``negatives * total * share`` negatives here, which its draws stand for by their weight.  Rows
    without a pair in the cell draw with the probability that they expect any, so draws stay in
    proportion to the pairs, however many cells there are.
    """
    seen = np.bincount(rows, minlength=len(w))
    table = _alias(noise)
    weight = negatives * total * share / (negatives * np.maximum(seen, 1)) if negatives else np.zeros(len(w))
    idle = np.zeros(len(w), bool)
    if (seen == 0).any():
        often = np.minimum(1.0, total * share)
        idle = (seen == 0) & (rng.random(len(w)) < often)
        weight[idle] /= often[idle]       # a row that is passed over here stands for none
    few = -(-len(rows) // PAIRS_AT_ONCE) if len(rows) else 1
    mixed = rng.permutation(len(rows)) if few > 1 else np.arange(len(rows))
    loss = 0.0
    for part in np.array_split(mixed, few):
        at, pick = _draws(table, seen, idle, rows[part], negatives, rng)
        idle = np.zeros(len(w), bool)
        r, k = np.concatenate([rows[part], at]), np.concatenate([cols[part], pick])
        y = np.concatenate([np.ones(len(part)), np.zeros(len(at))])
        loss += _steps(w, aw, c, ac, r, k, y, np.concatenate([n[part], weight[at]]), rate, rng)
    return loss


def _steps(w: np.ndarray, aw: np.ndarray, c: np.ndarray, ac: np.ndarray, r: np.ndarray, k: np.ndarray, y: np.ndarray, g: np.ndarray,
           rate: float, rng) -> float:
    dim = w.shape[1]
    places = np.arange(dim)
    order = rng.permutation(len(r))
    r, k, y, g = r[order], k[order], y[order], g[order]
    loss = 0.0
    for a in range(0, len(r), STEP_PAIRS):
        ri, ki, yi, gi = (x[a:a + STEP_PAIRS] for x in (r, k, y, g))
        wr, ck = w.take(ri, axis=0), c.take(ki, axis=0)
        s = (wr * ck).sum(axis=1)
        loss += float((gi * np.logaddexp(0, np.where(yi > 0, -s, s))).sum())
        e = (gi * (1 / (1 + np.exp(-np.clip(s, -30, 30))) - yi))[:, None]
        for m, acc, key, step in ((w, aw, ri, e * ck), (c, ac, ki, e * wr)):
            u, back = np.unique(key, return_inverse=True)
            d = np.bincount((back[:, None] * dim + places).ravel(), step.ravel(), len(u) * dim).reshape(len(u), dim)
            up = acc.take(u) + (d * d).mean(axis=1)
            acc[u] = up
            m[u] = m.take(u, axis=0) - rate * d / np.sqrt(up + 1e-12)[:, None]
    return loss


def _packed(task: int, kind: int, keys: pa.Array, others: pa.Array | None, n: np.ndarray, vec: np.ndarray | None = None,
            acc: np.ndarray | None = None) -> pa.Table:
    """Rows of at most ``PACK_KEYS`` keys, or pairs, with their numbers as bytes."""
    cuts = range(0, len(keys), PACK_KEYS)
    ends = pa.array([*cuts, len(keys)], pa.int32())
    packs = lambda x, t: pa.nulls(len(cuts), t) if x is None else pa.array([x[a:a + PACK_KEYS].tobytes() for a in cuts], t)
    lists = lambda x: pa.nulls(len(cuts), pa.list_(pa.string())) if x is None else pa.ListArray.from_arrays(ends, x.cast(pa.string()))
    return pa.table([pa.array([task] * len(cuts), pa.int64()), pa.array([kind] * len(cuts), pa.int32()), pa.array(range(len(cuts)), pa.int32()),
                     lists(keys), lists(others), packs(n, pa.binary()), packs(vec, pa.binary()), packs(acc, pa.binary())],
                    names=["task", "kind", "part", "keys", "others", "n", "vec", "acc"])


def _numbers(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    """The numbers of packed rows, as doubles of their own."""
    parts = [np.frombuffer(x.as_buffer(), dtype) for chunk in column.chunks for x in chunk]
    return np.concatenate(parts).astype(np.float64) if parts else np.empty(0)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays([x.flatten() for x in column.chunks]) if column.num_chunks else pa.array([], pa.string())


def _start(t: pa.Table, dim: int, seed: int, dtype: str) -> pa.Table:
    """The first parameters of a block of keys, sorted: rows are drawn by the hash of their names, columns are zero."""
    t = t.sort_by("key")
    kind, keys = t["kind"][0].as_py(), t["key"].combine_chunks()
    vec = np.zeros((len(keys), dim))
    if kind == ROW:
        tails = [str(i).encode() for i in range(dim)]
        for r, name in enumerate(t["name"].to_pylist()):
            head = hashlib.md5(f"{seed}:{name}:".encode(), usedforsecurity=False)
            for i, tail in enumerate(tails):
                h = head.copy()
                h.update(tail)
                vec[r, i] = int.from_bytes(h.digest()[:4], "big")
        vec = (vec / 2 ** 32 - 0.5) / dim
    return _packed(t["task"][0].as_py(), kind, keys, None, t["n"].to_numpy(), vec.astype(dtype), np.zeros(len(keys), dtype))


def _cell(t: pa.Table, runs: list[int], turn: int, dim: int, mass: float, negatives: int, rate: float, seed: int, dtype: str,
          each: bool) -> pa.Table:
    kind = t["kind"].to_numpy()
    task = t["task"][0].as_py()
    parts = {}
    for side in (ROW, COL):
        part = t.filter(pa.array(kind == side)).sort_by("part")
        parts[side] = _flat(part["keys"]), _numbers(part["n"], "<f8"), _numbers(part["vec"], dtype).reshape(-1, dim), _numbers(part["acc"], dtype)
    pairs = t.filter(pa.array(kind == PAIR))
    (row_keys, total, w, aw), (col_keys, count, c, ac) = parts[ROW], parts[COL]
    losses = [0.0] * len(runs)
    if len(w) and len(c):
        rows, cols = (pc.index_in(_flat(pairs[x]), value_set=v).to_numpy(zero_copy_only=False).astype(np.int64)
                      for x, v in (("keys", row_keys), ("others", col_keys)))
        order = np.lexsort((cols, rows))
        rows, cols, n = rows[order], cols[order], _numbers(pairs["n"], "<f8")[order]
        if each:
            times = n.astype(np.int64)
            rows, cols, n = np.repeat(rows, times), np.repeat(cols, times), np.ones(times.sum())
        noise = count ** NOISE_POWER
        share = float(noise.sum()) / mass
        for i, epoch in enumerate(runs):
            losses[i] = train_cell(w, aw, c, ac, noise, share, total, rows, cols, n, negatives, rate, np.random.default_rng([seed, epoch, turn, task]))
    out = [_packed(task, side, keys, None, n, vec.astype(dtype), acc.astype(dtype)) for side, (keys, n, vec, acc) in parts.items()]
    none = pa.nulls(len(runs), pa.binary())
    out.append(pa.table([pa.array([task] * len(runs), pa.int64()), pa.array([LOSS] * len(runs), pa.int32()), pa.array(runs, pa.int32()),
                         pa.nulls(len(runs), pa.list_(pa.string())), pa.nulls(len(runs), pa.list_(pa.string())),
                         pa.array([np.float64(x).tobytes() for x in losses], pa.binary()), none, none], names=out[0].schema.names))
    return pa.concat_tables(out)


def _moved(blocks: int) -> Column:
    """Where a block works in the next turn: row blocks stay, column blocks go to the task before."""
    return F.when(F.col("kind") == COL, F.pmod(F.col("task") - 1, F.lit(blocks))).otherwise(F.col("task"))


def train(pairs: DataFrame, dim: int = 25, epochs: int = 5, negatives: int = 5, rate: float = 0.25, seed: int = 1,
          block_keys: int = BLOCK_KEYS, cell_pairs: int = CELL_PAIRS, names: DataFrame | None = None,
          each: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Row vectors (key, vector), column vectors, and the loss per epoch, of counted pairs (row, col, n).

    Pairs repeated in the table add up; pairs with a null side are left out.  Without pairs all three are
    empty.  ``loss`` is the mean over pairs of the negative log likelihood of the pair and its negatives.
    ``names`` (key, name): keys of rows that stand for longer names, in the order of the names, by which the first vectors are drawn.
    ``each``: a pair counted n times is n steps with negatives of their own, not one step of weight n.
    """
    pairs = pairs.where(F.col("row").isNotNull() & F.col("col").isNotNull())
    spark = pairs.sparkSession
    # a turn's parameters and shuffles go as soon as the next turn's are written
    with shuffles_dropped(spark):
        pairs, counted = cut_over(pairs.groupBy("row", "col").agg(F.sum("n").cast("double").alias("n")), None)

        def keys(side: str, kind: int) -> DataFrame:
            totals = pairs.groupBy(F.col(side).alias("key")).agg(F.sum("n").alias("n")).withColumn("kind", F.lit(kind))
            if kind == ROW and names is not None:
                return totals.join(names, "key", "left").select("kind", "key", F.coalesce("name", "key").alias("name"), "n")
            return totals.select("kind", "key", F.col("key").alias("name"), "n")

        known = cut_lineage(keys("row", ROW).unionByName(keys("col", COL)))
        size = known.groupBy("kind").agg(F.count("*").alias("k"), F.sum(F.floor(F.pow("n", F.lit(NOISE_POWER)) * MASS_UNIT)).alias("mass"), F.sum("n").alias("n")).collect()
        size = {r["kind"]: r for r in size}
        total = size[ROW]["n"] if size else 0.0
        blocks = _blocks(max(r["k"] for r in size.values()), pairs.count(), block_keys, cell_pairs) if size else 1
        dtype = "<f8" if blocks == 1 else "<f4"
        block = lambda key: F.pmod(F.xxhash64(key), F.lit(blocks))
        state, held = cut_over(known.withColumn("task", block("key")).groupBy("kind", "task")
                               .applyInArrow(lambda t: _start(t, dim, seed, dtype), STATE), None)
        # every cell's pairs lie in the folder of its turn, so a turn reads only its own
        path = scratch_path(spark, "pairs")
        pairs.withColumn("task", block("row")).withColumn("turn", F.pmod(block("col") - F.col("task"), F.lit(blocks)).cast("int")) \
            .groupBy("turn", "task").applyInArrow(_pack_pairs, "turn int, " + STATE).write.partitionBy("turn").parquet(path)
        drop_path(spark, counted)
        cells = spark.read.parquet(path) if size else None
        sums = {epoch: [] for epoch in range(epochs)} if size else {}
        together = [[*sums]] if blocks == 1 and sums else [[epoch] for epoch in sums]
        for runs in together:
            for turn in range(blocks):
                first = runs[0] == 0 and turn == 0
                work = state.where(F.col("kind") != LOSS)
                if not first and blocks > 1:
                    work = work.withColumn("task", _moved(blocks))
                work = work.unionByName(cells.where(F.col("turn") == turn).drop("turn"))
                state, held = cut_over(work.groupBy("task").applyInArrow(
                    _bound(runs, turn, dim, size[COL]["mass"] / MASS_UNIT, negatives, rate, seed, dtype, each), STATE), held)
                for r in state.where(F.col("kind") == LOSS).select("part", "n").collect():      # one number per task
                    sums[r["part"]].append(float(np.frombuffer(r["n"], "<f8")[0]))
    drop_path(spark, path)
    loss = spark.createDataFrame([(epoch, math.fsum(x) / (total or 1.0)) for epoch, x in sums.items()], "epoch int, loss double")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                vec = np.frombuffer(b["vec"][i].as_buffer(), dtype).astype(np.float64)
                yield pa.RecordBatch.from_arrays([b["keys"][i].values.cast(pa.string()), pa.ListArray.from_arrays(
                    np.arange(0, len(vec) + 1, dim, dtype=np.int32), vec)], ["key", "vector"])

    side = lambda kind: state.where(F.col("kind") == kind).select("keys", "vec").mapInArrow(vectors, "key string, vector array<double>")
    return side(ROW), side(COL), loss


def _blocks(keys: int, pairs: int, block_keys: int, cell_pairs: int) -> int:
    n = math.ceil(keys / block_keys)
    return max(1, min(n, max(FULL_BLOCKS, math.ceil(n / 4))), math.ceil(math.sqrt(pairs / cell_pairs)))


def _pack_pairs(t: pa.Table) -> pa.Table:
    turn = t["turn"][0]
    out = _packed(t["task"][0].as_py(), PAIR, t["row"].combine_chunks(), t["col"].combine_chunks(), t["n"].to_numpy())
    return out.add_column(0, "turn", pa.array([turn.as_py()] * len(out), pa.int32()))


def _bound(*args) -> Callable[[pa.Table], pa.Table]:
    return lambda t: _cell(t, *args)


def word_vectors(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("key").startswith("w:")).select(F.expr("substring(key, 3)").alias("word"), "vector")


def document_vectors(rows: DataFrame, doc_col: str = "doc_id", kind: str = "long") -> DataFrame:
    return rows.where(F.col("key").startswith("d:")).select(F.expr("substring(key, 3)").cast(kind).alias(doc_col), "vector")
