"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

Vectors get one more component that makes all lengths equal, so the largest inner product is
the smallest Euclidean distance, and are then rotated by a seeded random rotation.  K-means on
a bounded sample gives the lists; a query probes its nearest lists.  Inside a list, dimensions
are read in blocks: after each block a hypothesis test on the partial distance drops the
candidates that are very unlikely to beat the query's current k-th distance, and only the
survivors' next block is read.

Equal vectors are searched once: a class keeps its k + 1 smallest ids, enough for any result.
The number of probed lists is the smallest that reaches ``TARGET_RECALL`` against brute force
on the sample, on the whole and in each of some groups of directions; a query whose nearest lists are short probes on until it has met as many vectors as
that number of average lists holds, k at least.  Every vector is indexed.  Lists are scanned in groups of at most about
``GROUP_ROWS`` vectors and queries in parts of about as many, so a long list is split over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import contiguous_groups, tasks

SAMPLE_ROWS = 16_384
LIST_ROWS, MAX_LISTS, GROUP_ROWS = 256, 4096, 4096
BLOCK = 16  # dimensions read between tests
EPSILON = 2.1  # width of the test: larger keeps more candidates
TARGET_RECALL = 0.96
SEED = 11


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def lift(x: np.ndarray, longest: float, turn: np.ndarray) -> np.ndarray:
    """Candidates: the added component brings every squared length to ``longest``; rotated."""
    rest = np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))
    return np.concatenate([x, rest[:, None]], axis=1) @ turn


def lift_query(x: np.ndarray, longest: float, turn: np.ndarray) -> np.ndarray:
    """Queries: scaled to the same length (the order of inner products stays), added component 0."""
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the squares
    scale = np.sqrt(longest) / np.sqrt((x * x).sum(axis=1))
    return np.concatenate([x * scale[:, None], np.zeros((len(x), 1))], axis=1) @ turn


def k_means(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    centres = x[np.random.default_rng(SEED).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        size = np.bincount(near, minlength=k)
        centres[size > 0] = total[size > 0] / size[size > 0][:, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - x[i:i + 4096] @ centres.T, axis=1) for i in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


def probe_order(q: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    return np.argsort(half - q @ centres.T, axis=1, kind="stable")[:, :n]


def spread_seeds(q: np.ndarray, groups: int) -> np.ndarray:
    """Rows of ``q`` (vectors of one length), each the farthest from the ones before it."""
    pick, near = [0], q @ q[0]
    while len(pick) < min(groups, len(q)):
        i = int(np.argmin(near))
        if i in pick:
            break
        pick.append(i)
        near = np.maximum(near, q @ q[i])
    return q[pick]


def probes_needed(sample: np.ndarray, peak: float, longest: float, turn: np.ndarray, centres: np.ndarray, k: int,
                  queries: int = 256, groups: int = 64, each: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of direction groups, and the fewest probed lists with which a query of each group finds
    TARGET_RECALL of the true k nearest of the sample.

    No group gets fewer than the first ``queries`` rows need on the whole; a group that needs more, as directions that
    few rows share may, gets what ``each`` of its own rows need.
    """
    x, q = lift(sample / peak, longest, turn), lift_query(sample, longest, turn)
    k = min(k, len(x) - 1)
    if k < 1:
        return q[:1], np.array([len(centres)])
    seeds = spread_seeds(q, groups)
    group = np.concatenate([np.argmax(q[i:i + 4096] @ seeds.T, axis=1) for i in range(0, len(q), 4096)])
    by_group = np.argsort(group, kind="stable")
    place_in = np.arange(len(q)) - np.searchsorted(group[by_group], group[by_group])
    asked = np.unique(np.append(np.arange(min(queries, len(q))), by_group[place_in < each]))
    filed, depth = nearest(x, centres), np.empty((len(asked), k), np.int64)
    for lo in range(0, len(asked), 256):
        own = asked[lo:lo + 256]
        far = -(q[own] @ x.T)
        far[np.arange(len(own)), own] = np.inf
        top = np.argpartition(far, k - 1, axis=1)[:, :k]
        order = probe_order(q[own], centres, len(centres))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(len(centres)), order.shape), axis=1)
        depth[lo:lo + 256] = place[np.arange(len(own))[:, None], filed[top]]

    def fewest(rows: np.ndarray) -> int:
        found = np.cumsum(np.bincount(depth[rows].ravel(), minlength=len(centres))) / depth[rows].size
        return int(np.searchsorted(found, TARGET_RECALL) + 1)

    overall, groups_asked = fewest(asked < queries), group[asked]
    return seeds, np.array([max(overall, fewest(groups_asked == g)) if (groups_asked == g).any() else overall
                            for g in range(len(seeds))])


def scan(x: np.ndarray, ids: np.ndarray, lists: np.ndarray, q: np.ndarray, probed: list[np.ndarray], own: np.ndarray,
         k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest candidates of each query within its probed lists: (query row, id, distance).

    ``own``: the query's class id, never a result.
    """
    dim = x.shape[1]
    order = np.argsort(lists, kind="stable")
    x, ids, lists = x[order], ids[order], lists[order]
    names, begin = np.unique(lists, return_index=True)
    ends = np.append(begin[1:], len(lists))
    asked = np.concatenate([np.full(len(p), i) for i, p in enumerate(probed)]) if probed else np.empty(0, np.int64)
    wanted = np.concatenate(probed) if probed else np.empty(0, np.int64)
    by_list = {int(n): asked[wanted == n] for n in names}
    best_q, best_id, best_d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    limit = np.full(len(q), np.inf)
    # lists that many queries probe first: their results tighten most limits
    for n, a, z in sorted(zip(names, begin, ends, strict=True), key=lambda t: -len(by_list[int(t[0])])):
        rows = by_list[int(n)]
        for lo in range(a, z, 1024):
            cand = np.arange(lo, min(z, lo + 1024))
            for part in range(0, len(rows), 1024):
                qi = rows[part:part + 1024]
                # first block for all pairs at once, the later ones for surviving pairs only
                d = min(BLOCK, dim)
                p, c = q[qi, :d], x[cand, :d]
                dist = (p * p).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * p @ c.T
                alive = (dist * (dim / d) <= (1 + EPSILON / np.sqrt(d)) ** 2 * limit[qi][:, None]) & (own[qi][:, None] != ids[cand])
                i, j = np.nonzero(alive)
                dist, i, j = dist[i, j], qi[i], cand[j]
                while d < dim and len(i):
                    e = min(d + BLOCK, dim)
                    gap = q[i, d:e] - x[j, d:e]
                    dist = dist + np.einsum("ij,ij->i", gap, gap)
                    d = e
                    keep = dist * (dim / d) <= ((1 + EPSILON / np.sqrt(d)) ** 2 if d < dim else 1.0) * limit[i]
                    dist, i, j = dist[keep], i[keep], j[keep]
                if not len(i):
                    continue
                touched = np.zeros(len(q), bool)
                touched[i] = True
                old = touched[best_q]
                mq = np.concatenate([best_q[old], i])
                mi = np.concatenate([best_id[old], ids[j]])
                md = np.concatenate([best_d[old], dist])
                o = np.lexsort((mi, md, mq))
                mq, mi, md = mq[o], mi[o], md[o]
                first = np.flatnonzero(np.append(True, mq[1:] != mq[:-1]))
                place = np.arange(len(mq)) - np.repeat(first, np.diff(np.append(first, len(mq))))
                limit[mq[place == k - 1]] = md[place == k - 1]
                keep = place < k
                best_q = np.concatenate([best_q[~old], mq[keep]])
                best_id = np.concatenate([best_id[~old], mi[keep]])
                best_d = np.concatenate([best_d[~old], md[keep]])
    return best_q, best_id, best_d


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1) if len(col) else np.empty((0, 1))


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (array<double>) of the rows that take part: with an id, and a vector without null or
    non-finite components, not all zero, of the table's most common length (ties: the longest)."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def search(classes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``classes``: cid, v (all vectors); ``queries``: cid.  Returns qcid, cid: the nearest k."""
    spark = classes.sparkSession
    stats = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("peak")).first()
    empty = spark.createDataFrame([], "qcid long, cid long")
    if not stats["n"]:
        return empty
    n, peak = stats["n"], float(stats["peak"])  # components are divided by the largest, so that no square overflows
    squared = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.lit(peak)) * (x / F.lit(peak)))
    longest = float(classes.agg(F.max(squared)).first()[0])
    last = classes.select("cid").orderBy("cid").limit(SAMPLE_ROWS).agg(F.max("cid")).first()[0]
    sample = np.array([r["v"] for r in sorted(classes.where(F.col("cid") <= last).collect(), key=lambda r: r["cid"])])
    turn = rotation(sample.shape[1] + 1)
    lists = max(1, min(MAX_LISTS, n // LIST_ROWS, len(sample)))
    centres = k_means(lift(sample / peak, longest, turn), lists)
    seeds, probes = probes_needed(sample, peak, longest, turn, centres, k)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = lift(_matrix(b["v"]) / peak, longest, turn)
                yield pa.RecordBatch.from_arrays([b["cid"], pa.array(nearest(x, centres).astype(np.int32)), b["v"]], ["cid", "list", "v"])

    filed = cut_lineage(classes.select("cid", "v").mapInArrow(file, "cid long, list int, v array<double>"))
    # consecutive short lists share a group, a long list is split over several (one number per list)
    sizes = {r["list"]: r["count"] for r in filed.groupBy("list").count().collect()}
    first, split, group, held = np.zeros(lists, np.int64), np.ones(lists, np.int64), 0, 0
    for i in range(lists):
        size = sizes.get(i, 0)
        if held and held + size > GROUP_ROWS:
            group, held = group + 1, 0
        first[i], split[i] = group, max(1, -(-size // GROUP_ROWS))
        held += size
        if split[i] > 1:
            group, held = group + int(split[i]), 0
    parts = max(1, -(-queries.count() // GROUP_ROWS))
    # vectors that a query meets at least: those of so many average lists, and k besides its own
    held_by, enough = np.array([sizes.get(i, 0) for i in range(lists)]), np.minimum(n, np.maximum(k + 1, -(-n * probes // lists)))
    place = F.array(*[F.lit(int(x)) for x in first]), F.array(*[F.lit(int(x)) for x in split])

    at = (F.get(place[0], F.col("list")) + F.pmod(F.col("cid"), F.get(place[1], F.col("list")))).cast("long")
    sides = filed.select(at.alias("g"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("side"),
                         "cid", "list", F.lit(None).cast("array<int>").alias("probed"), "v")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            q = lift_query(_matrix(b["v"]), longest, turn)
            order, of = probe_order(q, centres, lists), np.argmax(q @ seeds.T, axis=1)
            met = np.cumsum(held_by[order], axis=1)
            row, g, probed = [], [], []
            for i, lst in enumerate(order):
                to: dict[int, list[int]] = {}
                for one in lst[:max(probes[of[i]], int(np.searchsorted(met[i], enough[of[i]])) + 1)]:
                    for s in range(int(split[one])):
                        to.setdefault(int(first[one]) + s, []).append(int(one))
                for where, which in to.items():
                    row.append(i)
                    g.append(where)
                    probed.append(which)
            t = b.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), t["cid"], pa.array(probed, pa.list_(pa.int32())), t["v"]], ["g", "cid", "probed", "v"])

    asked = filed.join(queries, "cid").select("cid", "v").mapInArrow(ask, "g long, cid long, probed array<int>, v array<double>")
    asked = asked.select("g", F.pmod(F.xxhash64("cid"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("side"), "cid",
                         F.lit(None).cast("int").alias("list"), "probed", "v")
    keys = ["g", "part"]
    placed = sides.unionByName(asked).repartition(tasks(classes), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in contiguous_groups(batches, keys):
            side = t["side"].to_numpy()
            have, want = t.filter(pa.array(side == 0)), t.filter(pa.array(side == 1))
            if not have.num_rows or not want.num_rows:
                continue
            x, q = lift(_matrix(have["v"]) / peak, longest, turn), lift_query(_matrix(want["v"]), longest, turn)
            own = want["cid"].to_numpy()
            probed = [np.array(p) for p in want["probed"].to_pylist()]
            i, found, dist = scan(x, have["cid"].to_numpy(), have["list"].to_numpy(), q, probed, own, k)
            yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(found), pa.array(dist)], ["qcid", "cid", "dist"])

    near = placed.mapInArrow(run, "qcid long, cid long, dist double")
    w = W.partitionBy("qcid").orderBy("dist", "cid")
    return near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("qcid", "cid")


def neighbours(df: DataFrame, is_query, id_col: str, vec_col: str, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), the neighbour's id under ``id_col``, score (inner product).

    The k found neighbours of every usable row for which ``is_query`` holds, all other usable
    rows being candidates; fewer than k candidates give them all.  Score ties go to the smaller
    id.  A repeated row counts once; rows that are not usable (see ``usable``) take no part, nor do other
    columns; an empty table gives an empty result.  Components may be as large as doubles are; where an
    inner product overflows, its score is infinite.
    """
    rows = cut_lineage(usable(df, id_col, vec_col).distinct().withColumn("cid", F.xxhash64("v")))
    smallest = W.partitionBy("cid").orderBy("id")
    members = (rows.withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1)
               .groupBy("cid").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.first("v").alias("v")))
    classes = cut_lineage(members)
    asking = rows.where(is_query(F.col("id"))).select(F.col("id").alias("query_id"), F.col("cid").alias("qcid"))
    found = search(classes, asking.select(F.col("qcid").alias("cid")).distinct(), k + 1)
    # a query's equals are found by its class itself
    found = found.unionByName(asking.select("qcid", F.col("qcid").alias("cid")).distinct())
    right = classes.select("cid", "ids", F.col("v").alias("y"))
    left = classes.select(F.col("cid").alias("qcid"), F.col("v").alias("x"))
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    scored = found.join(right, "cid").join(left, "qcid").select("qcid", "ids", dot.alias("score"))
    pairs = (asking.join(scored, "qcid").select("query_id", "score", F.explode("ids").alias("id"))
             .where("id <> query_id"))
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return (pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", F.col("id").alias(id_col), "score"))
