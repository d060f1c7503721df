"""Exact k-nearest neighbours and the local outlier factor (LOF).

Points are dealt to cells by their nearest pivot (a bounded sample of the points), and lie in packed blocks, each of one
cell.  A task holds some blocks of queries and one shard of all blocks.  It meets the blocks of the nearest cells first,
keeps the ``k`` best of each query and, by the triangle inequality, passes over the blocks of cells whose pivot distance less
their radius lies beyond the ``k``-th.  The result is exact for any pivots; where nothing can be ruled out (near-random
vectors of many dimensions) the work stays quadratic.

Every point is moved once for each group of queries, whose number follows the points only beyond ``GROUPS`` large groups.  Shards are
met in rounds; between rounds the ``k`` best lie packed with their queries, and a round's shuffle goes before the next.  LOF is
then three joins over the ``n * k`` neighbour table.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.vectors import as_double_array
from ..session import LONG_ROWS, broadcast_if_small, cut_lineage, cut_over, drop_path, shuffles_dropped

LOF_EPS = 1e-10
LOF_OUTLIER_ABOVE = 1.5
MAX_PIVOTS = 1024  # cells; beyond that many blocks, cells hold several (work only, never results)
SLACK = 1e-9       # relative room for rounding in distance bounds
BLOCK_ROWS = 1024  # least rows of a full block
GROUPS = 24        # of queries, at least, where there are blocks enough
GROUP_BYTES = 1 << 25  # of queries, or of their neighbours, in a task
SHARD_BYTES = 1 << 26  # of points that a task meets in a round
HELD = 1 << 15     # pairs that wait at least before the best are taken of them
SINGLE = 1e30      # squares below that are taken in single precision first


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(((x[:, None, :] - y[None, :, :]) ** 2).sum(axis=2))


def _steps(n: int, row_bytes: int) -> Iterator[slice]:
    """Slices of n rows whose temporary arrays stay within 16 MiB."""
    step = max(1, (16 * 1024 * 1024) // max(1, row_bytes))
    return (slice(a, a + step) for a in range(0, n, step))


class _Points:
    """Points of one block: ids and vectors; as queries with the bound of what they look for."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, bound: np.ndarray | None = None):
        self.ids, self.v, self.bound = ids, v, bound

    def __len__(self) -> int:
        return len(self.ids)

    @functools.cached_property
    def about_centre(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """The centre, vectors about it, their squares, and the room that subtracting it takes."""
        centre = self.v.mean(axis=0)
        centre = np.where(np.isfinite(centre), centre, 0.0)
        y = self.v - centre
        yy = (y * y).sum(axis=1)
        return centre, y, yy, 4 * np.finfo(float).eps * (np.sqrt((centre * centre).sum()) + np.sqrt(yy.max()))

    @functools.cached_property
    def factors(self) -> np.ndarray:
        """Columns whose products with (-2 x, x x, 1) are squared distances, in single precision."""
        _, y, yy, _ = self.about_centre
        return np.ascontiguousarray(np.concatenate([y, np.ones((len(y), 1)), yy[:, None]], axis=1).astype(np.float32).T)


def _block_knn(k: int):
    """(row, column, square, room) of all points of a data block that may be among the ``k`` nearest of a query or within its bound.

    Squared distances come from one matrix product about the block's centre; they are off by no more than the row's room.
    """
    def run(q: _Points, d: _Points) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        kk = min(k, len(d))
        centre, y, yy, off = d.about_centre
        shared = np.isin(q.ids, d.ids)
        parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
        rooms = np.empty(len(q))
        for at in _steps(len(q), 16 * len(y)):
            xs = q.v[at] - centre
            xx = (xs * xs).sum(axis=1)
            single = max(xx.max(), yy.max()) < SINGLE
            if single:
                near = np.concatenate([xs * -2, xx[:, None], np.ones((len(xs), 1))], axis=1).astype(np.float32) @ d.factors
            else:
                near = xx[:, None] + yy - 2 * (xs @ y.T)
            reach = np.sqrt(xx) + np.sqrt(yy.max())
            rooms[at] = room = 16 * (y.shape[1] + 2) * np.finfo(np.float32).eps * reach ** 2 + 4 * reach * off + off ** 2
            for i in np.flatnonzero(shared[at]):
                near[i, d.ids == q.ids[at][i]] = np.inf
            bound = q.bound[at]
            far = np.where(np.isfinite(bound), bound ** 2 * (1 + SLACK), np.inf)
            new = np.flatnonzero(~np.isfinite(bound))
            if len(new):
                far[new] = np.partition(near[new], kk - 1, axis=1)[:, kk - 1] + room[new]
            far += room
            far[np.isnan(far)] = np.inf                                  # squares beyond a double's range
            with np.errstate(over="ignore"):
                far = np.nextafter(far.astype(near.dtype), near.dtype.type(np.inf))[:, None]
                row, col = np.divmod(np.flatnonzero(near <= far if single else ~(near > far)), len(y))
                square = np.nan_to_num(np.maximum(near[row, col], 0), nan=np.inf, posinf=np.inf).astype(np.float32)
            other = q.ids[at][row] != d.ids[col]
            parts.append((row[other] + at.start, col[other], square[other]))
        return *(np.concatenate(x) for x in zip(*parts)), rooms

    return run


class _Near:
    """What may be among the ``k`` nearest of n queries: squares that are off by a room, and the bounds they leave."""

    def __init__(self, k: int, bound: np.ndarray):
        self.k, self.bound, self.room = k, bound, np.zeros(len(bound))
        self.key, self.place = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.waiting, self.held = [], 0

    def add(self, row: np.ndarray, square: np.ndarray, place: np.ndarray) -> None:
        # rows above the bits of a square that is not negative: keys sort by row, then square
        self.waiting.append(((row.astype(np.uint64) << np.uint64(32)) | square.view(np.uint32), place))
        self.held += len(row)
        if self.held >= max(HELD, len(self.bound) * self.k) or not np.isfinite(self.bound).all():
            self.cut()

    def cut(self) -> None:
        if not self.waiting:
            return
        key, place = (np.concatenate(x) for x in zip((self.key, self.place), *self.waiting))
        order = np.argsort(key)
        key, place = key[order], place[order]
        row, square = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.float32).astype(np.float64)
        first = np.searchsorted(row, np.arange(len(self.bound) + 1))
        full = np.flatnonzero(np.diff(first) >= self.k)
        last = np.full(len(self.bound), np.inf)
        last[full] = square[first[full] + self.k - 1]
        self.bound = np.fmin(self.bound, np.sqrt(last + self.room) * (1 + SLACK))
        keep = square <= np.fmin(last + 2 * self.room, self.bound ** 2 * (1 + SLACK) + self.room)[row]
        self.key, self.place, self.waiting, self.held = key[keep], place[keep], [], 0

    def rows(self) -> np.ndarray:
        return (self.key >> np.uint64(32)).astype(np.int64)


def _to_cells(pivots: np.ndarray):
    """Add each row's nearest pivot (ties: the first) and its distance."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in _steps(len(b), pivots.nbytes):
                part = b.iloc[at]
                dist = _distances(np.stack(part["v"].to_numpy()), pivots)
                cell = dist.argmin(axis=1)
                yield part.assign(cell=cell.astype(np.int32), r=dist[np.arange(len(part)), cell])

    return run


def _as_keys(ids: pa.Array) -> np.ndarray:
    out = ids.to_numpy(zero_copy_only=False)
    return out.astype(str) if out.dtype == object else out


def _best(k: int, n: int, row: np.ndarray, nbr: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each of n rows by distance, then id, and the distance of the k-th (infinite where there are fewer)."""
    order = np.lexsort((nbr, dist, row))
    row, nbr, dist = row[order], nbr[order], dist[order]
    rank = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row]
    bound = np.full(n, np.inf)
    last = rank == k - 1
    bound[row[last]] = dist[last]
    return row[rank < k], nbr[rank < k], dist[rank < k], bound


def _meet(run, k: int, pivots: np.ndarray, radius: np.ndarray, last: bool):
    """A task: its blocks of queries with their best so far meet the data blocks; after the ``last`` round a row per neighbour."""
    def meet(t: pa.Table) -> pa.Table:
        kind = t["kind"].to_numpy()
        vectors = lambda b: np.frombuffer(b.as_buffer(), "<f8").reshape(-1, pivots.shape[1])
        data = t.filter(pa.array(kind == DATA))
        points = [_Points(_as_keys(i.values), vectors(v)) for i, v in zip(data["ids"], data["vec"])]
        start = np.cumsum([0, *(len(d) for d in points)])
        own = t.filter(pa.array(kind == QUERY))
        none = pa.table([pa.array([], t.schema.field("ids").type.value_type)] * 2 + [pa.array([], pa.float64()), pa.array([], pa.int32())],
                        names=["id", "nbr", "dist", "rank"])
        if not len(own):             # a group without a block
            return none if last else own
        every = (np.concatenate([d.ids for d in points]), np.concatenate([d.v for d in points])) if points else None
        met, cell_at = np.unique(data["cell"].to_numpy(), return_inverse=True)
        found = []
        for ids, vec, cell, counts, nbrs, dists in zip(*(own[c] for c in ("ids", "vec", "cell", "counts", "nbrs", "dists"))):
            x, key = vectors(vec), _as_keys(ids.values)
            n = len(x)
            row = np.repeat(np.arange(n), np.frombuffer(counts.as_buffer(), "<i4"))
            nbr = _as_keys(nbrs.values) if len(row) else key[:0]
            row, nbr, dist, bound = _best(k, n, row, nbr, np.frombuffer(dists.as_buffer(), "<f8"))
            away = np.concatenate([np.empty((0, len(met))), *(_distances(x[at], pivots[met]) for at in _steps(n, pivots[met].nbytes))])
            least = away - radius[met] - SLACK * (away + radius[met])
            near = _Near(k, bound)
            for j in np.argsort(((pivots[met] - pivots[cell.as_py()]) ** 2).sum(axis=1)[cell_at], kind="stable"):
                need = np.flatnonzero(least[:, cell_at[j]] <= near.bound)
                if len(need):
                    r, c, square, room = run(_Points(key[need], x[need], near.bound[need]), points[j])
                    near.room[need] = np.maximum(near.room[need], room)
                    near.add(need[r], square, c + start[j])
            near.cut()
            new, place = near.rows(), near.place
            exact = np.concatenate([np.empty(0), *(np.sqrt(((x[new[at]] - every[1][place[at]]) ** 2).sum(axis=1)) for at in _steps(len(new), 24 * x.shape[1]))])
            keep = (exact <= bound[new]) & np.isfinite(exact)
            if len(new):
                row, nbr, dist, _ = _best(k, n, np.concatenate([row, new[keep]]), np.concatenate([nbr, every[0][place[keep]]]), np.concatenate([dist, exact[keep]]))
            nbr = pa.array(nbr, ids.type.value_type)
            if last:
                rank = np.arange(len(row)) - np.searchsorted(row, np.arange(n))[row] + 1
                found.append(pa.table([ids.values.take(pa.array(row)), nbr, pa.array(dist), pa.array(rank.astype(np.int32))], names=["id", "nbr", "dist", "rank"]))
            else:
                found.append((np.bincount(row, minlength=n).astype("<i4").tobytes(), nbr, dist.astype("<f8").tobytes()))
        if last:
            return pa.concat_tables(found)
        for name, values in zip(["counts", "nbrs", "dists"], zip(*found)):
            if name == "nbrs":
                ends = pa.array(np.cumsum([0, *(len(v) for v in values)]), pa.int32())
                column = pa.ListArray.from_arrays(ends, pa.concat_arrays(values))
            else:
                column = pa.array(values, pa.binary())
            own = own.set_column(own.schema.get_field_index(name), name, column)
        return own

    return meet


QUERY, DATA = 0, 1


def knn(points: DataFrame, id_col: str, vec_col: str, k: int, block_rows: int = 1024,
        max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """``(id, nbr, dist, rank)``: the ``k`` nearest other points of every point (Euclidean, ties by id).

    Exact.  Points with a null vector or a null or non-finite component take no part.  Repeated ids are
    points of their own that are no neighbours of each other, and share one list.
    """
    v = as_double_array(vec_col)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    p = cut_lineage(points.select(F.col(id_col).alias("id"), v.alias("v")).where(finite))
    spark, id_type = p.sparkSession, p.schema["id"].dataType.simpleString()
    total = p.count()
    n_pivots = min(max_pivots, max(1, math.ceil(total / block_rows)))
    sample = [r["v"] for r in p.orderBy(F.xxhash64("id"), "id").limit(n_pivots).collect()]
    if not sample:
        return spark.createDataFrame([], f"id {id_type}, nbr {id_type}, dist double, rank int")
    copies = p.groupBy("id").count().agg(F.max("count")).first()[0]   # rows of one id share a list
    pivots = np.unique(np.array(sample, dtype=np.float64), axis=0)
    dim = pivots.shape[1]
    with shuffles_dropped(spark):
        dealt, folder = cut_over(p.mapInPandas(_to_cells(pivots), f"id {id_type}, v array<double>, cell int, r double"), None)
        radius, size = np.zeros(len(pivots)), np.zeros(len(pivots), dtype=np.int64)
        for c, r, n in dealt.groupBy("cell").agg(F.max("r"), F.count(F.lit(1))).collect():      # a row per pivot
            radius[c], size[c] = r, n
        # a cell has blocks of about equal size; a block's place among all rows gives its group of queries and its shard
        parts = np.maximum(1, -(-size // max(block_rows, BLOCK_ROWS)))
        of_cell = lambda x: F.get(F.array(*[F.lit(y) for y in x.tolist()]), F.col("cell"))
        group_rows = max(1, min(math.ceil(total / GROUPS), GROUP_BYTES // (8 * dim), GROUP_BYTES // (16 * k)))
        groups = math.ceil(total / group_rows)
        per_shard = max(1, SHARD_BYTES // (8 * dim * group_rows))
        shards = math.ceil(groups / per_shard)
        part = F.pmod(F.xxhash64("id"), of_cell(parts)).cast("int")
        place = of_cell(np.cumsum(size) - size) + F.floor(F.col("part") * of_cell(size) / of_cell(parts))
        packed, _ = cut_over(dealt.withColumn("part", part).withColumn("task", F.floor(place / group_rows).cast("int"))
                             .select("task", "cell", "part", "id", "v").groupBy("task", "cell", "part").applyInArrow(_pack, PACKED.format(id_type)), None, **LONG_ROWS)
        drop_path(spark, folder)
        run, plain = _block_knn(k), f"id {id_type}, nbr {id_type}, dist double, rank int"
        best, held = packed, None
        shard = F.floor(F.col("task") / per_shard).cast("int")
        for o in range(shards):
            first = F.pmod(shard - o, F.lit(shards)) * per_shard
            here = F.sequence(first, F.least(first + per_shard, F.lit(groups)) - 1)
            data = packed.withColumn("kind", F.lit(DATA)).withColumn("task", F.explode(here))
            last = o == shards - 1
            best, held = cut_over(best.unionByName(data).groupBy("task").applyInArrow(
                _meet(run, k, pivots, radius, last), plain if last else PACKED.format(id_type)), held, **({} if last else LONG_ROWS))
    if copies > 1:
        w = Window.partitionBy("id").orderBy("dist", "nbr")
        best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best


PACKED = "task int, kind int, cell int, ids array<{0}>, vec binary, counts binary, nbrs array<{0}>, dists binary"


def _pack(t: pa.Table) -> pa.Table:
    """The points of a block as one row of queries that have not met any."""
    n, ids = len(t), t["id"].combine_chunks()
    vec = t["v"].combine_chunks().flatten().to_numpy().astype("<f8")
    return pa.table([t["task"][:1], pa.array([QUERY], pa.int32()), t["cell"][:1], pa.ListArray.from_arrays([0, n], ids), pa.array([vec.tobytes()], pa.binary()),
                     pa.array([np.zeros(n, "<i4").tobytes()], pa.binary()), pa.array([[]], pa.list_(ids.type)), pa.array([b""], pa.binary())],
                    names=["task", "kind", "cell", "ids", "vec", "counts", "nbrs", "dists"])


def lof(points: DataFrame, id_col: str, vec_col: str, k: int = 20, block_rows: int = 1024) -> DataFrame:
    """Local outlier factor of every point, and ``label`` = -1 (outlier) when LOF > 1.5.

    k-distance(p) = distance to the k-th neighbour; reach(p, o) = max(k-distance(o), d(p, o));
    lrd(p) = 1 / (mean reach(p, .) + 1e-10); LOF(p) = mean lrd(neighbours) / lrd(p).
    """
    nn = knn(points, id_col, vec_col, k, block_rows).select("id", "nbr", "dist")
    # a row per point each: broadcast below a checked size, so the neighbour table need not move
    with shuffles_dropped(points.sparkSession):
        kd = cut_lineage(nn.groupBy("id").agg(F.max("dist").alias("kd")))
        reach = nn.join(broadcast_if_small(kd.withColumnRenamed("id", "nbr"), row_bytes=32), "nbr")
        lrd = cut_lineage(reach.groupBy("id").agg((F.lit(1.0) / (F.avg(F.greatest("kd", "dist")) + F.lit(LOF_EPS))).alias("lrd")))
    nl = nn.join(broadcast_if_small(lrd.withColumnRenamed("id", "nbr").withColumnRenamed("lrd", "lrd_o"), row_bytes=32), "nbr")
    out = (nl.groupBy("id").agg(F.avg("lrd_o").alias("m"))
             .join(lrd, "id")
             .select(F.col("id").alias(id_col), (F.col("m") / F.col("lrd")).alias("lof")))
    return out.withColumn("label", F.when(F.col("lof") > LOF_OUTLIER_ABOVE, -1).otherwise(1))


def scaled_radius(scores: DataFrame, col: str = "lof", out: str = "radius") -> DataFrame:
    """``(max - s) / (max - min)`` over all rows (for plotting outlier circles)."""
    mx = scores.agg(F.max(col)).scalar()
    mn = scores.agg(F.min(col)).scalar()
    return scores.withColumn(out, F.coalesce(F.try_divide(mx - F.col(col), mx - mn), F.lit(0.0)))
