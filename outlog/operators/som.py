"""Self-organising map as distributed Spark jobs.

The map (codebook) is model-sized: ``rows x cols`` nodes of ``dim`` doubles, so its size is
checked against ``BROADCAST_MAX_BYTES`` and it is shipped to every executor.  The data never
leaves the executors: each batch-SOM epoch is one Spark job that finds every row's best
matching unit (BMU) with numpy inside Arrow batches, adds rows up per BMU inside the task
(map-side combine), and reduces those partial sums with a ``groupBy``.  Only ``K x dim``
sums come back to the driver, where the neighbourhood-weighted update is a K x K product.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import config as C
from ..functions.ids import seeded_unit
from ..session import cut_lineage


@dataclass
class Codebook:
    """Node weights of a ``rows x cols`` map; node ``k`` sits at grid cell ``(k // cols, k % cols)``."""

    rows: int
    cols: int
    weights: np.ndarray          # shape (rows * cols, dim), float64

    @property
    def k(self) -> int:
        return self.rows * self.cols

    @property
    def dim(self) -> int:
        return int(self.weights.shape[1])

    def grid(self) -> np.ndarray:
        idx = np.arange(self.k)
        return np.stack([idx // self.cols, idx % self.cols], axis=1).astype(np.float64)

    def nbytes(self) -> int:
        return int(self.weights.nbytes)

    def check_size(self, limit: int = C.BROADCAST_MAX_BYTES) -> None:
        if self.nbytes() > limit:
            raise ValueError(f"codebook of {self.nbytes()} bytes exceeds the broadcast limit {limit}")

    def to_df(self, spark: SparkSession, model_version: str | None = None) -> DataFrame:
        rows = [(int(k), int(k // self.cols), int(k % self.cols), [float(x) for x in self.weights[k]])
                for k in range(self.k)]
        df = spark.createDataFrame(rows, "node int, gx int, gy int, w array<double>")
        return df if model_version is None else df.withColumn("model_version", F.lit(model_version))

    @classmethod
    def from_df(cls, df: DataFrame, rows: int, cols: int) -> "Codebook":
        """Read a codebook table back (model-sized, so collecting it is bounded)."""
        got = sorted(df.select("node", "w").collect(), key=lambda r: r["node"])
        if len(got) != rows * cols:
            raise ValueError(f"codebook has {len(got)} nodes, expected {rows * cols}")
        return cls(rows, cols, np.array([r["w"] for r in got], dtype=np.float64))


# ---- initialisation -----------------------------------------------------------------------

def _collect_vectors(df: DataFrame, vec_col: str) -> np.ndarray:
    return np.array([r[0] for r in df.select(vec_col).collect()], dtype=np.float64)


def init_random(rows: int, cols: int, dim: int, seed: int = 1) -> Codebook:
    """Uniform [0, 1) weights from a seeded generator (the map starts as noise)."""
    rng = np.random.default_rng(seed)
    return Codebook(rows, cols, rng.random((rows * cols, dim)))


def init_sample(df: DataFrame, vec_col: str, id_cols: list[str], rows: int, cols: int,
                seed: int = 7) -> Codebook:
    """Weights = the ``rows*cols`` rows with the smallest seeded hash of their id (a sample)."""
    key = seeded_unit(seed, *id_cols)
    pick = (df.select(*id_cols, vec_col, key.alias("__h"))
              .orderBy("__h", *id_cols).limit(rows * cols))
    w = _collect_vectors(pick.orderBy("__h", *id_cols), vec_col)
    if not len(w):
        raise ValueError("no rows to initialise the map")
    return Codebook(rows, cols, np.resize(w, (rows * cols, w.shape[1])))  # fewer rows are repeated in turn


def init_frequent(df: DataFrame, vec_col: str, word_col: str, count_col: str,
                  rows: int, cols: int) -> Codebook:
    """Weights = vectors of the ``rows*cols`` most frequent words (ties by word)."""
    pick = df.orderBy(F.col(count_col).desc(), F.col(word_col)).limit(rows * cols)
    got = pick.select(word_col, count_col, vec_col).collect()
    got.sort(key=lambda r: (-r[count_col], r[word_col]))
    if not got:
        raise ValueError("no words to initialise the map")
    w = np.array([r[vec_col] for r in got], dtype=np.float64)
    return Codebook(rows, cols, np.resize(w, (rows * cols, w.shape[1])))  # fewer words are repeated in turn


def init_pca(df: DataFrame, vec_col: str, rows: int, cols: int, weight_col: str | None = None) -> Codebook:
    """Linear initialisation: a grid on the plane of the two leading principal components.

    Mean and covariance are distributed aggregates (dim x dim comes back), the eigen
    decomposition of that small matrix runs on the driver.
    """
    mean, cov = weighted_moments(df, vec_col, weight_col)
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    vals, vecs = np.clip(vals[order], 0, None), vecs[:, order]
    dim = len(mean)
    pc = [vecs[:, i] * np.sqrt(vals[i]) if i < dim else np.zeros(dim) for i in range(2)]
    w = np.empty((rows * cols, dim))
    for k in range(rows * cols):
        a = np.linspace(-1, 1, rows)[k // cols] if rows > 1 else 0.0
        b = np.linspace(-1, 1, cols)[k % cols] if cols > 1 else 0.0
        w[k] = mean + a * pc[0] + b * pc[1]
    return Codebook(rows, cols, w)


def weighted_moments(df: DataFrame, vec_col: str, weight_col: str | None = None):
    """Weighted mean vector and covariance matrix (population).

    Every task sums squares about its own mean; tasks are merged pairwise by the update of means and
    squares (Chan, Golub and LeVeque), in groups of ``MERGE`` until one row is left, so nothing cancels
    however far the data lies from the origin and no task or driver meets more than ``MERGE`` parts.
    """
    wcol = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    schema = "part long, n double, mean array<double>, ss array<double>"
    parts = cut_lineage(df.select(wcol.alias("w"), F.col(vec_col).cast("array<double>").alias("v")).mapInArrow(_moment_partials, schema))
    left = parts.count()
    while left > 1:
        parts = cut_lineage(parts.withColumn("part", F.floor(F.col("part") / MERGE)).groupBy("part")
                            .applyInArrow(_merge_moments, schema))
        left = parts.count()
    got = parts.collect()
    if not got:
        raise ValueError("no rows to fit")
    mean = np.array(got[0]["mean"])
    return mean, np.array(got[0]["ss"]).reshape(len(mean), len(mean)) / got[0]["n"]


MERGE = 64   # moment parts that one task merges


def merge_moments(a: tuple, b: tuple) -> tuple:
    """(weight, mean, squares about the mean) of two parts together."""
    n = a[0] + b[0]
    if not n:
        return a
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def _moment_batch(part: int, m: tuple) -> pa.RecordBatch:
    return pa.record_batch([pa.array([part], pa.int64()), pa.array([float(m[0])]), pa.array([m[1].tolist()], pa.list_(pa.float64())),
                            pa.array([m[2].ravel().tolist()], pa.list_(pa.float64()))], ["part", "n", "mean", "ss"])


def _moment_partials(batches):
    from pyspark import TaskContext
    total = None
    for b in batches:
        if not b.num_rows:
            continue
        X = b["v"].flatten().to_numpy().reshape(b.num_rows, -1)
        w = b["w"].to_numpy()
        n = w.sum()
        mean = (w[:, None] * X).sum(axis=0) / n if n else X[0] * 0
        Y = X - mean
        now = (n, mean, (Y * w[:, None]).T @ Y)
        total = now if total is None else merge_moments(total, now)
    if total is not None:
        yield _moment_batch(TaskContext.get().partitionId(), total)


def _merge_moments(group: pa.Table) -> pa.Table:
    rows = sorted(group.to_pylist(), key=lambda r: (r["n"], r["mean"]))     # the same order on every run
    parts = [(r["n"], np.array(r["mean"]), np.array(r["ss"]).reshape(len(r["mean"]), -1)) for r in rows]
    total = parts[0]
    for p in parts[1:]:
        total = merge_moments(total, p)
    return pa.Table.from_batches([_moment_batch(group["part"][0].as_py(), total)])


def init_codebook(df: DataFrame, vec_col: str, rows: int, cols: int, how: str = "pca",
                  id_cols: list[str] | None = None, word_col: str | None = None,
                  count_col: str | None = None, seed: int = 1) -> Codebook:
    if how == "pca":
        return init_pca(df, vec_col, rows, cols, count_col)
    if how == "random":
        dim = len(df.select(vec_col).first()[0])
        return init_random(rows, cols, dim, seed)
    if how == "sample":
        return init_sample(df, vec_col, id_cols or [word_col], rows, cols, seed)
    if how == "frequent":
        return init_frequent(df, vec_col, word_col, count_col, rows, cols)
    raise ValueError(f"unknown SOM initialisation {how!r}")


# ---- best matching unit -------------------------------------------------------------------

CACHE_CELLS = 150_000          # row x node products taken at once: they stay in a core's cache
FLOAT32_SCALE = 1e-12, 1e12    # lengths whose squares and products float32 holds


def _near_nodes(W: np.ndarray):
    """A function of rows: all (row, node) in row order whose node may be the row's nearest.

    |x - w|^2 / 2 without |x|^2 / 2 is one matrix product, taken in float32 about the nodes' mean; every node
    within the product's rounding of a row's best one is told, so exact distances of those few find the
    nearest.  Lengths that float32 does not hold are taken in float64.
    """
    def products(kind, centre):
        V = W - centre
        half = 0.5 * (V * V).sum(axis=1)
        far = float(np.sqrt(2 * half.max())) if len(V) else 0.0
        return centre, np.concatenate([V, -half[:, None]], axis=1).astype(kind).T.copy(), far, 4 * (W.shape[1] + 2) * np.finfo(kind).eps

    centre = W.mean(axis=0) if len(W) else np.zeros(W.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        single, double = products(np.float32, centre), products(np.float64, np.zeros(W.shape[1]))
    least, most = FLOAT32_SCALE

    def near(x: np.ndarray):
        for kind, (c, table, far, eps) in ((np.float32, single), (np.float64, double)):
            y = x - c
            length = np.sqrt((y * y).sum(axis=1))
            if kind is np.float32 and not (least < far < most and length.max(initial=0.0) < most):
                continue
            rows = np.ones((len(y), y.shape[1] + 1), kind)
            rows[:, :-1] = y
            part = rows @ table
            slack = 2 * eps * (length * far + far * far)
            flat = np.flatnonzero(part >= (part.max(axis=1) - slack.astype(kind))[:, None])
            return flat // len(W), flat % len(W)

    return near


def _bmu_block(X: np.ndarray, W: np.ndarray, metric: str, chunk: int):
    """Index and distance of the nearest node for each row; the lowest node wins ties."""
    n = X.shape[0]
    bmu = np.empty(n, dtype=np.int32)
    dist = np.empty(n, dtype=np.float64)
    if metric == "cosine":
        wn = np.linalg.norm(W, axis=1)
    if metric == "euclidean":
        near = _near_nodes(W)
        chunk = min(chunk, max(16, CACHE_CELLS // max(1, len(W))))
    for a in range(0, n, chunk):
        x = X[a:a + chunk]
        if metric == "euclidean":
            row, node = near(x)
            d2 = ((x[row] - W[node]) ** 2).sum(axis=1)
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            least = np.minimum.reduceat(d2, first)
            hit = np.flatnonzero(d2 == least[row])
            hit = hit[np.append(True, row[hit][1:] != row[hit][:-1])]      # the lowest node of equals
            bmu[a:a + chunk] = node[hit]
            dist[a:a + chunk] = np.sqrt(least)
        elif metric == "cosine":
            xn = np.linalg.norm(x, axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                cd = 1.0 - (x @ W.T) / (xn[:, None] * wn[None, :])
            cd = np.where(np.isnan(cd), np.inf, cd)
            j = np.argmin(cd, axis=1)
            bmu[a:a + chunk] = j
            dd = cd[np.arange(len(x)), j]
            dist[a:a + chunk] = np.where(np.isinf(dd), np.nan, dd)
        else:
            raise ValueError(f"unknown metric {metric!r}")
    return bmu, dist


def _chunk_rows(k: int, dim: int) -> int:
    return max(1, min(C.SCORE_CHUNK_ROWS, (32 * 1024 * 1024) // max(1, (k + dim) * 8)))


def bmu_search(df: DataFrame, vec_col: str, codebook: Codebook, metric: str = "euclidean",
               bmu_col: str = "bmu", dist_col: str = "dist", keep_vector: bool = True) -> DataFrame:
    """Attach each row's best matching unit and its distance.

    Narrow (no shuffle): the checked-size codebook is broadcast once and every Arrow batch
    is scored with vectorised numpy.  Rows are never paired with nodes in the plan.
    """
    codebook.check_size()
    sc = df.sparkSession.sparkContext
    bw = sc.broadcast(codebook.weights)
    chunk = _chunk_rows(codebook.k, codebook.dim)
    in_schema = df.schema
    fields = [f for f in in_schema.fields if keep_vector or f.name != vec_col]
    out_schema = T.StructType(fields + [T.StructField(bmu_col, T.IntegerType()),
                                        T.StructField(dist_col, T.DoubleType())])

    def score(batches):
        W = bw.value
        for pdf in batches:
            if pdf.empty:
                continue
            X = np.stack(pdf[vec_col].to_numpy()).astype(np.float64)
            j, d = _bmu_block(X, W, metric, chunk)
            if not keep_vector:
                pdf = pdf.drop(columns=[vec_col])
            pdf[bmu_col] = j
            pdf[dist_col] = d
            yield pdf

    return df.mapInPandas(score, out_schema)


# ---- batch SOM epochs -----------------------------------------------------------------------

def _bmu_partial_sums(df: DataFrame, vec_col: str, weight_col: str | None, codebook: Codebook) -> DataFrame:
    """Per-task sums ``(bmu, n, S)``; at most K rows leave each task."""
    codebook.check_size()
    bw = df.sparkSession.sparkContext.broadcast(codebook.weights)
    chunk = _chunk_rows(codebook.k, codebook.dim)
    cols = [F.col(vec_col).alias("v")] + ([F.col(weight_col).cast("double").alias("w")] if weight_col else [])

    def partial(batches):
        W = bw.value
        k, dim = W.shape
        n = np.zeros(k)
        s = np.zeros((k, dim))
        qe = 0.0
        for b in batches:
            if not b.num_rows:
                continue
            X = b["v"].flatten().to_numpy().astype(np.float64, copy=False).reshape(b.num_rows, dim)
            w = b["w"].to_numpy() if weight_col else np.ones(len(X))
            j, d = _bmu_block(X, W, "euclidean", chunk)
            order = np.argsort(j, kind="stable")
            first = np.flatnonzero(np.append(True, j[order][1:] != j[order][:-1]))
            n += np.bincount(j, w, k)
            s[j[order][first]] += np.add.reduceat((X * w[:, None])[order], first)
            qe += float((d * w).sum())
        hit = np.nonzero(n)[0]
        if len(hit):
            sums = pa.ListArray.from_arrays(np.arange(0, dim * len(hit) + 1, dim, dtype=np.int32), s[hit].ravel())
            yield pa.record_batch([pa.array(hit.astype(np.int32)), pa.array(n[hit]), sums,
                                   pa.array(np.append(qe, np.zeros(len(hit) - 1)))], ["bmu", "n", "s", "qe"])

    return df.select(*cols).mapInArrow(partial, "bmu int, n double, s array<double>, qe double")


def bmu_sums(df: DataFrame, vec_col: str, codebook: Codebook, weight_col: str | None = None) -> DataFrame:
    """``(bmu, n, s_i, i)`` totals per node and dimension: the reduce side of one epoch."""
    parts = _bmu_partial_sums(df, vec_col, weight_col, codebook)
    return (parts.select("bmu", "n", F.posexplode("s").alias("i", "v"))
                 .groupBy("bmu", "i").agg(F.sum("v").alias("s"), F.sum("n").alias("n")))


def kernel_matrix(codebook: Codebook, sigma: float | None) -> np.ndarray:
    """Neighbourhood weights between nodes: ``exp(-d/2)`` (sigma None) or Gaussian ``exp(-d^2/2s^2)``."""
    g = codebook.grid()
    d = np.sqrt(((g[:, None, :] - g[None, :, :]) ** 2).sum(-1))
    if sigma is None:
        return np.exp(-d / 2.0)
    return np.exp(-(d ** 2) / (2.0 * sigma ** 2))


def som_epoch(df: DataFrame, vec_col: str, codebook: Codebook, sigma: float | None = None,
              weight_col: str | None = None) -> tuple[Codebook, float]:
    """One batch-SOM epoch: ``w_j = sum_b h(j,b) S_b / sum_b h(j,b) n_b``.

    Returns the new codebook and the weighted quantisation error of the old one.
    """
    parts = _bmu_partial_sums(df, vec_col, weight_col, codebook)
    red = (parts.select("bmu", "n", "qe", F.posexplode("s").alias("i", "v"))
                .groupBy("bmu", "i").agg(F.sum("v").alias("s"),
                                         F.sum(F.when(F.col("i") == 0, F.col("n"))).alias("n"),
                                         F.sum(F.when(F.col("i") == 0, F.col("qe"))).alias("qe"))
                .collect())           # K * dim rows: model-sized
    k, dim = codebook.k, codebook.dim
    S = np.zeros((k, dim))
    n = np.zeros(k)
    qe = 0.0
    for r in red:
        S[r["bmu"], r["i"]] = r["s"]
        if r["i"] == 0:
            n[r["bmu"]] = r["n"]
            qe += r["qe"] or 0.0
    H = kernel_matrix(codebook, sigma)
    num = H @ S
    den = H @ n
    new = np.where(den[:, None] > 0, num / np.where(den[:, None] > 0, den[:, None], 1.0), codebook.weights)
    total = n.sum()
    return Codebook(codebook.rows, codebook.cols, new), (qe / total if total else 0.0)


def sigma_schedule(codebook: Codebook, epochs: int, start: float | None = None, end: float = 1.0):
    """Linearly shrinking neighbourhood radius, from half the larger map side to ``end``."""
    s0 = start if start is not None else max(1.0, max(codebook.rows, codebook.cols) / 2.0)
    if epochs <= 1:
        return [end if epochs == 1 else s0]
    return [s0 + (end - s0) * t / (epochs - 1) for t in range(epochs)]


def fit_som(df: DataFrame, vec_col: str, codebook: Codebook, epochs: int,
            kernel: str = "gaussian", weight_col: str | None = None, cache: bool = True,
            sigma_start: float | None = None, sigma_end: float = 0.5):
    """Run ``epochs`` batch-SOM epochs from ``codebook`` (warm start = pass a fitted map).

    The training rows are checkpointed once in the shared folder so each epoch re-reads
    them instead of recomputing their lineage.  ``kernel='exp'`` uses the fixed
    ``exp(-d/2)`` neighbourhood, ``'gaussian'`` a radius shrinking from ``sigma_start``
    (half the larger map side) to ``sigma_end``.
    """
    cols = [vec_col] + ([weight_col] if weight_col else [])
    data = df.select(*cols)
    if cache:
        data = cut_lineage(data)
    sigmas = (sigma_schedule(codebook, epochs, sigma_start, sigma_end) if kernel == "gaussian"
              else [None] * epochs)
    history = []
    for s in sigmas:
        codebook, qe = som_epoch(data, vec_col, codebook, s, weight_col)
        history.append(qe)
    return codebook, history


# ---- map read-outs ----------------------------------------------------------------------------

def umatrix(codebook_df: DataFrame) -> DataFrame:
    """Per node, the summed distance to its (up to 8) grid neighbours; edges are clipped.

    Each node lists its eight neighbour cells and meets them with an equi-join on the
    grid coordinates (cells outside the map find no partner), so no pairs are formed
    beyond the real neighbours.
    """
    from ..functions.vectors import euclidean

    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"))
                        for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)])
    a = (codebook_df.select("node", "gx", "gy", "w", F.explode(offsets).alias("o"))
                    .select("node", "gx", "gy", "w", (F.col("gx") + F.col("o.dx")).alias("nx"),
                            (F.col("gy") + F.col("o.dy")).alias("ny")))
    b = codebook_df.select(F.col("gx").alias("nx"), F.col("gy").alias("ny"), F.col("w").alias("w_b"))
    j = a.join(b, ["nx", "ny"])
    return (j.groupBy("node", "gx", "gy")
             .agg(F.sum(euclidean("w", "w_b")).alias("umatrix"), F.count("*").alias("neighbours")))


def bmu_hits(scored: DataFrame, bmu_col: str = "bmu", weight_col: str | None = None) -> DataFrame:
    """Rows per node (the hit map)."""
    agg = F.sum(weight_col).alias("hits") if weight_col else F.count("*").alias("hits")
    return scored.groupBy(bmu_col).agg(agg)
