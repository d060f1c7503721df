import numpy as np
import pytest
from pyspark.sql import functions as F

from outlog.operators import som
from outlog.sources.models import ModelLoadError, load_model, save_model
from outlog.operators.detect import ScoreStats


def _points(spark, n=300, dim=5, seed=3):
    rng = np.random.default_rng(seed)
    X = rng.random((n, dim))
    return spark.createDataFrame([(i, X[i].tolist()) for i in range(n)], "id long, v array<double>"), X


def test_bmu_matches_brute_force(spark):
    df, X = _points(spark)
    cb = som.init_random(3, 4, X.shape[1], seed=2)
    got = {r["id"]: (r["bmu"], r["dist"]) for r in som.bmu_search(df, "v", cb).collect()}
    d = np.sqrt(((X[:, None, :] - cb.weights[None]) ** 2).sum(-1))
    for i in range(len(X)):
        assert got[i][0] == int(np.argmin(d[i]))
        assert abs(got[i][1] - d[i].min()) < 1e-12


def test_ties_go_to_lowest_node(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0])], "id long, v array<double>")
    cb = som.Codebook(1, 2, np.array([[1.0, 0.0], [0.0, 1.0]]))
    assert som.bmu_search(df, "v", cb).first()["bmu"] == 0


def test_epoch_equals_numpy_batch_update(spark):
    df, X = _points(spark, 200, 3)
    cb = som.init_random(2, 3, 3, seed=4)
    new, qe = som.som_epoch(df, "v", cb, sigma=1.0)
    d = np.sqrt(((X[:, None, :] - cb.weights[None]) ** 2).sum(-1))
    b = d.argmin(1)
    H = som.kernel_matrix(cb, 1.0)
    S = np.zeros_like(cb.weights)
    n = np.zeros(cb.k)
    for i, j in enumerate(b):
        S[j] += X[i]
        n[j] += 1
    expect = (H @ S) / (H @ n)[:, None]
    assert np.allclose(new.weights, expect, atol=1e-12)
    assert abs(qe - d.min(1).mean()) < 1e-12


def test_weighted_rows_equal_repeated_rows(spark):
    rows = [(0, [0.0, 0.0], 3), (1, [1.0, 1.0], 1), (2, [0.2, 0.1], 2)]
    w = spark.createDataFrame(rows, "id long, v array<double>, n long")
    rep = spark.createDataFrame([(i, v) for i, v, n in rows for _ in range(n)], "id long, v array<double>")
    cb = som.init_random(1, 2, 2, seed=1)
    a, _ = som.som_epoch(w, "v", cb, None, weight_col="n")
    b, _ = som.som_epoch(rep, "v", cb, None)
    assert np.allclose(a.weights, b.weights)


def test_fit_reduces_quantisation_error(spark):
    rng = np.random.default_rng(8)
    centres = rng.random((4, 4)) * 10
    X = np.concatenate([c + rng.normal(scale=0.1, size=(100, 4)) for c in centres])
    clustered = spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))], "id long, v array<double>")
    cb = som.init_random(2, 2, 4, seed=9)
    fitted, hist = som.fit_som(clustered, "v", cb, epochs=8, sigma_end=0.2)
    final = som.bmu_search(clustered, "v", fitted).agg(F.avg("dist")).first()[0]
    assert final < hist[0] / 2
    df, X = _points(spark, 400, 4)
    # two-by-two map on 2,000-ish rows: normalised distances sum to at most the row count
    small, _ = som.fit_som(df, "v", som.init_pca(df, "v", 2, 2), epochs=3)
    s = som.bmu_search(df, "v", small)
    mx = s.agg(F.max("dist")).first()[0]
    assert s.agg(F.sum(F.col("dist") / mx)).first()[0] <= s.count()
    assert small.weights.shape == (4, 4)


def test_init_modes(spark):
    df, X = _points(spark, 50, 2)
    assert som.init_sample(df, "v", ["id"], 2, 2).weights.shape == (4, 2)
    assert som.init_codebook(df, "v", 2, 3, "random").weights.shape == (6, 2)
    with pytest.raises(ValueError):
        som.init_codebook(df, "v", 2, 2, "nope")
    few = som.init_sample(df.limit(2), "v", ["id"], 2, 2).weights  # fewer rows than nodes: repeated in turn
    assert few.shape == (4, 2) and (few[:2] == few[2:]).all()
    with pytest.raises(ValueError):
        som.init_sample(df.limit(0), "v", ["id"], 2, 2)


def test_umatrix_clips_edges(spark):
    cb = som.Codebook(2, 3, np.arange(12, dtype=float).reshape(6, 2))
    u = {r["node"]: r["neighbours"] for r in som.umatrix(cb.to_df(spark)).collect()}
    assert u[0] == 3 and u[1] == 5 and u[4] == 5 and u[5] == 3


def test_model_store_round_trip(spark, tmp_root):
    cb = som.init_random(2, 2, 3)
    vec = spark.createDataFrame([("a", [0.1, 0.2, 0.3])], "word string, vector array<double>")
    base = str(tmp_root / "models")
    with pytest.raises(ModelLoadError):
        load_model(spark, base)
    save_model(spark, base, "v7", vec, cb, ScoreStats(0.1, 0.2, 3.0, 0.0))
    v, c, s = load_model(spark, base)
    assert v.count() == 1 and np.allclose(c.weights, cb.weights) and s.max_dist == 3.0


def test_production_fit_equals_a_batch_map_in_numpy(spark):
    """24 x 24 nodes, 105 epochs, principal-component start: every epoch against plain numpy."""
    from outlog.config import DetectorConfig
    cfg = DetectorConfig()
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6)) * [3, 2, 1, 1, .5, .1] + 100
    n = rng.integers(1, 9, 300).astype(float)
    df = spark.createDataFrame([(x[i].tolist(), float(n[i])) for i in range(300)], "v array<double>, n double").repartition(4)
    start = som.init_pca(df, "v", cfg.map_rows, cfg.map_cols, "n")
    mean, cov = np.average(x, axis=0, weights=n), np.cov(x.T, fweights=n.astype(int), bias=True)
    m, c = som.weighted_moments(df, "v", "n")
    assert np.allclose(m, mean) and np.allclose(c, cov)
    fitted, errors = som.fit_som(df, "v", start, cfg.epochs, weight_col="n")
    w = start.weights
    for k, sigma in enumerate(som.sigma_schedule(start, cfg.epochs, end=0.5)):
        d = np.sqrt(((x[:, None] - w[None]) ** 2).sum(2))
        b = d.argmin(1)
        assert abs(errors[k] - np.average(d.min(1), weights=n)) < 1e-9
        h = som.kernel_matrix(start, sigma)[:, b] * n
        total = h.sum(1)
        w = np.where(total[:, None] > 0, h @ x / np.where(total > 0, total, 1)[:, None], w)
    assert np.allclose(fitted.weights, w, atol=1e-9)


def test_nearest_nodes_keep_ties_and_survive_far_data():
    """The matrix product finds the node that exact distances find, the lowest of equals."""
    rng = np.random.default_rng(1)
    w = np.repeat(rng.normal(size=(40, 5)), 2, axis=0) + 1e6
    x = np.concatenate([w[rng.integers(0, 80, 200)], rng.normal(size=(300, 5)) + 1e6])
    d2 = ((x[:, None] - w[None]) ** 2).sum(2)
    j, d = som._bmu_block(x, w, "euclidean", 64)
    assert (j == d2.argmin(1)).all() and np.array_equal(d, np.sqrt(d2.min(1)))


def test_moments_do_not_cancel_and_merge_in_groups(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(500, 3)) + 1e8
    monkeypatch.setattr(som, "MERGE", 3)
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(11)
    mean, cov = som.weighted_moments(df, "v")
    assert np.allclose(mean - 1e8, (x - 1e8).mean(0)) and np.allclose(cov, np.cov((x - 1e8).T, bias=True), rtol=1e-6, atol=1e-6)


def test_nearest_nodes_are_exact_in_float32_and_few_are_compared():
    rng = np.random.default_rng(5)
    for scale, offset, n in ((1, 0, 300), (1e-3, 1e3, 300), (1e-20, 0, 50), (1e20, 0, 50), (1, 1e9, 50)):
        W = offset + scale * rng.normal(size=(40, 7))
        W[11] = W[3]
        X = offset + scale * rng.normal(size=(n, 7))
        X[:5], X[5] = W[[3, 11, 3, 0, 39]], (W[1] + W[2]) / 2
        d2 = ((X[:, None, :] - W[None, :, :]) ** 2).sum(axis=2)
        bmu, dist = som._bmu_block(X, W, "euclidean", 64)
        assert (bmu == d2.argmin(axis=1)).all() and (dist == np.sqrt(d2.min(axis=1))).all()
    W, X = rng.normal(size=(576, 25)), rng.normal(size=(200, 25))
    row, _ = som._near_nodes(W)(X)
    assert (np.unique(row) == np.arange(200)).all() and len(row) < 220
