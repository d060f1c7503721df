import datetime as dt
import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from outlog.operators import alerts, evaluate, outliers, prefix, timeline

T0 = dt.datetime(2024, 1, 1)


def _events(spark, n=400, keys=3, seed=4, span_s=20000):
    rng = np.random.default_rng(seed)
    secs = np.sort(rng.integers(0, span_s, n))
    secs[10:14] = secs[10]                     # a run of equal timestamps
    rows = [(i, T0 + dt.timedelta(seconds=int(s)), int(rng.integers(0, keys))) for i, s in enumerate(secs)]
    return spark.createDataFrame(rows, "id long, ts timestamp, k long"), pd.DataFrame(rows, columns=["id", "ts", "k"])


def test_trailing_count_brute_force(spark):
    df, pdf = _events(spark)
    got = {r["id"]: r["c"] for r in timeline.trailing_count(df, "ts", ["k"], 600, "id", "c").collect()}
    for r in pdf.itertuples():
        same = pdf[(pdf.k == r.k) & (pdf.ts >= r.ts - pd.Timedelta(seconds=600)) & (pdf.ts <= r.ts)]
        assert got[r.id] == len(same)


def test_trailing_count_window_ends_are_inclusive(spark):
    # rows exactly `width` apart, across bucket edges, with equal timestamps
    secs = [0, 600, 600, 1200, 1799, 1800, 2400]
    rows = [(i, T0 + dt.timedelta(seconds=s), 1) for i, s in enumerate(secs)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, k long")
    got = {r["id"]: r["c"] for r in timeline.trailing_count(df, "ts", ["k"], 600, "id", "c").collect()}
    assert [got[i] for i in range(len(secs))] == [1, 3, 3, 3, 2, 3, 2]


def _greedy_ref(pdf, gap):
    kept = []
    for k, g in pdf.sort_values(["ts", "id"]).groupby("k"):
        last = None
        for r in g.itertuples():
            if last is None or r.ts >= last + pd.Timedelta(seconds=gap):
                kept.append(r.id)
                last = r.ts
    return sorted(kept)


def test_greedy_gap_brute_force(spark):
    df, pdf = _events(spark, 300, 2)
    for gap in (60, 900, 5000):
        ref = _greedy_ref(pdf, gap)
        assert sorted(r["id"] for r in timeline.greedy_gap(df, "ts", ["k"], gap, "id").collect()) == ref


def test_greedy_gap_slices_do_not_change_the_walk(spark):
    """Short and long slices, empty stretches, equal times, times before 1970 and one batch a row."""
    rng = np.random.default_rng(11)
    secs = np.concatenate([rng.integers(-500, 500, 120), rng.integers(40_000, 41_000, 150), [90_000, 90_000], np.arange(0, 3000, 10)])
    rows = [(i, dt.datetime(1970, 1, 1) + dt.timedelta(seconds=int(s)), int(i % 2)) for i, s in enumerate(secs)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, k long").withColumn("ts", F.col("ts").cast("timestamp"))
    pdf = pd.DataFrame(rows, columns=["id", "ts", "k"])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch, gap, wide in ((10000, 30, 1), (10000, 30, 3), (7, 30, 64), (1, 200, 2), (10000, 5000, 64)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
            got = timeline.greedy_gap(df, "ts", ["k"], gap, "id", slice_gaps=wide)
            assert sorted(r["id"] for r in got.collect()) == _greedy_ref(pdf, gap)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert timeline.greedy_gap(df.where("false"), "ts", ["k"], 30, "id").count() == 0
    assert timeline.greedy_gap(df, "ts", ["k"], 0, "id").count() == len(rows)
    untimed = df.withColumn("ts", F.when(F.col("id") > 3, F.col("ts")))
    assert timeline.greedy_gap(untimed, "ts", ["k"], 30, "id").where("ts is null").count() == 0


def test_frequency_and_flatline(spark):
    rows = [(1, T0), (2, T0 + dt.timedelta(seconds=30)), (3, T0 + dt.timedelta(seconds=100)),
            (4, T0 + dt.timedelta(minutes=20)), (5, T0 + dt.timedelta(hours=3))]
    df = spark.createDataFrame(rows, "id long, ts timestamp")
    fired = [r["id"] for r in alerts.frequency_alert(df, "ts", "id", None, None, 2, 120, 600).orderBy("id").collect()]
    assert fired == [2]               # 2 and 3 reach two events in 2 minutes; 3 is within 10 minutes of 2
    flat = alerts.flatline_alert(df, "ts", None, None, 1, 3600).collect()
    assert sorted(r["period_start"] for r in flat) == [T0 + dt.timedelta(hours=1), T0 + dt.timedelta(hours=2)]


def test_running_sum_equals_cumsum(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), int(i), int(v)) for i, (g, v) in enumerate(zip(rng.integers(0, 3, 500), rng.integers(0, 2, 500)))]
    df = spark.createDataFrame(rows, "g long, o long, v long")
    got = {r["o"]: r["run"] for r in prefix.running_sum(df, "v", ["o"], ["g"], "run", n_blocks=7).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "o", "v"]).sort_values("o")
    pdf["run"] = pdf.groupby("g")["v"].cumsum()
    assert all(got[o] == r for o, r in zip(pdf.o, pdf.run))


def test_knn_and_lof_brute_force(spark):
    rng = np.random.default_rng(3)
    X = np.concatenate([rng.normal(size=(60, 3)), [[8.0, 8.0, 8.0]]])
    df = spark.createDataFrame([(i, X[i].tolist()) for i in range(len(X))], "id long, v array<double>")
    k = 5
    nn = outliers.knn(df, "id", "v", k, block_rows=16)
    got = {}
    for r in nn.collect():
        got.setdefault(r["id"], {})[r["rank"]] = r["nbr"]
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    order = np.argsort(D, axis=1, kind="stable")[:, :k]
    for i in range(len(X)):
        assert [got[i][j + 1] for j in range(k)] == order[i].tolist()
    kd = D[np.arange(len(X)), order[:, -1]]
    reach = np.maximum(kd[order], D[np.arange(len(X))[:, None], order])
    lrd = 1 / (reach.mean(1) + 1e-10)
    ref = lrd[order].mean(1) / lrd
    lof = {r["id"]: (r["lof"], r["label"]) for r in outliers.lof(df, "id", "v", k, block_rows=16).collect()}
    assert all(abs(lof[i][0] - ref[i]) < 1e-9 for i in range(len(X)))
    assert lof[60][1] == -1


def test_knn_rules_cells_out_and_stays_exact(spark, monkeypatch):
    """Clusters, a third of all points equal, k beyond a cell, odd vectors; few block pairs are compared."""
    rng = np.random.default_rng(8)
    X = np.concatenate([c + rng.normal(size=(40, 2)) for c in rng.normal(scale=300, size=(6, 2))] + [np.full((120, 2), 7.0)])
    rows = [(i, x.tolist()) for i, x in enumerate(X)]
    odd = [(1000, None), (1001, [float("nan"), 1.0]), (1002, [None, 1.0]), (1003, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows + odd, "id long, v array<double>")
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    order = np.argsort(D, axis=1, kind="stable")
    seen = spark.sparkContext.accumulator(0)
    inner = outliers._block_knn

    def counted(k):
        run = inner(k)

        def wrapped(q, d):
            seen.add(len(q))
            return run(q, d)
        return wrapped
    monkeypatch.setattr(outliers, "_block_knn", counted)
    for k in (3, 50):
        seen.value = 0
        got = {}
        for r in outliers.knn(df, "id", "v", k, block_rows=16).collect():
            got.setdefault(r["id"], {})[r["rank"]] = (r["nbr"], r["dist"])
        assert sorted(got) == list(range(len(X)))
        for i in got:
            assert [got[i][j + 1][0] for j in range(k)] == order[i, :k].tolist()
            assert np.allclose([got[i][j + 1][1] for j in range(k)], D[i, order[i, :k]])
        if k == 3:
            assert seen.value < len(X) * math.ceil(len(X) / 16) / 2     # queries x blocks without bounds
    few = outliers.knn(df.where("id < 4"), "id", "v", 10).groupBy("id").count().collect()
    assert sorted((r["id"], r["count"]) for r in few) == [(i, 3) for i in range(4)]
    assert outliers.knn(df.where("id >= 1000"), "id", "v", 3).count() == 0


def _unit(*parts):
    return int(hashlib.md5(":".join(str(p) for p in parts).encode()).hexdigest()[:8], 16) / 4294967296.0


def test_corruption_matches_sequential_loop(spark):
    msgs = ["hello world", "x", "", "ünïcödé text 😀 end", "a" * 50]
    df = spark.createDataFrame([(i, 0, m) for i, m in enumerate(msgs)], "doc_id long, line_no int, message string")
    got = {r["doc_id"]: r["c"] for r in df.select("doc_id", evaluate.corrupt(F.col("message"), ["doc_id", "line_no"]).alias("c")).collect()}
    for i, m in enumerate(msgs):
        s = list(m)
        for step in range(round(len(m) * 1.0)):
            p = int(_unit(42, "pos", i, 0, step) * len(m))
            c = chr(65 + int(_unit(42, "chr", i, 0, step) * 59))
            s[p] = c
        assert got[i] == "".join(s)


def test_null_keys_and_repeated_ids_are_kept(spark):
    """Null keys are a group of their own in running sums, trailing counts and gap selection."""
    import datetime as dt
    from outlog.operators.prefix import running_sum
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, k, t0 + dt.timedelta(seconds=10 * i)) for i, k in enumerate([None, None, "a", "a", None])]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp")
    got = {r["id"]: r["s"] for r in running_sum(df, F.lit(1), ["ts", "id"], ["k"], "s", n_blocks=3).collect()}
    assert got == {0: 1, 1: 2, 2: 1, 3: 2, 4: 3}
    same_id = df.withColumn("id", F.lit(7))
    trail = timeline.trailing_count(same_id, "ts", ["k"], 15, "id", "n").select("k", "n").collect()
    assert sorted((r["k"] or "", r["n"]) for r in trail) == [("", 1), ("", 1), ("", 2), ("a", 1), ("a", 2)]
    kept = {r["id"] for r in timeline.greedy_gap(df, "ts", ["k"], 30, "id").collect()}
    assert kept == {0, 2, 4}


def test_spread_of_close_distances_does_not_cancel(spark):
    from outlog.operators.detect import score_stats
    d = [1e8, 1e8 + 1, 1e8 + 2]
    st = score_stats(spark.createDataFrame([(x,) for x in d], "dist double"))
    assert abs(st.std * max(d) - (2 / 3) ** 0.5) < 1e-6


def test_knn_in_rounds_far_from_the_origin(spark, monkeypatch):
    """Rounds of cells give the exact neighbours where squares cancel, and keep the last round's alone."""
    import os

    from outlog import session
    made, path = [], session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda s, name: made.append(path(s, name)) or made[-1])
    x = np.round(np.random.default_rng(3).normal(size=(150, 3)), 2) + 1e6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {(r["id"], r["rank"]): (r["nbr"], r["dist"]) for r in outliers.knn(df, "id", "v", 4, block_rows=16).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for i in range(150):
        near = sorted((d[i, j], j) for j in range(150) if j != i)[:4]
        assert [got[i, r + 1] for r in range(4)] == [(j, v) for v, j in near]
    assert sum(os.path.isdir(p) for p in made) == 3     # points, points by cell, neighbours


def test_knn_moves_points_once_a_group_and_meets_shards_in_rounds(spark, monkeypatch):
    """Small groups and shards: exact, a round moves each packed block once for each of a shard's groups, repeated ids share a list."""
    monkeypatch.setattr(outliers, "GROUPS", 6)
    monkeypatch.setattr(outliers, "SHARD_BYTES", 2 * 8 * 4 * 20)
    monkeypatch.setattr(outliers, "BLOCK_ROWS", 1)
    monkeypatch.setattr(outliers, "HELD", 1)
    rounds, cut = [], outliers.cut_over
    monkeypatch.setattr(outliers, "cut_over", lambda df, old, **o: rounds.append(old) or cut(df, old, **o))
    x = np.random.default_rng(6).normal(size=(118, 4))
    x[40:60] = x[40]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5, x[6].tolist()), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r["id"], r["rank"]): (r["nbr"], r["dist"]) for r in outliers.knn(df, "id", "v", 7, block_rows=8).collect()}
    assert len(rounds) == 2 + 3 and len(got) == 118 * 7
    for i in range(118):
        near = sorted((float(np.sqrt(((np.array(a) - np.array(b)) ** 2).sum())), j) for k, a in rows if k == i for j, b in rows if j != i)[:7]
        assert [got[i, r + 1][0] for r in range(7)] == [j for _, j in near]
        assert np.allclose([got[i, r + 1][1] for r in range(7)], [d for d, _ in near], rtol=0, atol=1e-12)
