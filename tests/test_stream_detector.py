"""The resumable detector: versions, look-back, replays, restarts, empty batches, late rows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from outlog.streaming.detector import StreamDetector, counters, fit_frequency, score_frequency

T0 = datetime(2024, 1, 1)
SCHEMA = "id long, key string, ts timestamp"


def batch(spark, rows):
    return spark.createDataFrame([(i, k, T0 + timedelta(seconds=s)) for i, (k, s) in enumerate(rows)], SCHEMA)


def detector(root, **more):
    return StreamDetector(str(root), fit_frequency("key", 1.0), score_frequency("key"), **{"refit_every": 3, "train_span": 100, "late_after": 20, **more})


def runs(spark, det):
    return [tuple(r) for r in det.table(spark, "runs").orderBy("batch").select(
        "batch", "model_version", "trained", "rows_in", "rows_scored", "rows_late").collect()]


def test_versions_look_back_and_late_rows(spark, tmp_path):
    det = detector(tmp_path / "a")
    for i, rows in enumerate([[("x", 0), ("x", 10), ("y", 50)], [("x", 60), ("z", 30)], [], [("y", 140), ("x", 41)], [("z", 1000)]]):
        det.handle(batch(spark, rows), i)
    assert runs(spark, det) == [(0, 0, 1, 3, 3, 2), (1, 0, 0, 2, 2, 1), (2, 0, 0, 0, 0, 0), (3, 3, 1, 2, 2, 1), (4, 3, 0, 1, 1, 0)]
    model = {r.key: r.s for r in spark.read.parquet(f"{det.root}/models/version=3").collect()}
    # seconds 40 to 140: y at 50, x at 60 and 41, y at 140; z at 30 and the first x lie before
    assert sorted(model) == ["x", "y"] and abs(model["x"] - model["y"]) < 1e-12
    got = det.table(spark, "predictions").where("batch = 4").first()
    assert got.key == "z" and got.anomaly == 1 and got.model_version == 3
    totals = counters(det.table(spark, "runs")).first()
    assert (totals.trainings, totals.inferences, totals.rows_in, totals.rows_late) == (2, 4, 8, 4)


def test_a_replayed_batch_replaces_its_rows(spark, tmp_path):
    det = detector(tmp_path / "b")
    det.handle(batch(spark, [("x", 0), ("y", 5)]), 0)
    det.handle(batch(spark, [("x", 7)]), 1)
    first = sorted(map(tuple, det.table(spark, "predictions").collect()))
    detector(tmp_path / "b").handle(batch(spark, [("x", 7)]), 1)      # another process, the same batch
    assert sorted(map(tuple, det.table(spark, "predictions").collect())) == first and len(runs(spark, det)) == 2


def test_history_beyond_the_look_back_is_dropped(spark, tmp_path):
    det = detector(tmp_path / "c")
    for i, at in enumerate([0, 50, 500, 520]):
        det.handle(batch(spark, [("x", at)]), i)
    left = sorted(r.batch for r in det.table(spark, "history").select("batch").distinct().collect())
    assert left == [2, 3]
    assert spark.read.parquet(f"{det.root}/models/version=3").first().total == 2


def test_a_restart_goes_on_with_the_next_batch(spark, tmp_path):
    inbox = str(tmp_path / "inbox")
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(inbox)
    for k in range(3):
        batch(spark, [("x", 10 * k), ("y", 10 * k + 1)]).coalesce(1).write.mode("append").parquet(inbox)
    detector(tmp_path / "d").run(stream())
    for k in range(3, 5):
        batch(spark, [("x", 10 * k)]).coalesce(1).write.mode("append").parquet(inbox)
    det = detector(tmp_path / "d")
    det.run(stream())
    assert [r[:4] for r in runs(spark, det)] == [(0, 0, 1, 2), (1, 0, 0, 2), (2, 0, 0, 2), (3, 3, 1, 1), (4, 3, 0, 1)]
    assert det.table(spark, "predictions").groupBy("id", "ts").agg(F.count("*").alias("n")).where("n > 1").count() == 0
