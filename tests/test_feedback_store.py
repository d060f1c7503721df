"""The stored feedback table: second inserts, replays, unfinished inserts, earlier versions."""

from datetime import datetime

from outlog.operators.feedback_store import FeedbackStore

COLS = "predict_id string, message string, reported_anomaly_status boolean, created_date timestamp, customer_id string, reject_reason string"


def rows(spark, ids, day=1, reason=None):
    return spark.createDataFrame([(i, f"m{i}", True, datetime(2024, 1, day), "c", reason) for i in ids], COLS)


def ids(df):
    return sorted((r.id, r.predict_id) for r in df.collect())


def test_second_insert_meets_the_first(spark, tmp_path):
    store = FeedbackStore(spark, str(tmp_path / "f"), buckets=4)
    assert store.version() == 0 and store.read().count() == 0
    assert store.insert(rows(spark, ["a", "b", "b"]), "one") == 1
    assert store.insert(rows(spark, ["b", "c"], 2).unionByName(rows(spark, ["bad"], 2, "null_message")), "two") == 2
    assert ids(store.read()) == [(1, "a"), (2, "b"), (3, "c")] and ids(store.read(1)) == [(1, "a"), (2, "b")]
    got = sorted((r.version, r.predict_id, r.reject_reason) for r in store.rejects().collect())
    assert got == [(1, "b", "duplicate_predict_id"), (2, "b", "duplicate_predict_id"), (2, "bad", "null_message")]
    # a replay of either batch, by another process, changes nothing
    again = FeedbackStore(spark, str(tmp_path / "f"), buckets=4)
    assert again.insert(rows(spark, ["a", "b", "b"]), "one") == 1 and again.version() == 2 and again.read().count() == 3


def test_an_unfinished_insert_is_not_seen_and_is_replaced(spark, tmp_path):
    root = tmp_path / "g"
    store = FeedbackStore(spark, str(root), buckets=4)
    store.insert(rows(spark, ["a"]), "one")
    store.insert(rows(spark, ["x"], 2), "two")
    (root / "manifest" / "version=2" / "_SUCCESS").unlink()        # as if the writer had been lost before the end
    assert store.version() == 1 and ids(store.read()) == [(1, "a")]
    assert store.insert(rows(spark, ["y"], 2), "three") == 2 and ids(store.read()) == [(1, "a"), (2, "y")]
    # nothing to insert still makes a version, and only touched buckets are written
    assert store.insert(rows(spark, ["a"], 3), "four") == 3 and ids(store.read()) == [(1, "a"), (2, "y")]
    assert not list((root / "data" / "version=3").glob("bucket=*"))


def test_the_first_insert_may_hold_nothing(spark, tmp_path):
    store = FeedbackStore(spark, str(tmp_path / "h"))
    assert store.insert(rows(spark, ["q"], 1, "null_message"), "one") == 1 and store.read().count() == 0
    assert store.insert(rows(spark, ["q"]), "two") == 2 and ids(store.read()) == [(1, "q")]
