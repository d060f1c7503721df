import os

from pyspark.sql import functions as F

import __spark_entry__ as E
from outlog.plans import queries as Q
from outlog.streaming import jobs


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_stream_realert_equals_batch(spark, sf_small):
    s = jobs.q_stream_realert(spark, sf_small)
    b = Q.q_realert_suppression(spark, sf_small)
    assert _rows(s, ["user_id", "event_id"]) == _rows(b, ["user_id", "event_id"])


def test_stream_rate_is_batch_minus_open_windows(spark, sf_small):
    s = jobs.q_stream_rate_1m(spark, sf_small)
    b = Q.q_rate_1m(spark, sf_small)
    wm = spark.read.parquet(f"{sf_small}/events.parquet").agg(F.max("ts")).first()[0]
    closed = b.where(F.col("window_start") + F.expr("INTERVAL 1 MINUTE") <= F.lit(wm) - F.expr("INTERVAL 30 MINUTES"))
    assert _rows(s, ["event_type", "window_start", "n"]) == _rows(closed, ["event_type", "window_start", "n"])


def test_stream_flatline_timer_fires_on_silence(spark, tmp_root):
    import datetime as dt
    import pandas as pd

    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(minutes=10 * i)) for i in range(60)]
    rows += [("b", t0 + dt.timedelta(minutes=10 * i)) for i in range(6)]
    d = tmp_root / "silence"
    d.mkdir()
    pd.DataFrame(rows, columns=["event_type", "ts"]).to_parquet(d / "ev.parquet", index=False, coerce_timestamps="us")
    out = jobs.run_to_table(jobs.stream_flatline_timer(jobs.table_stream(spark, str(d), "ev")), "flat-timer")
    got = [(r["event_type"], r["last_seen"], r["next_seen"]) for r in out.collect()]
    assert got == [("b", t0 + dt.timedelta(minutes=50), None)]


def test_late_rows_neither_end_a_silence_nor_move_the_state_back():
    import numpy as np
    import pandas as pd

    class State:
        exists, get = True, (7_200_000_000,)

    def frames(*hours):
        return iter([pd.DataFrame({"__us": [int(h * 3_600_000_000) for h in hours]})])

    assert np.array_equal(jobs._times(frames(2.1, 0.5), State), [7_200_000_000, 7_560_000_000])
    assert np.array_equal(jobs._times(frames(1.0), State), [7_200_000_000])


def test_stream_predict_equals_batch_and_replays(spark, sf_small):
    s = jobs.q_stream_predict(spark, sf_small)
    b = Q.q_predict_lines(spark, sf_small)
    cols = ["doc_id", "line_no", "predict_id", "anomaly", "suppressed"]
    assert _rows(s, cols) == _rows(b, cols)
    again = jobs.q_stream_predict(spark, sf_small)
    assert _rows(again, cols) == _rows(s, cols)


def test_entry_and_registry(spark):
    out = E.entry(spark)
    rows = out.collect()
    assert 0 < len(rows) <= 20
    assert {"doc_id", "line_no", "anomaly_score", "anomaly"} <= set(out.columns)
    qs, os_ = E.queries(), E.oracle_sql()
    assert set(os_) <= set(qs)
    assert len(qs) >= 60


def test_every_oracle_query_runs_at_smoke_scale(spark, sf_small):
    """Each SQL-checked query builds and returns rows at sf0.001 (full check: tools/check_oracle.py)."""
    qs, os_ = E.queries(), E.oracle_sql()
    cheap = [n for n in os_ if not n.startswith("stream_")][:12]
    for n in cheap:
        assert qs[n](spark, sf_small).count() >= 0


def test_pipeline_steps_and_encoder_catalog(spark):
    import pytest
    from outlog.plans.steps import get_encoder, run_steps

    df = spark.range(5)
    out = run_steps(df, [lambda d: d.where("id > 1"), lambda d: d.withColumn("x", d.id * 2)])
    assert out.count() == 3 and "x" in out.columns
    with pytest.raises(TypeError):
        run_steps(df, [lambda d: d, "not a step"])
    with pytest.raises(TypeError):
        run_steps(df, [lambda d: 3])
    assert get_encoder("w2v_encoder") == "word2vec"
    with pytest.raises(ValueError):
        get_encoder("doc2vec")


def test_counter_rate_handles_resets(spark):
    import datetime as dt
    from outlog.operators.metrics import counter_rate

    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(seconds=60 * i), v) for i, v in enumerate([10, 70, 130, 20])]
    s = spark.createDataFrame(rows, "k string, ts timestamp, v long")
    got = [r["rate"] for r in counter_rate(s, ["k"], "ts", "v").orderBy("ts").collect()]
    assert got == [None, 1.0, 1.0, 20 / 60]


def test_a_table_that_is_a_folder_of_files_is_streamed(spark, tmp_path):
    """Every file of the table's folder is read, and no file of another table."""
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "ev.parquet"))
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "other.parquet"))
    out = jobs.run_to_table(jobs.table_stream(spark, str(tmp_path), "ev"), "folder")
    assert sorted(r[0] for r in out.collect()) == list(range(10))
    one = tmp_path / "one"
    one.mkdir()
    next((tmp_path / "other.parquet").glob("part-*.parquet")).rename(one / "ev.parquet")
    assert jobs.run_to_table(jobs.table_stream(spark, str(one), "ev"), "file").count() == 5
