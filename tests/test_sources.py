import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from outlog.sources import catalog, logs, sinks
from tests import fixtures


def test_order_log_has_512_rows(spark, log_tree):
    df = logs.read_common_log(spark, os.path.join(log_tree, "orders-500.log"))
    assert df.count() == 512
    by = {r["template"]: r["count"] for r in df.groupBy("template").count().collect()}
    assert by["FulfilmentOrderplacedforitemsofcheesewhichcosts"] == 500
    assert by["FulfilmentOrderplacedforitemsofmilkwhichcosts"] == 2
    assert by["FulfilmentOrderplacedforitemsofalmondswhichcosts"] == 10


def test_common_log_columns(spark, log_tree):
    r = logs.read_common_log(spark, os.path.join(log_tree, "orders-500.log")).first()
    assert r["severity"] == "INFO"
    assert r["message"].startswith("Fulfilment - Order placed for")
    assert isinstance(r["ts"], dt.datetime)
    assert r["source"].endswith("orders-500.log")


def test_directory_read_is_812_rows(spark, log_tree):
    assert logs.read_log_dir(spark, log_tree).count() == 812


def test_directory_reads_json_too(spark, tmp_root, log_tree):
    root = str(tmp_root / "mixed")
    fixtures.write_log_tree(root)
    fixtures.write_hadoop_json(os.path.join(root, "extra.json"))
    df = logs.read_log_dir(spark, root)
    assert df.count() == 812 + 2000


def test_json_array_and_flatten(spark, tmp_root):
    p = fixtures.write_hadoop_json(str(tmp_root / "nested.json"), nested=True)
    df = logs.read_json_logs(spark, p)
    assert df.count() == 2000
    assert {"message", "k8s.pod", "k8s.ns", "tags", "template"} <= set(df.columns)
    assert df.select("template").distinct().count() == 141


def test_dispatch_rejects_unknown(spark, tmp_root):
    bad = tmp_root / "x.csv"
    bad.write_text("a\n")
    with pytest.raises(ValueError):
        logs.read_logs(spark, str(bad))
    with pytest.raises(ValueError):
        logs.read_log_dir(spark, str(tmp_root), extensions=("csv",))


def test_catalog_names():
    assert catalog.get_source("local") is logs.read_logs
    assert catalog.get_source("localdir.source") is logs.read_log_dir
    assert catalog.get_sink("es") is sinks.write_partitioned
    with pytest.raises(ValueError):
        catalog.get_source("nosuch")
    with pytest.raises(ValueError):
        catalog.get_sink("nosuch.sink")


def test_strip_prefix_formatter(spark):
    df = spark.createDataFrame([("[a] [b] c d",), ("no prefix",), ("x] y",)], "message string")
    out = logs.apply_formatter(df, "strip_prefix").collect()
    assert [r["message"] for r in out] == ["[b", "no prefix", "y"]
    assert [r["orig_message"] for r in out] == ["[a] [b] c d", None, "x] y"]
    with pytest.raises(ValueError):
        logs.apply_formatter(df, "nope")


def test_window_read_crosses_midnight_and_prunes(spark, tmp_root):
    rows = [(i, dt.datetime(2024, 1, 1, 23, 50) + dt.timedelta(minutes=i), f"m{i}") for i in range(30)]
    df = logs.with_date_partition(spark.createDataFrame(rows, "id int, ts timestamp, message string"))
    path = str(tmp_root / "index")
    sinks.write_partitioned(df, path, mode="overwrite")
    table = spark.read.parquet(path)
    as_of = dt.datetime(2024, 1, 2, 0, 10)
    got = logs.window_read(table, as_of, 15 * 60, tie_cols=("id",))
    ids = [r["id"] for r in got.collect()]
    assert ids == list(range(20, 4, -1))          # 23:55 .. 00:10 inclusive, newest first
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2024.01.01" in plan and "2024.01.02" in plan
    capped = logs.window_read(table, as_of, 15 * 60, max_rows=3, tie_cols=("id",))
    assert [r["id"] for r in capped.collect()] == [20, 19, 18]
    with pytest.raises(ValueError):
        logs.read_window(table, "neither", as_of)


def test_text_query_wildcards(spark):
    df = spark.createDataFrame([("ecommerce order",), ("ECOMMERCE",), ("other",)], "m string")
    assert df.where(logs.text_query("m", "ecomm*")).count() == 2


def test_json_sink_round_trip(spark, tmp_root, log_tree):
    df = logs.read_common_log(spark, os.path.join(log_tree, "orders-500.log")).select("message", "template")
    out = str(tmp_root / "sink.json")
    sinks.write_json(df, out, "w")
    sinks.write_json(df.limit(2), out, "a")
    back = spark.read.json(out)
    assert back.count() == 514
    with pytest.raises(ValueError):
        sinks.write_json(df, out, "x")


def test_kafka_records_and_links(spark):
    df = spark.createDataFrame([("p1", 1, "a%20b", 0.9), ("p2", 0, "c", 0.1)],
                               "predict_id string, anomaly int, e_message string, anomaly_score double")
    rec = sinks.kafka_records(df).collect()
    assert rec[0]["key"] == "p1" and json.loads(rec[0]["value"])["anomaly"] == 1
    links = sinks.feedback_links(df, "http://h/api").collect()
    assert [r["link"] for r in links] == ["http://h/api?lad_id=p1&is_anomaly=False&message=a%20b"]
    with pytest.raises(ValueError):
        sinks.feedback_links(df, None)
