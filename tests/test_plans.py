"""Plan-shape checks: no pair-producing joins, filters reach the scan, broadcasts are gated."""

import __spark_entry__ as E
from outlog.session import broadcast_if_small, cut_lineage

PAIR_JOINS = ("CartesianProduct", "BroadcastNestedLoopJoin")
CHECKED = ["bmu_search", "umatrix", "som_epoch", "predict_lines", "knn", "lof", "increase_8h",
           "frequency_alert", "running_anomaly_count", "similar_vectors", "cooccurrence_counts",
           "flatline_alert", "validation_set", "feedback_upsert"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_pair_producing_joins(spark, sf_small):
    qs = E.queries()
    for name in CHECKED:
        plan = _plan(qs[name](spark, sf_small))
        assert not any(k in plan for k in PAIR_JOINS), name


def test_window_read_pushes_filters_and_prunes_columns(spark, sf_small):
    plan = _plan(E.queries()["window_read"](spark, sf_small))
    assert "PushedFilters: [IsNotNull(ts), IsNotNull(event_type), GreaterThanOrEqual(ts" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan
    assert "TakeOrderedAndProject" in plan


def test_broadcast_is_gated_by_size(spark):
    # switch off the optimizer's own size-based broadcast so only the explicit hint counts
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = spark.range(10).withColumnRenamed("id", "k")
        big = spark.range(1000).withColumnRenamed("id", "k")
        yes = big.join(broadcast_if_small(small, row_bytes=8, max_bytes=1000), "k")
        no = big.join(broadcast_if_small(small, row_bytes=8, max_bytes=10), "k")
        assert "BroadcastHashJoin" in _plan(yes)
        assert "BroadcastHashJoin" not in _plan(no)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_cut_lineage_writes_into_the_checkpoint_folder(spark):
    d = spark.conf.get("spark.checkpoint.dir")
    out = cut_lineage(spark.range(5))
    assert out.count() == 5
    files = out.inputFiles()
    assert files and all(d.rstrip("/").replace("file:", "") in p for p in files)


def test_model_queries_run_the_production_configuration(spark, sf_small, monkeypatch):
    from outlog.config import DetectorConfig
    from outlog.operators import som
    fit, asked = som.fit_som, []

    def one_epoch(df, vec_col, codebook, epochs, *args, **kw):
        asked.append((codebook.rows, codebook.cols, codebook.dim, epochs))
        return fit(df, vec_col, codebook, 1, *args, **kw)

    monkeypatch.setattr(som, "fit_som", one_epoch)
    cfg = DetectorConfig()
    for name in ("flagship", "detector_predictions", "infer_new_lines"):
        assert E.queries()[name](spark, sf_small).count() > 0
        assert asked.pop() == (cfg.map_rows, cfg.map_cols, cfg.vector_length, cfg.epochs) == (24, 24, 25, 105), name
