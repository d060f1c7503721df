import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from outlog.config import DetectorConfig
from outlog.operators import detect, feedback as fb
from outlog.plans.pipeline import SomDetector
from tests import fixtures


def test_threshold_and_flag_semantics(spark):
    st = detect.ScoreStats(mean=0.2, std=0.1, max_dist=2.0, min=0.0)
    assert abs(st.threshold(3.1) - 0.51) < 1e-12 and st.threshold(0) == 0.2
    df = spark.createDataFrame([(0.2,), (0.21,)], "s double")
    assert [r[0] for r in df.select(detect.flag("s", 0.2)).collect()] == [0, 1]
    assert [r[0] for r in df.select(detect.flag("s", 0.2, strict=False)).collect()] == [1, 1]


def test_zero_max_distance_scores_zero(spark):
    df = spark.createDataFrame([(0.0,), (0.0,)], "dist double")
    st = detect.score_stats(df, "dist")
    assert st.max_dist == 0.0 and st.mean == 0.0 and st.std == 0.0
    assert df.select(detect.normalised("dist", 0.0)).first()[0] == 0.0


def test_weighted_stats_equal_line_stats(spark):
    rng = np.random.default_rng(2)
    d = rng.random(50)
    n = rng.integers(1, 6, 50)
    w = spark.createDataFrame([(float(a), int(b)) for a, b in zip(d, n)], "dist double, n long")
    lines = spark.createDataFrame([(float(a),) for a, b in zip(d, n) for _ in range(b)], "dist double")
    a, b = detect.score_stats(w, "dist", "n"), detect.score_stats(lines, "dist")
    x = np.repeat(d, n) / d.max()
    for s in (a, b):
        assert abs(s.mean - x.mean()) < 1e-12 and abs(s.std - x.std()) < 1e-12 and s.max_dist == d.max()


def test_suppression_keeps_rows(spark):
    rows = [(1, "known false", 1.0), (2, "real", 1.0), (3, "known false", 0.0)]
    df = spark.createDataFrame(rows, "id long, message string, dist double")
    fp = spark.createDataFrame([("known false",)], "message string")
    st = detect.ScoreStats(0.1, 0.1, 1.0, 0.0)
    p = {r["id"]: r for r in detect.predictions(df, st, ["id"], "b", fp).collect()}
    assert (p[1]["anomaly"], p[1]["suppressed"]) == (0, 1)
    assert (p[2]["anomaly"], p[2]["suppressed"]) == (1, 0)
    assert (p[3]["anomaly"], p[3]["suppressed"]) == (0, 0)
    again = {r["id"]: r["predict_id"] for r in detect.predictions(df, st, ["id"], "b", fp).collect()}
    assert again == {k: v["predict_id"] for k, v in p.items()}       # ids are stable across reruns


def _requests(spark, bodies):
    rows = [(b if isinstance(b, str) else json.dumps(b), "c1", "2024-01-01 00:00:00") for b in bodies]
    return spark.createDataFrame(rows, "request string, customer_id string, created_date string") \
        .withColumn("created_date", F.col("created_date").cast("timestamp"))


def test_feedback_validation_and_upsert(spark):
    ok = [{"lad_id": "a", "is_anomaly": "True", "message": "m1"},
          {"lad_id": "b", "is_anomaly": "True", "message": "m2"},
          {"lad_id": "c", "is_anomaly": "False", "message": "m3"}]
    bad = [{"lad_id": "d", "message": "x"},                                  # missing key
           {"lad_id": "e", "is_anomaly": "", "message": "x"},                # empty flag
           {"lad_id": "", "is_anomaly": "True", "message": "x"},             # empty id
           {"lad_id": "f", "is_anomaly": "True", "message": "y" * 2001},     # too long
           {"lad_id": "a", "is_anomaly": "False", "message": "z-dup"}]       # duplicate id (same time: ties by message)
    v = fb.validate(_requests(spark, ok + bad))
    reasons = {r["predict_id"]: r["reject_reason"] for r in v.collect()}
    assert reasons["d"] == "missing_key" and reasons["e"] == "empty_is_anomaly"
    assert reasons[""] == "empty_lad_id" and reasons["f"] == "message_too_long"
    ins, rej = fb.upsert(None, v)
    got = {r["predict_id"]: r["id"] for r in ins.collect()}
    assert set(got) == {"a", "b", "c"} and sorted(got.values()) == [1, 2, 3]
    assert rej.where(F.col("reject_reason") == "duplicate_predict_id").count() == 1
    # second batch against the table: existing ids are rejected, new ids continue numbering
    v2 = fb.validate(_requests(spark, [{"lad_id": "b", "is_anomaly": "True", "message": "again"},
                                       {"lad_id": "z", "is_anomaly": "True", "message": "m9"}]))
    ins2, rej2 = fb.upsert(ins, v2)
    assert [(r["predict_id"], r["id"]) for r in ins2.collect()] == [("z", 4)]
    assert [r["predict_id"] for r in rej2.collect()] == ["b"]
    # false positives are the messages reported with status True
    assert sorted(r["message"] for r in fb.false_positives(ins).collect()) == ["m1", "m2"]
    counts = {(r["customer_id"], r["reported_anomaly_status"]): r["feedback_count"]
              for r in fb.feedback_counts(ins).collect()}
    assert counts == {("c1", True): 2, ("c1", False): 1}


def test_noise_rows_repeat(spark):
    fp = spark.createDataFrame([("a b 1",), ("c",)], "message string")
    assert fb.noise_rows(fp, 5).count() == 10


def test_more_noise_lowers_the_score(spark):
    """A reported false positive fed back as training noise scores lower the more copies it gets."""
    msgs = fixtures.false_positive_events()
    base = spark.createDataFrame([(i, 0, m) for i, m in enumerate(msgs)], "doc_id long, line_no int, message string")
    from outlog.functions.text import template
    lines = base.withColumn("template", template("message")).withColumn("source", F.lit("s"))
    noise = spark.createDataFrame([("root CMD usr local bin monitor apache stats sh dev null",)], "message string")
    scores = []
    for copies in (1, 10000):
        cfg = DetectorConfig(map_rows=2, map_cols=2, epochs=5, som_init="pca", vector_length=8)
        det = SomDetector(cfg=cfg, encoder="hash").fit(lines, noise=noise, noise_copies=copies)
        p = det.predict(lines, ["doc_id", "line_no"], "b").where(F.col("message").startswith("root CMD"))
        scores.append(p.first()["anomaly_score"])
    assert scores[0] > scores[1]


def test_infer_retrains_on_unseen_templates(spark):
    from outlog.functions.text import template
    train = spark.createDataFrame([(i, 0, "alpha beta", "s") for i in range(20)] + [(99, 0, "gamma", "s")],
                                  "doc_id long, line_no int, message string, source string") \
        .withColumn("template", template("message"))
    new = spark.createDataFrame([(200, 0, "delta epsilon", "s"), (201, 0, "alpha beta", "s")],
                                "doc_id long, line_no int, message string, source string") \
        .withColumn("template", template("message"))
    cfg = DetectorConfig(map_rows=1, map_cols=2, epochs=2, som_init="random", vector_length=4)
    det = SomDetector(cfg=cfg, encoder="hash").fit(train)
    before = det.vocab_size
    p = det.infer(new, ["doc_id", "line_no"], "b", train)
    assert det.vocab_size == before + 1 and p.count() == 2
    first = SomDetector(cfg=cfg, encoder="hash").fit(train).predict(new, ["doc_id", "line_no"], "b")
    assert det.model_version == "v1.1" and not {r.predict_id for r in p.collect()} & {r.predict_id for r in first.collect()}


def test_scores_meet_lines_without_templates_or_messages_being_moved(spark):
    from outlog.operators import encoder as enc
    from outlog.sources.logs import document_lines
    docs = spark.createDataFrame([(1, "s", "alpha 1\nbeta\n\nalpha 2\n77"), (2, "t", "gamma\nbeta 3\n8"), (3, "t", ""), (4, "t", None)],
                                 "doc_id long, source string, text string")
    lines, sentences = document_lines(docs), enc.document_sentences(docs)
    cfg = DetectorConfig(map_rows=2, map_cols=2, epochs=2, som_init="frequent", vector_length=4, threshold_factor=0.0)
    fp = spark.createDataFrame([("gamma",), ("beta",), ("gamma",)], "message string")
    dets = [SomDetector(cfg=cfg).fit(lines, sentences, whole=w) for w in (False, True)]
    preds = [d.predict(lines, ["doc_id", "line_no"], "b", fp, training=True) for d in dets]
    rows = [sorted(map(tuple, p.collect())) for p in preds]
    assert rows[0] == rows[1] and len(rows[0]) == lines.count() and preds[0].columns == preds[1].columns
    assert {r[3] for r in map(tuple, preds[1].where("suppressed = 1").select("doc_id", "line_no", "template", "message").collect())} <= {"gamma", "beta"}
    assert preds[1].where("suppressed = 1").count() > 0
    counts = {r.word: r.n for r in enc.counted_vectors(sentences, 4).collect()}
    assert counts == {"alpha": 2, "beta": 2, "gamma": 1, "": 2}
    plan = preds[1].select("doc_id", "anomaly")._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join LeftOuter, (__key"):]
    moved = join.splitlines()[1]
    assert "message" not in moved.split("[", 1)[1].split(" AS ")[0] and "template" not in moved.split("[", 1)[1].split(" AS ")[0]
