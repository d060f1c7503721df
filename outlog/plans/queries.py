"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over the given tables.

Doubles are rounded to 6 places in outputs that are compared with a SQL engine, because
sums taken in a different order differ in the last bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import config as C
from ..config import DetectorConfig
from ..functions.ids import seeded_int
from ..functions.text import percent_encode, strip_prefix, to_str, fill_empty
from ..functions.vectors import as_double_array
from ..operators import alerts, detect, encoder as enc, feedback as fb, som, timeline
from ..operators.flatten import flatten_json_column
from ..operators.prefix import running_sum
from ..session import read_table
from ..sources.logs import (conversation_lines, document_lines, events_as_common_log,
                            parse_common_log_lines, text_query, window_read, with_date_partition)
from .pipeline import SomDetector

R = 6
SAMPLE_SEED = 7
MAP_ROWS, MAP_COLS = 4, 4
HASH_DIM = 8
LINE_DIM = 8               # vector length of the map behind the prediction queries
AS_OF = "2024-01-15 12:00:00"
BATCH_ID = "batch-0"
LINK_BASE = "http://localhost:5001/api/feedback"


def _r(c, name):
    return F.round(c, R).alias(name)


# ---- inputs ---------------------------------------------------------------------------------

def lines_df(spark, d):
    return document_lines(read_table(spark, d, "documents"))


def events_df(spark, d):
    return read_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def emb_df(spark, d):
    return read_table(spark, d, "embeddings").select("vec_id", "label", as_double_array("embedding").alias("v"))


def sample_codebook(spark, d) -> som.Codebook:
    return som.init_sample(emb_df(spark, d), "v", ["vec_id"], MAP_ROWS, MAP_COLS, SAMPLE_SEED)


# ---- 1. clean and scan ---------------------------------------------------------------------

def q_log_lines(spark, d):
    return lines_df(spark, d).select("doc_id", "line_no", "source", "message", "template")


def q_template_counts(spark, d):
    return lines_df(spark, d).groupBy("template").agg(F.count("*").alias("n"))


def q_common_log_parse(spark, d):
    lines = events_as_common_log(events_df(spark, d))
    return parse_common_log_lines(lines).select("event_id", "ts", "severity", "message", "template")


def q_strip_prefix(spark, d):
    lines = events_as_common_log(events_df(spark, d))
    has = F.size(F.split("value", r"\] ", -1)) > 1
    return lines.select("event_id", strip_prefix("value").alias("message"),
                        F.when(has, F.col("value")).alias("orig_message"))


def q_json_flatten(spark, d):
    ev = events_df(spark, d).select("event_id", "event_type", "props")
    return flatten_json_column(ev, "props", "k int", sep="_")


def q_to_str_fill(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = read_table(spark, d, "labels")
    j = docs.join(lab, "doc_id", "left")
    return j.select("doc_id", *[fill_empty(to_str(c)).alias(f"{c}_s") for c in ["lang", "n_chars", "quality", "toxic"]])


def q_percent_encode(spark, d):
    return lines_df(spark, d).select("doc_id", "line_no", percent_encode("message").alias("e_message"))


def q_window_read(spark, d):
    ev = events_df(spark, d)
    return window_read(ev, AS_OF, 3 * 86400, 300, text_query("event_type", "err*"),
                       tie_cols=("event_id",)).select("event_id", "ts", "user_id", "event_type")


def q_date_partition_counts(spark, d):
    return with_date_partition(events_df(spark, d)).groupBy("dt").agg(F.count("*").alias("n"))


# ---- 2. score and flag against a map ---------------------------------------------------------

def _bmu(spark, d, metric="euclidean"):
    cb = sample_codebook(spark, d)
    return som.bmu_search(emb_df(spark, d), "v", cb, metric=metric, keep_vector=False), cb


def q_bmu_search(spark, d):
    s, _ = _bmu(spark, d)
    return s.select("vec_id", "bmu", _r(F.col("dist"), "dist"))


def q_score_stats(spark, d):
    s, _ = _bmu(spark, d)
    st = detect.score_stats_df(s, "dist")
    return st.select(*[_r(F.col(c), c) for c in ["max_dist", "mean", "std", "min"]])


def q_threshold_flag(spark, d):
    s, _ = _bmu(spark, d)
    st = detect.score_stats(s, "dist")
    thr = st.threshold(C.INFER_ANOMALY_THRESHOLD)
    score = detect.normalised("dist", st.max_dist)
    return s.select("vec_id", _r(score, "anomaly_score"), detect.flag(score, thr).alias("anomaly"))


def q_cosine_bmu(spark, d):
    s, _ = _bmu(spark, d, "cosine")
    return s.select("vec_id", "bmu", _r(F.col("dist"), "cos_dist"))


def q_umatrix(spark, d):
    cb = sample_codebook(spark, d)
    u = som.umatrix(cb.to_df(spark))
    return u.select("node", "gx", "gy", _r(F.col("umatrix"), "umatrix"), "neighbours")


def q_bmu_hits(spark, d):
    s, _ = _bmu(spark, d)
    return som.bmu_hits(s)


def q_distance_histogram(spark, d):
    s, _ = _bmu(spark, d)
    lo = s.agg(F.min("dist")).scalar()
    hi = s.agg(F.max("dist")).scalar()
    width = (hi - lo) / F.lit(10.0)
    b = F.least(F.floor(F.coalesce(F.try_divide(F.col("dist") - lo, width), F.lit(0.0))) + 1, F.lit(10))
    return s.groupBy(b.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def q_som_epoch(spark, d):
    cb = sample_codebook(spark, d)
    new, _ = som.som_epoch(emb_df(spark, d), "v", cb, sigma=None)
    df = new.to_df(spark)
    return df.select("node", F.posexplode("w").alias("dim", "w")).select("node", "dim", _r(F.col("w"), "w"))


def q_som_fit_exp(spark, d):
    """Two batch-SOM epochs with the fixed ``exp(-d/2)`` kernel from the sampled map."""
    fitted, _ = som.fit_som(emb_df(spark, d), "v", sample_codebook(spark, d), epochs=2, kernel="exp")
    df = fitted.to_df(spark)
    return df.select("node", F.posexplode("w").alias("dim", "w")).select("node", "dim", _r(F.col("w"), "w"))


def q_som_fit(spark, d):
    emb = emb_df(spark, d)
    cb = som.init_pca(emb, "v", MAP_ROWS, MAP_COLS)
    fitted, _ = som.fit_som(emb, "v", cb, epochs=5)
    scored = som.bmu_search(emb, "v", fitted, keep_vector=False)
    return som.bmu_hits(scored)


# ---- 4. encoder ------------------------------------------------------------------------------

def q_cooccurrence_counts(spark, d):
    sents = enc.document_sentences(read_table(spark, d, "documents"))
    return enc.cooccurrence_counts(sents, C.W2V_WINDOW)


def q_vocabulary(spark, d):
    return enc.vocabulary(lines_df(spark, d), "template", min_count=2)


def q_new_words(spark, d):
    known = enc.vocabulary(conversation_lines(read_table(spark, d, "conversations")), "template", 1)
    return enc.new_words(lines_df(spark, d), known)


def q_oov_hash_vectors(spark, d):
    words = conversation_lines(read_table(spark, d, "conversations")).select(F.col("template").alias("word")).distinct()
    hv = enc.hash_vectors(words, HASH_DIM, C.W2V_SEED)
    return hv.select("word", F.posexplode("vector").alias("i", "x")).select("word", "i", _r(F.col("x"), "x"))


def label_centroids(emb: DataFrame) -> DataFrame:
    per_dim = (emb.select("label", F.posexplode("v").alias("i", "x"))
                  .groupBy("label", "i").agg(F.avg("x").alias("x")))
    return (per_dim.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s"))
                   .select("label", F.transform("s", lambda e: e["x"]).alias("v")))


def q_similar_vectors(spark, d):
    emb = emb_df(spark, d)
    cents = label_centroids(emb)
    out = enc.similar_words(cents, emb, k=3, probe_col="label", probe_vec="v", id_col="vec_id",
                            vec_col="v", exclude_self=False)
    return out.select(F.col("probe").alias("label"), F.col("neighbour").alias("vec_id"),
                      _r(F.col("similarity"), "similarity"), "rank")


# ---- 5. feedback -----------------------------------------------------------------------------

def feedback_requests(spark, d):
    """Feedback requests as they would arrive: one JSON body per labelled document."""
    docs = read_table(spark, d, "documents")
    lab = read_table(spark, d, "labels")
    j = lab.join(docs, "doc_id")
    body = F.to_json(F.struct(F.col("doc_id").cast("string").alias("lad_id"),
                              F.when(F.col("quality") == 0, "True").otherwise("False").alias("is_anomaly"),
                              F.col("text").alias("message")))
    return j.select(body.alias("request"), F.col("source").alias("customer_id"),
                    F.lit(AS_OF).cast("timestamp").alias("created_date"))


def _validated(spark, d):
    return fb.validate(feedback_requests(spark, d))


def q_feedback_validate(spark, d):
    v = _validated(spark, d)
    return v.select("predict_id", "reported_anomaly_status", "customer_id", "reject_reason",
                    F.length("message").alias("message_length"))


def _inserted(spark, d):
    ins, _ = fb.upsert(None, _validated(spark, d))
    return ins


def _accepted(spark, d):
    """The feedback rows the insert keeps (the table's content apart from the ``id``)."""
    acc, _ = fb.accept(None, _validated(spark, d))
    return acc


def q_feedback_upsert(spark, d):
    return _inserted(spark, d).select("id", "predict_id", "reported_anomaly_status", "customer_id",
                                      F.length("message").alias("message_length"))


def q_false_positives(spark, d):
    return fb.false_positives(_accepted(spark, d)).select(F.md5("message").alias("message_md5"),
                                                          F.length("message").alias("message_length"))


def q_noise_union(spark, d):
    fp = fb.false_positives(_accepted(spark, d))
    lines = lines_df(spark, d).select("message", "template")
    u = lines.unionByName(fb.noise_rows(fp, 3).select("message", "template"))
    return u.groupBy("template").agg(F.count("*").alias("n"))


def q_feedback_counts(spark, d):
    return fb.feedback_counts(_accepted(spark, d))


def q_reject_counts(spark, d):
    return fb.reject_counts(_validated(spark, d))


# ---- 6. predictions (co-occurrence encoder + fitted map; every step expressible in SQL) ------

def line_model(lines: DataFrame, documents: DataFrame):
    """The detector behind the prediction queries: co-occurrence vectors and a map fitted for
    two Gaussian epochs from the most frequent templates."""
    cfg = DetectorConfig(vector_length=LINE_DIM, map_rows=MAP_ROWS, map_cols=MAP_COLS, epochs=2, som_init="frequent")
    return SomDetector(cfg=cfg).fit(lines, enc.document_sentences(documents), whole=True)


def line_predictions(spark, d, with_fp=True):
    lines = lines_df(spark, d)
    det = line_model(lines, read_table(spark, d, "documents"))
    fp = fb.false_positives(_accepted(spark, d)) if with_fp else None
    return det.predict(lines, ["doc_id", "line_no"], BATCH_ID, fp, training=True), det.stats


def q_predict_lines(spark, d):
    p, _ = line_predictions(spark, d)
    return p.select("doc_id", "line_no", "predict_id", _r(F.col("anomaly_score"), "anomaly_score"),
                    "elast_alert", "inference_batch_id", "predictor_namespace", "e_message",
                    "suppressed", "anomaly")


def q_feedback_links(spark, d):
    p, _ = line_predictions(spark, d)
    return p.where(F.col("anomaly") == 1).select(
        "doc_id", "line_no", alerts.feedback_link(LINK_BASE, F.col("predict_id"), F.col("e_message")).alias("link"))


def q_last_anomaly_per_message(spark, d):
    p, _ = line_predictions(spark, d)
    out = detect.last_anomaly_per_message(p, ["doc_id", "line_no"])
    return out.select("e_message", "last_predict_id", _r(F.col("last_score"), "last_score"), "occurrences")


def q_running_anomaly_count(spark, d):
    p, _ = line_predictions(spark, d)
    keys = p.select("inference_batch_id", "doc_id", "line_no", "anomaly")
    out = running_sum(keys, "anomaly", ["doc_id", "line_no"], ["inference_batch_id"], "running_anomalies")
    return out.select("doc_id", "line_no", "running_anomalies")


def q_anomaly_counts(spark, d):
    p, _ = line_predictions(spark, d)
    return p.groupBy("inference_batch_id").agg(
        F.count("*").alias("lines"), F.sum("anomaly").alias("anomalies"),
        F.sum(1 - F.col("anomaly") - F.col("suppressed")).alias("normals"),
        F.sum("suppressed").alias("suppressed"), _r(F.max("anomaly_score"), "max_score"))


def q_normal_share_by_source(spark, d):
    p, st = line_predictions(spark, d)
    thr = st.threshold()
    return p.groupBy("source").agg(
        _r(F.avg((F.col("anomaly") == 0).cast("double")), "normal_share"),
        _r(F.avg("anomaly_score"), "avg_score"), _r(F.lit(thr), "threshold"))


HIST_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]


def q_anomaly_histogram(spark, d):
    """Cumulative histogram of the running anomaly count observed after every line."""
    p, _ = line_predictions(spark, d)
    keys = p.select("inference_batch_id", "doc_id", "line_no", "anomaly")
    runs = running_sum(keys, "anomaly", ["doc_id", "line_no"], ["inference_batch_id"], "running")
    bounds = F.array(*[F.lit(b) for b in HIST_BOUNDS] + [F.lit(float("inf"))])
    per = runs.select(F.explode(bounds).alias("le"), "running")
    return per.groupBy("le").agg(F.sum((F.col("running") <= F.col("le")).cast("long")).alias("count"))


def q_confusion_matrix(spark, d):
    p, _ = line_predictions(spark, d, with_fp=False)
    doc = p.groupBy("doc_id").agg(F.max("anomaly").alias("predicted"))
    lab = read_table(spark, d, "labels").select("doc_id", (F.col("quality") == 0).cast("int").alias("actual"))
    j = doc.join(lab, "doc_id")
    tp = F.sum(((F.col("predicted") == 1) & (F.col("actual") == 1)).cast("long"))
    fp_ = F.sum(((F.col("predicted") == 1) & (F.col("actual") == 0)).cast("long"))
    fn = F.sum(((F.col("predicted") == 0) & (F.col("actual") == 1)).cast("long"))
    tn = F.sum(((F.col("predicted") == 0) & (F.col("actual") == 0)).cast("long"))
    out = j.agg(tp.alias("tp"), fp_.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    return out.select("tp", "fp", "fn", "tn",
                      _r(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), "precision"),
                      _r(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), "recall"))


def q_prediction_metrics(spark, d):
    from ..operators.metrics import batch_metrics
    p, st = line_predictions(spark, d)
    m = batch_metrics(p, st.threshold(), ["doc_id", "line_no"])
    return m.select("inference_batch_id", "metric", _r(F.col("value"), "value"))


# ---- 7. metrics and alerts on events ---------------------------------------------------------

def q_counter_rate_1m(spark, d):
    """A per-minute event counter per type, read back as a per-second rate between samples."""
    from ..operators.metrics import counter_rate
    ev = events_df(spark, d)
    per_min = ev.groupBy("event_type", F.window("ts", "1 minute").start.alias("minute")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("event_type").orderBy("minute").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    series = per_min.withColumn("total", F.sum("n").over(w)).drop("n")
    return counter_rate(series, ["event_type"], "minute", "total").select(
        "event_type", "minute", "total", _r(F.col("rate"), "rate"))



def _rate(spark, d, minutes):
    ev = events_df(spark, d)
    w = F.window("ts", f"{minutes} minutes")
    return (ev.groupBy("event_type", w.alias("w")).agg(F.count("*").alias("n"))
              .select("event_type", F.col("w.start").alias("window_start"), "n",
                      _r(F.col("n") / F.lit(60.0 * minutes), "rate")))


def q_rate_1m(spark, d):
    return _rate(spark, d, 1)


def q_rate_5m(spark, d):
    return _rate(spark, d, 5)


def q_increase_8h(spark, d):
    ev = events_df(spark, d)
    out = timeline.trailing_count(ev, "ts", ["event_type"], 8 * 3600, "event_id", "increase_8h")
    return out.select("event_id", "event_type", "increase_8h")


def q_frequency_alert(spark, d):
    ev = events_df(spark, d)
    out = alerts.frequency_alert(ev, "ts", "event_id", F.col("event_type") == "error", None,
                                 C.FREQUENCY_NUM_EVENTS, C.FREQUENCY_TIMEFRAME_S, C.FREQUENCY_REALERT_S)
    return out.select("event_id", "ts", "events_in_timeframe")


def q_frequency_alert_by_user(spark, d):
    ev = events_df(spark, d)
    out = alerts.frequency_alert(ev, "ts", "event_id", F.col("event_type") == "error", ["user_id"],
                                 2, 86400, 86400)
    return out.select("user_id", "event_id", "ts", "events_in_timeframe")


def q_flatline_alert(spark, d):
    ev = events_df(spark, d)
    out = alerts.flatline_alert(ev, "ts", ["event_type"], None, C.FLATLINE_THRESHOLD, C.FLATLINE_TIMEFRAME_S)
    return out.select("event_type", "period_start", "events")


def q_flatline_realert(spark, d):
    """Quiet quarters of an hour, alerted again an hour after the last alert of the type at the earliest."""
    ev = events_df(spark, d)
    out = alerts.flatline_alert(ev, "ts", ["event_type"], None, C.FLATLINE_THRESHOLD, 900, realert_s=C.FLATLINE_REALERT_S)
    return out.select("event_type", "period_start", "events")


def q_realert_suppression(spark, d):
    ev = events_df(spark, d).where(F.col("event_type") == "error")
    out = alerts.realert(ev, "ts", "event_id", ["user_id"], 86400)
    return out.select("user_id", "event_id", "ts")


# ---- 9. evaluation data ----------------------------------------------------------------------

def split_80_20(spark, d):
    from ..operators.evaluate import split_by_position
    return split_by_position(lines_df(spark, d), "source", ["doc_id", "line_no"], C.VALIDATION_TRAIN_SHARE)


def q_split_80_20(spark, d):
    return split_80_20(spark, d).select("doc_id", "line_no", "source", "position", "is_test")


def q_validation_labels(spark, d):
    s = split_80_20(spark, d)
    gate = seeded_int(C.VALIDATION_SEED, 1, 100, F.lit("gate"), "doc_id", "line_no")
    label = F.when((F.col("is_test") == 1) & (gate >= C.VALIDATION_GATE), 1).otherwise(0)
    return s.select("doc_id", "line_no", label.alias("label"))


def q_validation_set(spark, d):
    from ..operators.evaluate import validation_set
    return validation_set(lines_df(spark, d), "source", ["doc_id", "line_no"])


# ---- 8. other detectors ----------------------------------------------------------------------

def q_knn(spark, d):
    from ..operators.outliers import knn
    out = knn(emb_df(spark, d), "vec_id", "v", 5, block_rows=256)
    return out.select(F.col("id").alias("vec_id"), F.col("nbr").alias("neighbour"), "rank", _r(F.col("dist"), "dist"))


def q_lof(spark, d):
    from ..operators.outliers import lof
    out = lof(emb_df(spark, d), "vec_id", "v", 20, block_rows=256)
    return out.select("vec_id", _r(F.col("lof"), "lof"), "label")


def q_knn_300(spark, d):
    """``knn`` with as many neighbours as the default local outlier factor asks for."""
    from ..operators.outliers import knn
    out = knn(emb_df(spark, d), "vec_id", "v", 300)
    return out.select(F.col("id").alias("vec_id"), F.col("nbr").alias("neighbour"), "rank", _r(F.col("dist"), "dist"))


def q_lof_300(spark, d):
    """``lof`` over 300 neighbours."""
    from ..operators.outliers import lof
    out = lof(emb_df(spark, d), "vec_id", "v", 300)
    return out.select("vec_id", _r(F.col("lof"), "lof"), "label")


def registry() -> dict:
    return {name[2:]: fn for name, fn in globals().items() if name.startswith("q_") and callable(fn)}
