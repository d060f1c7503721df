"""Registered queries of the stored feedback table, with their SQL: two inserts, all reject reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import feedback as fb
from ..operators.feedback_store import FeedbackStore
from ..session import read_table, scratch_path

CREATED = ("2024-01-01 00:00:00", "2024-01-02 00:00:00")


def _requests(spark, d, odd: bool) -> DataFrame:
    """Requests on the labelled documents: first on those with even ids, then on all, most with one fault by id."""
    docs = read_table(spark, d, "documents").select("doc_id", "text", "source")
    j = read_table(spark, d, "labels").join(docs, "doc_id")
    kind = F.col("doc_id") % 11 if odd else F.lit(10)
    lad = F.when(kind == 1, "").when(kind == 5, F.lpad(F.col("doc_id").cast("string"), 300, "0")).otherwise(F.col("doc_id").cast("string"))
    flag = F.when(kind == 2, "").when(F.col("quality") == 0, "True").otherwise("false")
    message = F.when(kind == 3, None).when(kind == 7, F.lpad("text", 2001, "x")).otherwise(F.substring("text", 1, 50))
    lad, flag, message = lad.alias("lad_id"), flag.alias("is_anomaly"), message.alias("message")
    body = F.when(kind == 0, F.to_json(F.struct(lad, message))) \
        .otherwise(F.to_json(F.struct(lad, flag, message), {"ignoreNullFields": "false"}))
    customer = F.when(kind == 4, None).when(kind == 6, F.repeat(F.lit("c"), 256)).otherwise(F.col("source"))
    rows = j if odd else j.where(F.col("doc_id") % 2 == 0)
    return rows.select(body.alias("request"), customer.alias("customer_id"), F.lit(CREATED[odd]).cast("timestamp").alias("created_date"))


def _stored(spark, d) -> FeedbackStore:
    store = FeedbackStore(spark, scratch_path(spark, "feedback-store"))
    for batch, odd in (("first", False), ("second", True), ("second", True)):      # the last is a replay
        store.insert(fb.validate(_requests(spark, d, odd)), batch)
    return store


def q_feedback_stored(spark, d):
    """The table after two inserts and a replay, all columns."""
    return _stored(spark, d).read().select("id", "predict_id", F.md5("message").alias("message_md5"), "reported_anomaly_status",
                                           F.date_format("created_date", "yyyy-MM-dd").alias("created"), "customer_id")


def q_feedback_stored_rejects(spark, d):
    """Rejected rows by insert and reason: every reason occurs."""
    return _stored(spark, d).rejects().groupBy("version", "reject_reason").agg(F.count("*").alias("errors"))


def registry() -> dict:
    return {name[2:]: fn for name, fn in globals().items() if name.startswith("q_") and callable(fn)}


def oracles() -> dict[str, str]:
    base = """
WITH j AS (SELECT doc_id, doc_id % 11 AS k, CAST(doc_id AS VARCHAR) AS predict_id, quality = 0 AS st, text, source
           FROM labels JOIN documents USING (doc_id)),
second AS (SELECT *, CASE k WHEN 0 THEN 'missing_key' WHEN 1 THEN 'empty_lad_id' WHEN 2 THEN 'empty_is_anomaly' WHEN 3 THEN 'null_message'
                            WHEN 5 THEN 'predict_id_too_long' WHEN 6 THEN 'customer_id_too_long' WHEN 7 THEN 'message_too_long'
                            ELSE CASE WHEN k = 4 THEN 'null_customer_id' WHEN doc_id % 2 = 0 THEN 'duplicate_predict_id' END END AS reason FROM j),
rows AS (SELECT 1 AS version, predict_id, text, st, '2024-01-01' AS created, source FROM j WHERE doc_id % 2 = 0
         UNION ALL SELECT 2, predict_id, text, st, '2024-01-02', source FROM second WHERE reason IS NULL)"""
    return {
        "feedback_stored": base + """
SELECT CAST(row_number() OVER (ORDER BY version, predict_id) AS INTEGER) AS id, predict_id, md5(substr(text, 1, 50)) AS message_md5,
       st AS reported_anomaly_status, created, source AS customer_id FROM rows""",
        "feedback_stored_rejects": base + """
SELECT 2 AS version, reason AS reject_reason, count(*) AS errors FROM second WHERE reason IS NOT NULL GROUP BY reason""",
    }
