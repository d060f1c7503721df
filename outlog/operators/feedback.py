"""Human feedback on predictions: validation, unique inserts, false-positive sets, noise.

The feedback store is a table ``(id, predict_id, message, reported_anomaly_status,
created_date, customer_id)``.  Requests arrive as JSON ``{lad_id, is_anomaly, message}``.
Writes are batch upserts that reject duplicates instead of failing a transaction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..functions.text import parse_bool, template

REQUEST_SCHEMA = "lad_id string, is_anomaly string, message string"
FEEDBACK_COLUMNS = ["id", "predict_id", "message", "reported_anomaly_status", "created_date", "customer_id"]


def parse_requests(raw: DataFrame, json_col: str = "request") -> DataFrame:
    """JSON request strings -> columns, keeping which keys were present at all."""
    keys = F.json_object_keys(F.col(json_col))
    parsed = F.from_json(F.col(json_col), REQUEST_SCHEMA)
    return raw.select("*", parsed.alias("__r"), keys.alias("__keys")).select(
        *[F.col(f"`{c}`") for c in raw.columns],
        F.col("__r.lad_id").alias("lad_id"), F.col("__r.is_anomaly").alias("is_anomaly"),
        F.col("__r.message").alias("req_message"),
        F.coalesce(F.array_contains("__keys", "lad_id") & F.array_contains("__keys", "is_anomaly")
                   & F.array_contains("__keys", "message"), F.lit(False)).alias("__has_keys"))


def reject_reason(has_keys: Column, predict_id: Column, is_anomaly: Column, message: Column,
                  customer_id: Column) -> Column:
    """First failing rule, or null when the request is acceptable.

    Missing key -> ``missing_key``; empty id -> ``empty_lad_id``; empty flag ->
    ``empty_is_anomaly``; then the table's NOT NULL and length constraints.
    """
    return (F.when(~has_keys, F.lit("missing_key"))
             .when(predict_id.isNull() | (predict_id == ""), F.lit("empty_lad_id"))
             .when(is_anomaly.isNull() | (is_anomaly == ""), F.lit("empty_is_anomaly"))
             .when(message.isNull(), F.lit("null_message"))
             .when(customer_id.isNull(), F.lit("null_customer_id"))
             .when(F.length(predict_id) > C.FEEDBACK_ID_MAX, F.lit("predict_id_too_long"))
             .when(F.length(customer_id) > C.FEEDBACK_ID_MAX, F.lit("customer_id_too_long"))
             .when(F.length(message) > C.FEEDBACK_MESSAGE_MAX, F.lit("message_too_long")))


def validate(requests: DataFrame, customer_col: str = "customer_id", ts_col: str = "created_date") -> DataFrame:
    """Parsed requests -> feedback rows with ``reject_reason`` (null = accepted)."""
    df = parse_requests(requests)
    reason = reject_reason(F.col("__has_keys"), F.col("lad_id"), F.col("is_anomaly"),
                           F.col("req_message"), F.col(customer_col))
    return df.select(
        F.col("lad_id").alias("predict_id"), F.col("req_message").alias("message"),
        parse_bool(F.col("is_anomaly")).alias("reported_anomaly_status"),
        F.col(ts_col).alias("created_date"), F.col(customer_col).alias("customer_id"),
        reason.alias("reject_reason"))


def upsert(existing: DataFrame | None, batch: DataFrame, order_col: str = "created_date"):
    """Insert accepted rows whose ``predict_id`` is new; return ``(inserted, rejected)``.

    Duplicates inside the batch keep the earliest (ties by message), ids already in the
    table are rejected with ``duplicate_predict_id``.  ``id`` continues after the largest
    existing id in ``(created_date, predict_id)`` order, numbered with block-wise prefix
    sums (no single-task window, nothing collected).
    """
    fresh, rejected = accept(existing, batch, order_col)
    base = existing.agg(F.coalesce(F.max("id"), F.lit(0))).scalar() if existing is not None else F.lit(0)
    numbered = _number_rows(fresh, [order_col, "predict_id"]) \
        .withColumn("id", (base + F.col("__pos")).cast("int")).drop("__pos")
    return numbered.select(*FEEDBACK_COLUMNS), rejected


def accept(existing: DataFrame | None, batch: DataFrame, order_col: str = "created_date"):
    """``(accepted, rejected)``: the rows an insert keeps (one per new ``predict_id``) and
    every rejected row with its reason, before ids are assigned."""
    from ..session import cut_lineage

    fields = [order_col, "message", "reported_anomaly_status", "customer_id"]
    ok = batch.where(F.col("reject_reason").isNull()).withColumn("__k", F.struct(*fields))
    bad = batch.where(F.col("reject_reason").isNotNull())
    # The winner per id is an aggregate (partial aggregation, so an id repeated many times
    # stays cheap): the earliest row, ties by message.  Every other row of the id is
    # rejected; exact copies of the winner are counted and re-emitted as rejects, so no
    # group of copies is ever gathered into one task.
    win = cut_lineage(ok.groupBy("predict_id").agg(F.min("__k").alias("__win")))
    marked = ok.join(win, "predict_id")
    is_win = F.col("__k") == F.col("__win")
    losers = marked.where(~is_win).drop("__k", "__win")
    copies = marked.where(is_win).groupBy("predict_id", "__win").agg(F.count("*").alias("__n"))
    unpack = [F.col(f"__win.{c}").alias(c) for c in fields]
    first = win.select("predict_id", *unpack, F.lit(None).cast("string").alias("reject_reason"))
    extra = (copies.where(F.col("__n") > 1)
                   .select("predict_id", *unpack, F.explode(F.sequence(F.lit(2), F.col("__n"))).alias("__c"))
                   .drop("__c").withColumn("reject_reason", F.lit(None).cast("string")))
    dup_in_batch = losers.unionByName(extra).withColumn("reject_reason", F.lit("duplicate_predict_id"))
    if existing is not None:
        known = existing.select("predict_id").distinct()
        fresh = first.join(known, "predict_id", "left_anti")
        dup_table = first.join(known, "predict_id", "left_semi").withColumn(
            "reject_reason", F.lit("duplicate_predict_id"))
    else:
        fresh, dup_table = first, None
    rejected = bad.unionByName(dup_in_batch)
    if dup_table is not None:
        rejected = rejected.unionByName(dup_table)
    return fresh, rejected


def _number_rows(df: DataFrame, order_cols: list[str]) -> DataFrame:
    """1-based position in ``order_cols`` order, computed without a single-task window."""
    from .prefix import ordered_position
    return ordered_position(df, order_cols, out_col="__pos")


def false_positives(feedback: DataFrame, status: bool = True) -> DataFrame:
    """Distinct messages reported with ``reported_anomaly_status = status``."""
    return (feedback.where(F.col("reported_anomaly_status") == F.lit(status))
                    .select("message").distinct())


def noise_rows(fp_messages: DataFrame, copies: int) -> DataFrame:
    """Each false-positive message repeated ``copies`` times (training noise)."""
    return (fp_messages.select("message", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("copy"))
                       .withColumn("template", template(F.col("message"))))


def noise_sentences(fp_messages: DataFrame, copies: int) -> DataFrame:
    """Noise for the encoder: one sentence per message holding ``copies`` repetitions."""
    return fp_messages.select(F.array_repeat(template(F.col("message")), copies).alias("sentence"))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    return (feedback.groupBy("customer_id", "reported_anomaly_status")
                    .agg(F.count("*").alias("feedback_count")))


def reject_counts(validated: DataFrame) -> DataFrame:
    return (validated.where(F.col("reject_reason").isNotNull())
                     .groupBy("reject_reason").agg(F.count("*").alias("errors")))
