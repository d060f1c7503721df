"""Run metrics derived from predictions (no metrics server: the numbers are a table).

``run_metrics`` rows are ``(inference_batch_id, metric, label, value)``; dashboards and
alert rules read that table.  Counter-style series get a PromQL-like ``rate`` with reset
handling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def batch_metrics(preds: DataFrame, threshold: float, order_cols: list[str]) -> DataFrame:
    """Per batch: lines processed, anomaly count by status, false positives suppressed,
    maximum score, score of the last anomaly in line order, and the threshold in use."""
    key = F.struct(*[F.col(c) for c in order_cols])
    agg = preds.groupBy("inference_batch_id").agg(
        F.count("*").cast("double").alias("loglines_count"),
        F.sum(F.when(F.col("anomaly") == 1, 1).otherwise(0)).cast("double").alias("anomaly_count_1"),
        F.sum(F.when((F.col("anomaly") == 0) & (F.col("suppressed") == 0), 1).otherwise(0)).cast("double").alias("anomaly_count_0"),
        F.sum("suppressed").cast("double").alias("false_positive_count"),
        F.max("anomaly_score").alias("max_score"),
        F.max_by(F.when(F.col("anomaly") == 1, F.col("anomaly_score")),
                 F.when(F.col("anomaly") == 1, key)).alias("last_anomaly_score"),
        F.lit(float(threshold)).alias("threshold"))
    names = ["loglines_count", "anomaly_count_0", "anomaly_count_1", "false_positive_count", "max_score",
             "last_anomaly_score", "threshold"]
    stack = F.expr("stack({}, {})".format(len(names), ", ".join(f"'{n}', `{n}`" for n in names)))
    return agg.select("inference_batch_id", stack.alias("metric", "value"))


def counter_rate(series: DataFrame, key_cols: list[str], ts_col: str, value_col: str,
                 out_col: str = "rate") -> DataFrame:
    """Per-second increase between consecutive samples of a counter; a drop means the
    counter restarted, so the new value itself is the increase.  One sample per
    (series, scrape), so a series is bounded by its time span, not by the event count."""
    w = Window.partitionBy(*key_cols).orderBy(ts_col)
    prev_v = F.lag(value_col).over(w)
    prev_t = F.lag(ts_col).over(w)
    inc = F.when(F.col(value_col) >= prev_v, F.col(value_col) - prev_v).otherwise(F.col(value_col))
    secs = F.unix_seconds(F.col(ts_col).cast("timestamp")) - F.unix_seconds(prev_t.cast("timestamp"))
    return series.withColumn(out_col, F.when(prev_v.isNotNull(), F.try_divide(inc.cast("double"), secs)))


def share(condition: Column) -> Column:
    """Fraction of rows meeting ``condition`` (e.g. the normal share ``anomaly = 0``)."""
    return F.avg(condition.cast("double"))
