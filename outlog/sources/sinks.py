"""Sinks for predictions: JSON files, daily-partitioned tables, feedback links, Kafka records."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.alerts import feedback_link
from .logs import with_date_partition

WRITE_MODES = {"w": "overwrite", "a": "append", "overwrite": "overwrite", "append": "append"}


def write_json(df: DataFrame, path: str, mode: str = "w") -> None:
    """JSON lines, one record per row; ``w`` replaces, ``a`` appends (no concatenated arrays)."""
    if mode not in WRITE_MODES:
        raise ValueError(f"unknown write mode {mode!r}")
    df.write.mode(WRITE_MODES[mode]).json(path)


def log_view(df: DataFrame) -> DataFrame:
    """What the log sink prints when no output path is set: flag and score per row."""
    return df.select("anomaly", "anomaly_score")


def feedback_links(df: DataFrame, base_url: str | None) -> DataFrame:
    """A feedback URL for every anomalous row (a base URL is required)."""
    if not base_url:
        raise ValueError("a feedback URL is required for the link sink")
    return df.where(F.col("anomaly") == 1).select(
        "predict_id", feedback_link(base_url, F.col("predict_id"), F.col("e_message")).alias("link"))


def write_partitioned(df: DataFrame, path: str, ts_col: str = "ts", mode: str = "append") -> None:
    """Append into a table partitioned by day (``dt = yyyy.MM.dd``), one folder per day."""
    out = df if "dt" in df.columns else with_date_partition(df, ts_col)
    out.write.mode(mode).partitionBy("dt").parquet(path)


def kafka_records(df: DataFrame, key_col: str = "predict_id") -> DataFrame:
    """One Kafka record per prediction: key = id, value = the row as JSON."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    return df.select(F.col(key_col).cast("string").alias("key"), F.to_json(F.struct(*cols)).alias("value"))


def write_kafka(df: DataFrame, servers: str, topic: str, options: dict | None = None) -> None:
    """Publish prediction records through Spark's Kafka sink (needs the connector on the
    classpath; TLS settings go in ``options`` as ``kafka.*`` keys)."""
    w = kafka_records(df).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)
    for k, v in (options or {}).items():
        w = w.option(k, v)
    try:
        w.save()
    except Exception as ex:  # the connector is a deployment choice
        if "kafka" in str(ex).lower() and ("not find" in str(ex).lower() or "failed to find" in str(ex).lower()):
            raise RuntimeError("Spark's Kafka connector is not on the classpath") from ex
        raise


def write_validation_set(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.select(*[c for c in df.columns]).write.mode(mode).parquet(path)
