"""Alert rules over predictions or events: frequency, flatline, re-alert suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import config as C
from ..session import cut_lineage
from .timeline import greedy_gap, trailing_count


def alert_text(base_url: str, predict_id: Column, e_message: Column, message: Column) -> Column:
    """Notification body with a one-click "not an anomaly" feedback link."""
    return F.format_string(
        "Anomaly detected - message: %s\nIf this is a false positive, report it: "
        "%s?lad_id=%s&is_anomaly=False&message=%s", message, F.lit(base_url), predict_id, e_message)


def feedback_link(base_url: str, predict_id: Column, e_message: Column) -> Column:
    return F.format_string("%s?lad_id=%s&is_anomaly=False&message=%s", F.lit(base_url), predict_id, e_message)


def _keyed(df: DataFrame, key_cols: list[str] | None):
    if key_cols:
        return df, list(key_cols)
    return df.withColumn("__all", F.lit("all")), ["__all"]


def frequency_alert(events: DataFrame, ts_col: str, id_col: str, predicate: Column | None = None,
                    key_cols: list[str] | None = None, num_events: int = C.FREQUENCY_NUM_EVENTS,
                    timeframe_s: float = C.FREQUENCY_TIMEFRAME_S,
                    realert_s: float | None = C.FREQUENCY_REALERT_S) -> DataFrame:
    """Fire when at least ``num_events`` matching rows of a key fall within ``timeframe``.

    Every matching row whose trailing count reaches the threshold is a candidate; with
    ``realert_s`` only the candidates kept by greedy minimum-gap selection remain.
    """
    m = events.where(predicate) if predicate is not None else events
    m, keys = _keyed(m, key_cols)
    counted = trailing_count(m, ts_col, keys, timeframe_s, id_col, "events_in_timeframe")
    cands = counted.where(F.col("events_in_timeframe") >= num_events)
    if realert_s:
        cands = greedy_gap(cands, ts_col, keys, realert_s, id_col)
    return cands.drop("__all") if "__all" in cands.columns else cands


def flatline_alert(events: DataFrame, ts_col: str, key_cols: list[str] | None = None,
                   predicate: Column | None = None, threshold: int = C.FLATLINE_THRESHOLD,
                   timeframe_s: int = C.FLATLINE_TIMEFRAME_S, start=None, end=None,
                   realert_s: float | None = None) -> DataFrame:
    """Periods of ``timeframe`` in which a key saw fewer than ``threshold`` matching rows.

    The period grid runs from the first to the last period of the data (or ``start`` /
    ``end``) for every key; grid size is keys x periods, set by the time span, not by the
    row count.  Counts per (key, period) are a partial-aggregated ``groupBy``.  With ``realert_s`` only the
    periods kept by greedy minimum-gap selection per key remain.
    """
    m = events.where(predicate) if predicate is not None else events
    m, keys = _keyed(m, key_cols)
    allk, _ = _keyed(events, key_cols)
    sec = F.unix_seconds(F.col(ts_col).cast("timestamp"))
    period = (F.floor(sec / F.lit(timeframe_s)) * F.lit(timeframe_s)).cast("long")
    counts = m.groupBy(*keys, period.alias("__p")).agg(F.count(F.lit(1)).alias("events"))
    lo = F.lit(int(start)) if start is not None else allk.agg(F.min(period)).scalar()
    hi = F.lit(int(end)) if end is not None else allk.agg(F.max(period)).scalar()
    key_tab = allk.select(*keys).distinct()
    grid = key_tab.select(*keys, F.explode(F.sequence(lo, hi, F.lit(timeframe_s).cast("long"))).alias("__p"))
    out = (grid.join(counts, keys + ["__p"], "left")
               .withColumn("events", F.coalesce("events", F.lit(0)))
               .where(F.col("events") < threshold)
               .withColumn("period_start", F.timestamp_seconds("__p")).drop("__p"))
    if realert_s:
        named = cut_lineage(out.withColumn("__id", F.to_json(F.struct(*keys, "period_start"), {"ignoreNullFields": "false"})))
        out = greedy_gap(named, "period_start", keys, realert_s, "__id").drop("__id")
    return out.drop("__all") if "__all" in out.columns else out


def realert(alerts: DataFrame, ts_col: str, id_col: str, key_cols: list[str] | None = None,
            realert_s: float = C.FREQUENCY_REALERT_S) -> DataFrame:
    """Drop alerts that follow a kept alert of the same key by less than ``realert_s``."""
    a, keys = _keyed(alerts, key_cols)
    out = greedy_gap(a, ts_col, keys, realert_s, id_col)
    return out.drop("__all") if "__all" in out.columns else out
