"""Log readers: common-log text, JSON arrays, directories, tables and bounded time windows.

Every reader returns one DataFrame that keeps the raw record and its cleaned ``template``
side by side (no positional pairing of two collections), plus ``source`` for lineage.
"""

from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import config as C
from ..functions.text import (common_log_message, common_log_token, fill_empty, strip_prefix,
                              template)
from ..operators.flatten import flatten

LOG_EXTENSIONS = ("log", "json")


def _with_template(df: DataFrame, message_col: str = "message") -> DataFrame:
    return df.withColumn("template", template(fill_empty(F.col(message_col))))


def read_common_log(spark: SparkSession, path: str, recursive: bool = False,
                    glob: str | None = None) -> DataFrame:
    """Common-log text: ``[ts] [LEVEL] message...`` -> value, ts, severity, message, template, source.

    The message is every token after the first two (single-space split), as in the
    original reader; ``ts`` and ``severity`` are parsed as additions.
    """
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(path).select("value", F.col("_metadata.file_path").alias("source"))
    df = raw.select(
        "value",
        F.try_to_timestamp(common_log_token("value", 1)).alias("ts"),
        common_log_token("value", 2).alias("severity"),
        common_log_message("value").alias("message"),
        "source",
    )
    return _with_template(df)


def read_json_logs(spark: SparkSession, path: str, multiline: bool = True, schema=None,
                   recursive: bool = False, glob: str | None = None) -> DataFrame:
    """A JSON array of objects (``multiline``) or JSON lines, flattened to dotted columns."""
    reader = spark.read.option("multiLine", str(multiline).lower())
    if schema is not None:
        reader = reader.schema(schema)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.json(path)
    df = df.select("*", F.col("_metadata.file_path").alias("source")) if "source" not in df.columns else df
    flat = flatten(df)
    if "message" not in flat.columns:
        raise ValueError(f"JSON records at {path} have no 'message' key")
    return _with_template(flat)


def read_log_dir(spark: SparkSession, root: str, extensions=LOG_EXTENSIONS) -> DataFrame:
    """Every ``*.log`` (common-log) and ``*.json`` (JSON array) file below ``root``.

    One scan per format over the whole tree; the results are unioned by name so a JSON
    file's extra keys become nullable columns.
    """
    parts = []
    for ext in extensions:
        if ext not in LOG_EXTENSIONS:
            raise ValueError(f"unsupported log file extension: {ext!r}")
        if not _has_files(root, ext):
            continue
        if ext == "log":
            parts.append(read_common_log(spark, root, recursive=True, glob="*.log"))
        else:
            parts.append(read_json_logs(spark, root, recursive=True, glob="*.json"))
    if not parts:
        raise ValueError(f"no log files below {root}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _has_files(root: str, ext: str) -> bool:
    if "://" in root:         # remote stores: let the scan decide
        return True
    for _, _, files in os.walk(root):
        if any(f.endswith("." + ext) for f in files):
            return True
    return False


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Dispatch by path: directory -> tree scan, ``*.json`` -> JSON, ``*.log``/``*.txt`` -> text."""
    if os.path.isdir(path):
        return read_log_dir(spark, path)
    if path.endswith("json"):
        return read_json_logs(spark, path)
    if path.endswith(".log") or path.endswith(".txt"):
        return read_common_log(spark, path)
    raise ValueError(f"unsupported log file: {path}")


# ---- the driver's tables seen as logs ----------------------------------------------------

def document_lines(documents: DataFrame) -> DataFrame:
    """One row per non-empty line of each document.

    ``log_id = (doc_id, line_no)``; ``line_no`` counts non-empty lines from 0.  Lines are
    split inside the row, so this is a narrow transformation (no shuffle) over whole texts.
    """
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: x != F.lit(""))
    return (documents
            .select("doc_id", "source", F.posexplode(lines).alias("line_no", "message"))
            .withColumn("template", template(F.col("message"))))


def conversation_lines(conversations: DataFrame) -> DataFrame:
    """Conversation turns as ordered logs: one row per non-empty line of each turn."""
    lines = F.filter(F.split(F.col("text"), "\n", -1), lambda x: x != F.lit(""))
    return (conversations
            .select("conv_id", "turn", "role", F.posexplode(lines).alias("line_no", "message"))
            .withColumn("template", template(F.col("message"))))


def events_as_common_log(events: DataFrame) -> DataFrame:
    """Render ``events`` as common-log text lines ``[ts] [TYPE] user <id> props <json>``."""
    ts = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    line = F.format_string("[%s] [%s] user %d props %s", ts, F.upper("event_type"),
                           F.col("user_id"), F.col("props"))
    return events.select("event_id", line.alias("value"))


def parse_common_log_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """Parse already-loaded common-log lines (the text reader's parser, on a column)."""
    return (lines
            .withColumn("ts", F.try_to_timestamp(common_log_token(value_col, 1)))
            .withColumn("severity", common_log_token(value_col, 2))
            .withColumn("message", common_log_message(value_col))
            .withColumn("template", template(F.col("message"))))


def apply_formatter(df: DataFrame, formatter: str | None, message_col: str = "message") -> DataFrame:
    """Named log formatters; ``strip_prefix`` keeps the original in ``orig_message``."""
    if not formatter:
        return df
    if formatter == "strip_prefix":
        has = F.size(F.split(F.col(message_col), r"\] ", -1)) > 1
        return (df.withColumn("orig_message", F.when(has, F.col(message_col)))
                  .withColumn(message_col, strip_prefix(message_col)))
    raise ValueError(f"unknown log formatter {formatter!r}")


# ---- bounded time-window reads ---------------------------------------------------------

def with_date_partition(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Add ``dt = yyyy.MM.dd`` (the daily index suffix) for partitioned writes and pruning."""
    return df.withColumn("dt", F.date_format(F.col(ts_col).cast("timestamp"), "yyyy.MM.dd"))


def dates_between(start: _dt.datetime, end: _dt.datetime) -> list[str]:
    d, out = start.date(), []
    while d <= end.date():
        out.append(d.strftime("%Y.%m.%d"))
        d += _dt.timedelta(days=1)
    return out


def text_query(col: str | Column, query: str) -> Column:
    """Free-text term with ``*`` wildcards, matched case-insensitively anywhere in the text."""
    c = F.col(col) if isinstance(col, str) else col
    pattern = query.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_").replace("*", "%")
    return c.ilike(f"%{pattern}%")


def window_read(df: DataFrame, as_of, span_s: float, max_rows: int | None = None,
                predicate: Column | None = None, ts_col: str = "ts",
                tie_cols: tuple = ()) -> DataFrame:
    """Rows with ``as_of - span <= ts <= as_of`` (both ends inclusive), newest first, capped.

    ``as_of`` is a parameter, so a read is reproducible.  When the table carries a ``dt``
    partition column, a filter on every date in the window is added so partition pruning
    reads all of them (a window that crosses midnight loses nothing).  The cap is the
    reader's size limit; it is applied after a global newest-first sort (top-k).
    """
    if isinstance(as_of, str):
        as_of = _dt.datetime.fromisoformat(as_of)
    start = as_of - _dt.timedelta(seconds=span_s)
    ts = F.col(ts_col).cast("timestamp")
    out = df.where(ts.between(F.lit(start), F.lit(as_of)))
    if "dt" in df.columns:
        out = out.where(F.col("dt").isin(dates_between(start, as_of)))
    if predicate is not None:
        out = out.where(predicate)
    order = [F.col(ts_col).desc()] + [F.col(c) for c in tie_cols]
    out = out.orderBy(*order)
    if max_rows is not None:
        out = out.limit(max_rows)
    return out


def read_window(df: DataFrame, mode: str, as_of, predicate: Column | None = None,
                ts_col: str = "ts", tie_cols: tuple = (), max_rows: int | None = None) -> DataFrame:
    """The train / infer read: picks the span by mode; anything else is an error.

    All rows of the span are read; a cap (``TRAIN_MAX_ENTRIES``, ``INFER_MAX_ENTRIES``) is the
    caller's choice through ``max_rows``.
    """
    if mode == "train":
        span = C.TRAIN_TIME_SPAN
    elif mode == "infer":
        span = C.INFER_TIME_SPAN
    else:
        raise ValueError(f"unknown read mode {mode!r}")
    return window_read(df, as_of, span, max_rows, predicate, ts_col, tie_cols)
