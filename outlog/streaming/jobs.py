"""Structured Streaming jobs: windowed rates, frequency windows, micro-batch prediction,
stateful re-alert suppression and flatline gaps.

Offsets and state live in checkpoints under the shared work folder, so a restarted query
resumes where it stopped, and a replayed micro-batch rewrites exactly its own output
(prediction ids are hashes of the batch id and the line id).
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState

from .. import config as C
from ..session import read_table, scratch_path

WATERMARK = "30 minutes"


def table_stream(spark: SparkSession, sf_dir: str, table: str, max_files: int | None = None) -> DataFrame:
    """A file stream over one table, a file or a folder of files (schema taken from the batch reader)."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    # a pattern of this one name: a plain path may only be a folder, a pattern meets a file or a folder
    return r.parquet(f"{sf_dir}/{table}.parque[t]")


def run_to_table(stream: DataFrame, name: str, mode: str = "append", partition_by: list[str] | None = None,
                 available_now: bool = True, processing_time: str | None = None) -> DataFrame:
    """Run a stream into a Parquet table under the work folder and read the table back."""
    spark = stream.sparkSession
    out, ck = scratch_path(spark, name), scratch_path(spark, name + "-ck")
    w = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", ck)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "60 seconds")
    q = w.start()
    q.awaitTermination()
    return spark.read.parquet(out)


def run_foreach_batch(stream: DataFrame, name: str, handler: Callable[[DataFrame, int, str], None]) -> str:
    """Run ``handler(batch_df, batch_id, out_path)`` for every micro-batch (available-now)."""
    spark = stream.sparkSession
    out, ck = scratch_path(spark, name), scratch_path(spark, name + "-ck")
    q = (stream.writeStream.option("checkpointLocation", ck)
               .foreachBatch(lambda df, bid: handler(df, bid, out)).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


# ---- windowed rates and frequency windows ---------------------------------------------------

def stream_rate(events: DataFrame, minutes: int, watermark: str = WATERMARK) -> DataFrame:
    ev = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    agg = ev.groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return agg.select("event_type", F.col("w.start").alias("window_start"), "n",
                      F.round(F.col("n") / F.lit(60.0 * minutes), 6).alias("rate"))


def stream_frequency_windows(events: DataFrame, predicate, num_events: int = C.FREQUENCY_NUM_EVENTS,
                             timeframe_s: int = C.FREQUENCY_TIMEFRAME_S, slide_s: int = 60,
                             watermark: str = WATERMARK) -> DataFrame:
    """Sliding windows of ``timeframe`` holding at least ``num_events`` matching rows.

    The predicate is pushed below the watermark, so the watermark follows the matching
    rows' event time; a window is emitted once it ends before that watermark.
    """
    ev = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark).where(predicate)
    agg = ev.groupBy(F.window("ts", f"{timeframe_s} seconds", f"{slide_s} seconds").alias("w")).agg(F.count("*").alias("n"))
    return agg.where(F.col("n") >= num_events).select(F.col("w.start").alias("window_start"),
                                                      F.col("w.end").alias("window_end"), "n")


# ---- stateful operators ---------------------------------------------------------------------

REALERT_STATE = T.StructType([T.StructField("last_us", T.LongType())])
REALERT_OUT = "user_id long, event_id long, ts timestamp"


def _realert_fn(gap_us: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(pdfs)).sort_values(["__us", "event_id"])
        ts = pdf["__us"].to_numpy()
        last = state.get[0] if state.exists else None
        i = 0 if last is None else int(np.searchsorted(ts, last + gap_us, side="left"))
        keep = []
        while i < len(ts):
            keep.append(i)
            last = int(ts[i])
            i = int(np.searchsorted(ts, last + gap_us, side="left"))
        if last is not None:
            state.update((last,))
        out = pdf.iloc[keep]
        yield pd.DataFrame({"user_id": out["user_id"].to_numpy(), "event_id": out["event_id"].to_numpy(),
                            "ts": out["ts"].to_numpy()})
    return fn


def stream_realert(events: DataFrame, predicate, key: str = "user_id", gap_s: int = 86400) -> DataFrame:
    """Greedy re-alert suppression with the last kept time per key in streaming state."""
    ev = (events.where(predicate).withColumn("ts", F.col("ts").cast("timestamp"))
                .select(key, "event_id", "ts", F.unix_micros("ts").alias("__us")))
    return ev.groupBy(key).applyInPandasWithState(
        _realert_fn(int(gap_s * 1_000_000)), REALERT_OUT, REALERT_STATE, "append", "NoTimeout")


FLAT_STATE = T.StructType([T.StructField("last_us", T.LongType())])
FLAT_OUT = "event_type string, last_seen timestamp, next_seen timestamp, silent_s double"


def _times(pdfs: Iterator[pd.DataFrame], state: GroupState) -> np.ndarray:
    """Event times of a batch in order, from the last one seen before it on.

    Only the times are kept of the frames.  Rows older than the stored time are late: the
    silence they fall in was judged with what had come in by then, so they end no silence
    and never move the stored time back.
    """
    us = np.sort(np.concatenate([p["__us"].to_numpy() for p in pdfs]))
    if state.exists:
        last = state.get[0]
        us = np.concatenate([[last], us[us > last]]).astype(np.int64)
    return us


def _flatline_fn(gap_us: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        us = _times(pdfs, state)
        prev, nxt = us[:-1], us[1:]
        hit = (nxt - prev) >= gap_us
        state.update((int(us[-1]),))
        yield pd.DataFrame({"event_type": [key[0]] * int(hit.sum()),
                            "last_seen": pd.to_datetime(prev[hit], unit="us"),
                            "next_seen": pd.to_datetime(nxt[hit], unit="us"),
                            "silent_s": (nxt[hit] - prev[hit]) / 1e6})
    return fn


def stream_flatline(events: DataFrame, key: str = "event_type", timeframe_s: int = C.FLATLINE_TIMEFRAME_S) -> DataFrame:
    """Silences of at least ``timeframe`` between consecutive events of a key (state: last seen)."""
    ev = events.select(key, F.unix_micros(F.col("ts").cast("timestamp")).alias("__us"))
    return ev.groupBy(key).applyInPandasWithState(
        _flatline_fn(int(timeframe_s * 1_000_000)), FLAT_OUT, FLAT_STATE, "append", "NoTimeout")


def _silence_timer_fn(gap_us: int):
    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            # the watermark passed last_seen + timeframe: the key has gone quiet
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"event_type": [key[0]], "last_seen": pd.to_datetime([last], unit="us"),
                                "next_seen": pd.to_datetime([None]), "silent_s": [None]})
            return
        us = _times(pdfs, state)
        prev, nxt = us[:-1], us[1:]
        hit = (nxt - prev) >= gap_us
        last = int(us[-1])
        state.update((last,))
        state.setTimeoutTimestamp((last + gap_us) // 1000)
        yield pd.DataFrame({"event_type": [key[0]] * int(hit.sum()),
                            "last_seen": pd.to_datetime(prev[hit], unit="us"),
                            "next_seen": pd.to_datetime(nxt[hit], unit="us"),
                            "silent_s": (nxt[hit] - prev[hit]) / 1e6})
    return fn


def stream_flatline_timer(events: DataFrame, key: str = "event_type", timeframe_s: int = C.FLATLINE_TIMEFRAME_S,
                          watermark: str = WATERMARK) -> DataFrame:
    """Flatline with an event-time timer: gaps between events as in ``stream_flatline``, plus
    one alert (``next_seen`` null) when the watermark passes ``last_seen + timeframe``
    while the key stays silent."""
    ev = (events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
                .select(key, "ts", F.unix_micros("ts").alias("__us")))
    return ev.groupBy(key).applyInPandasWithState(
        _silence_timer_fn(int(timeframe_s * 1_000_000)), FLAT_OUT, FLAT_STATE, "append", "EventTimeTimeout")


# ---- micro-batch prediction -------------------------------------------------------------------

class StreamPredictor:
    """Scores every micro-batch of documents against a model snapshot (K1), refitting
    every ``retrain_every`` batches (K2); the feedback table is re-read per batch."""

    def __init__(self, fit: Callable[[], tuple], feedback: Callable[[], DataFrame | None] | None = None,
                 retrain_every: int = 0, factor: float = C.INFER_ANOMALY_THRESHOLD):
        self.fit = fit
        self.feedback = feedback
        self.retrain_every = retrain_every
        self.factor = factor
        self.model = fit()

    def handle(self, batch: DataFrame, batch_id: int, out: str) -> None:
        from ..operators import detect, encoder, som
        from ..sources.logs import document_lines

        if self.retrain_every and batch_id and batch_id % self.retrain_every == 0:
            self.model = self.fit()
        codebook, stats, vectors, dim, seed = self.model
        lines = document_lines(batch)
        # templates the model has not met get a seeded vector
        counts = encoder.encode(lines.groupBy("template").count(), vectors, "template", "vector", dim, "hash", seed)
        from ..session import broadcast_if_small, cut_lineage
        scored = cut_lineage(som.bmu_search(counts, "vector", codebook, keep_vector=False)
                             .select("template", "bmu", "dist"))
        sl = lines.join(broadcast_if_small(scored), "template")
        fp = self.feedback() if self.feedback else None
        p = detect.predictions(sl, stats, ["doc_id", "line_no"], f"batch-{batch_id}", fp, factor=self.factor)
        p.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        # run metrics of this batch (what a scrape would read), rewritten on replay
        from ..operators.metrics import batch_metrics
        written = p.sparkSession.read.parquet(f"{out}/batch_id={batch_id}")
        batch_metrics(written, stats.threshold(self.factor), ["doc_id", "line_no"]) \
            .write.mode("overwrite").parquet(f"{out}_metrics/batch_id={batch_id}")


# ---- registered queries -------------------------------------------------------------------

def q_stream_rate_1m(spark, d):
    return run_to_table(stream_rate(table_stream(spark, d, "events"), 1), "stream-rate")


def q_stream_frequency_windows(spark, d):
    s = stream_frequency_windows(table_stream(spark, d, "events"), F.col("event_type") == "error")
    return run_to_table(s, "stream-freq")


def q_stream_realert(spark, d):
    s = stream_realert(table_stream(spark, d, "events"), F.col("event_type") == "error", "user_id", 86400)
    return run_to_table(s, "stream-realert")


def q_stream_flatline(spark, d):
    return run_to_table(stream_flatline(table_stream(spark, d, "events")), "stream-flat") \
        .select("event_type", "last_seen", "next_seen", F.round("silent_s", 6).alias("silent_s"))


def q_stream_flatline_timer(spark, d):
    return run_to_table(stream_flatline_timer(table_stream(spark, d, "events")), "stream-flat-timer") \
        .select("event_type", "last_seen", "next_seen", F.round("silent_s", 6).alias("silent_s"))


def q_stream_predict(spark, d):
    from ..plans import queries as Q
    from ..operators import feedback as fb

    def fit():
        det = Q.line_model(Q.lines_df(spark, d), read_table(spark, d, "documents"))
        return det.codebook, det.stats, det.vectors, Q.LINE_DIM, C.W2V_SEED

    def feedback():
        return fb.false_positives(Q._accepted(spark, d))

    sp = StreamPredictor(fit, feedback, retrain_every=C.INFER_LOOPS)
    out = run_foreach_batch(table_stream(spark, d, "documents"), "stream-predict", sp.handle)
    p = spark.read.option("basePath", out).parquet(f"{out}/batch_id=*")
    return p.select("doc_id", "line_no", "predict_id", F.round("anomaly_score", 6).alias("anomaly_score"),
                    "elast_alert", "inference_batch_id", "predictor_namespace", "e_message", "suppressed", "anomaly")


def registry() -> dict:
    return {name[2:]: fn for name, fn in globals().items() if name.startswith("q_") and callable(fn)}


def oracles() -> dict:
    from ..plans.oracles import oracles as base

    b = base()
    closed = "(SELECT max(ts) FROM events) - INTERVAL 30 MINUTES"
    return {
        "stream_rate_1m": f"""
SELECT event_type, time_bucket(INTERVAL '1 minutes', ts) AS window_start, count(*) AS n, round(count(*) / 60.0, 6) AS rate
FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL '1 minutes', ts) + INTERVAL 1 MINUTE <= {closed}""",
        "stream_frequency_windows": f"""
WITH w AS (SELECT time_bucket(INTERVAL '1 minutes', ts) - INTERVAL (k) MINUTE AS window_start
           FROM events, range(0, 2) r(k) WHERE event_type = 'error')
SELECT window_start, window_start + INTERVAL 2 MINUTE AS window_end, count(*) AS n FROM w
GROUP BY window_start
HAVING count(*) >= 1
   AND window_start + INTERVAL 2 MINUTE <= (SELECT max(ts) FROM events WHERE event_type = 'error') - INTERVAL 30 MINUTES""",
        "stream_realert": b["realert_suppression"],
        "stream_flatline": """
SELECT event_type, ts AS last_seen, nx AS next_seen, round(epoch(nx) - epoch(ts), 6) AS silent_s FROM (
  SELECT event_type, ts, lead(ts) OVER (PARTITION BY event_type ORDER BY ts) AS nx FROM events) t
WHERE nx IS NOT NULL AND epoch(nx) - epoch(ts) >= 3600""",
        "stream_flatline_timer": """
SELECT event_type, ts AS last_seen, nx AS next_seen, round(epoch(nx) - epoch(ts), 6) AS silent_s FROM (
  SELECT event_type, ts, lead(ts) OVER (PARTITION BY event_type ORDER BY ts) AS nx FROM events) t
WHERE nx IS NOT NULL AND epoch(nx) - epoch(ts) >= 3600
UNION ALL
SELECT event_type, max(ts) AS last_seen, CAST(NULL AS TIMESTAMP) AS next_seen, CAST(NULL AS DOUBLE) AS silent_s
FROM events GROUP BY event_type
HAVING epoch_ms(max(ts)) + 3600000 < (SELECT epoch_ms(max(ts)) FROM events) - 1800000""",
        "stream_predict": b["predict_lines"],
    }
