"""A detector that runs for good: micro-batches in, predictions out, a new model version every few batches.

Everything a run knows lies in tables under one folder, so a restart goes on where the last run stopped:

    checkpoint/            offsets of the stream
    history/batch=N        rows of the batches that a refit may still look back on
    models/version=N       the model fitted in batch N
    predictions/batch=N    scored rows
    runs/batch=N           counters of the batch: trained, model version, rows read, scored, flagged, late

A batch writes each of its folders whole, so a batch that Spark replays after a failure replaces its own rows.
The model version a batch uses follows from its number alone.  Counters are observed while the predictions
are written, without another pass.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from .. import config as C
from ..session import drop_path, scratch_path

RUN = "batch long, model_version long, trained int, as_of timestamp, rows_in long, rows_scored long, anomalies long, rows_late long"


class StreamDetector:
    """``fit(rows) -> model table`` and ``score(rows, model) -> rows with anomaly`` on a stream with ``ts``.

    Batch b refits if ``b % refit_every == 0``, on the rows of this and earlier batches whose ``ts`` lies
    within ``train_span`` seconds before the newest row so far, both ends included.  Every row of a batch is
    scored once; those older than ``late_after`` seconds before that newest row are counted as late.
    A batch without rows writes its counters and nothing else, and keeps the model.
    """

    def __init__(self, root: str, fit: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame, DataFrame], DataFrame],
                 refit_every: int = C.INFER_LOOPS, train_span: float = C.TRAIN_TIME_SPAN, late_after: float = C.INFER_TIME_SPAN):
        self.root, self.fit, self.score = root.rstrip("/"), fit, score
        self.refit_every, self.train_span, self.late_after = refit_every, train_span, late_after

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """One of the run's tables, with the batch or version as a column."""
        path = f"{self.root}/{name}"
        return spark.read.option("basePath", path).parquet(f"{path}/*=*")

    def _exists(self, spark: SparkSession, name: str) -> bool:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)

    def _runs(self, spark: SparkSession, batch_id: int) -> list:
        """Earlier batches that a look-back may need: their numbers and newest rows (one row per batch)."""
        if not self._exists(spark, "runs"):
            return []
        rows = self.table(spark, "runs").where((F.col("batch") < batch_id) & F.col("as_of").isNotNull())
        return rows.select("batch", "as_of", "model_version", "rows_in").collect()

    def handle(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        read = Observation("read")
        here = f"{self.root}/history/batch={batch_id}"
        batch.observe(read, F.count(F.lit(1)).alias("n"), F.max("ts").alias("newest")).write.mode("overwrite").parquet(here)
        n, newest = read.get["n"], read.get["newest"]
        runs = self._runs(spark, batch_id)
        version = max((r["model_version"] for r in runs if r["model_version"] is not None), default=None)
        before = max((r["as_of"] for r in runs), default=None)
        if not n:
            self._count(spark, batch_id, version, 0, before, 0, 0, 0, 0)
            return
        as_of = max(newest, before) if before else newest
        rows = spark.read.parquet(here)
        since = as_of - timedelta(seconds=self.train_span)
        old = [r["batch"] for r in runs if r["as_of"] >= since and r["rows_in"]]
        trained = int(version is None or batch_id % self.refit_every == 0)
        if trained:
            version = batch_id
            for k in old:
                rows = rows.unionByName(spark.read.parquet(f"{self.root}/history/batch={k}"))
            self.fit(rows.where(F.col("ts") >= F.lit(since).cast(rows.schema["ts"].dataType))) \
                .write.mode("overwrite").parquet(f"{self.root}/models/version={version}")
        done = Observation("scored")
        late = F.col("ts") < F.lit(as_of - timedelta(seconds=self.late_after)).cast(batch.schema["ts"].dataType)
        scored = self.score(spark.read.parquet(here), spark.read.parquet(f"{self.root}/models/version={version}"))
        scored.observe(done, F.count(F.lit(1)).alias("n"), F.sum("anomaly").alias("a"), F.sum(late.cast("long")).alias("late")) \
            .withColumn("model_version", F.lit(version).cast("long")) \
            .write.mode("overwrite").parquet(f"{self.root}/predictions/batch={batch_id}")
        got = done.get
        self._count(spark, batch_id, version, trained, as_of, n, got["n"], got["a"] or 0, got["late"] or 0)
        for r in runs:      # history no refit can look back on any more
            if r["as_of"] < since and r["rows_in"]:
                drop_path(spark, f"{self.root}/history/batch={r['batch']}")

    def _count(self, spark: SparkSession, batch_id: int, version: int | None, trained: int, as_of: datetime | None, *rows: int) -> None:
        spark.createDataFrame([(batch_id, version, trained, as_of, *rows)], RUN).drop("batch").coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.root}/runs/batch={batch_id}")

    def run(self, stream: DataFrame, available_now: bool = True, every: str = "60 seconds"):
        """Start the stream and, if ``available_now``, wait until all there is has been worked off."""
        w = stream.writeStream.option("checkpointLocation", f"{self.root}/checkpoint") \
            .foreachBatch(lambda df, i: self.handle(df, i))
        q = (w.trigger(availableNow=True) if available_now else w.trigger(processingTime=every)).start()
        if available_now:
            q.awaitTermination()
        return q


def counters(runs: DataFrame) -> DataFrame:
    """Totals over all batches: trainings, inferences, rows read and scored, anomalies, normals, late rows."""
    return runs.agg(F.sum("trained").alias("trainings"), F.sum((F.col("rows_scored") > 0).cast("long")).alias("inferences"),
                    F.sum("rows_in").alias("rows_in"), F.sum("rows_scored").alias("rows_scored"), F.sum("anomalies").alias("anomalies"),
                    F.sum(F.col("rows_scored") - F.col("anomalies")).alias("normals"), F.sum("rows_late").alias("rows_late"))


# ---- how rare a key is: a detector by frequency ---------------------------------------------------------

def fit_frequency(key: str, factor: float):
    """Keys with their counts in the window; the threshold is mean + factor * std of -ln(share) over its rows."""
    def fit(rows: DataFrame) -> DataFrame:
        n = rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
        total = n.agg(F.sum("n").alias("total"))
        s = n.crossJoin(F.broadcast(total)).withColumn("s", -F.log(F.col("n") / F.col("total")))     # one row
        mean = F.sum(F.col("n") * F.col("s")) / F.max("total")
        square = F.sum(F.col("n") * F.col("s") * F.col("s")) / F.max("total")
        limit = s.agg((mean + factor * F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))).alias("threshold"))
        return s.crossJoin(F.broadcast(limit)).select("key", "s", "total", "threshold")
    return fit


def score_frequency(key: str):
    """-ln of a key's share in the model's window; a key it does not hold counts as one row more."""
    def score(rows: DataFrame, model: DataFrame) -> DataFrame:
        unseen = model.agg(F.max("total").alias("all"), F.max("threshold").alias("limit"))
        told = rows.join(model.select(F.col("key").alias(key), "s"), key, "left").crossJoin(F.broadcast(unseen))
        x = F.coalesce("s", F.log(F.col("all") + 1.0))
        return told.withColumn("score", x).withColumn("anomaly", (x > F.col("limit")).cast("int")).drop("s", "all", "limit")
    return score


# ---- registered queries ---------------------------------------------------------------------------------

SLICES, SPAN = 12, 5 * 86400


def _run_in_slices(spark, sf_dir: str) -> StreamDetector:
    """Events as a stream of twelve files, equal parts of their time, through two runs of one detector."""
    from ..session import read_table

    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    lo, hi = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    step = (hi - lo) // SLICES + 1
    inbox = scratch_path(spark, "inbox")
    det = StreamDetector(scratch_path(spark, "stream-detector"), fit_frequency("user_id", 1.0), score_frequency("user_id"), train_span=SPAN,
                         late_after=86400)
    part = events.withColumn("slice", F.floor((F.unix_micros("ts") - lo) / step))
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1) \
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(inbox)
    for k in range(SLICES):
        part.where(F.col("slice") == k).drop("slice").coalesce(1).write.mode("append").parquet(inbox)
        if k in (4, SLICES - 1):        # the second run resumes from the tables of the first
            det.run(stream())
    return det


def q_stream_detector(spark, d):
    """Every event with the score of the model version of its batch."""
    p = _run_in_slices(spark, d).table(spark, "predictions")
    return p.select("event_id", F.col("batch").cast("int").alias("batch"), F.col("model_version").cast("int").alias("model_version"),
                    F.round("score", 6).alias("score"), "anomaly")


def q_stream_run_counters(spark, d):
    """Counters of every batch: what a scrape of the running job would read."""
    runs = _run_in_slices(spark, d).table(spark, "runs")
    return runs.select(F.col("batch").cast("int").alias("batch"), F.col("model_version").cast("int").alias("model_version"), "trained",
                       "rows_in", "rows_scored", "anomalies", "rows_late")


def q_stream_run_totals(spark, d):
    return counters(_run_in_slices(spark, d).table(spark, "runs"))


def registry() -> dict:
    return {name[2:]: fn for name, fn in globals().items() if name.startswith("q_") and callable(fn)}


def oracles() -> dict[str, str]:
    base = f"""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events),
b AS (SELECT e.*, CAST((t - lo) // ((hi - lo) // {SLICES} + 1) AS INTEGER) AS batch FROM e, (SELECT min(t) AS lo, max(t) AS hi FROM e) m),
v AS (SELECT batch, max(t) AS as_of, CASE WHEN batch >= 10 THEN 10 ELSE 0 END AS version FROM b GROUP BY batch),
win AS (SELECT v.batch AS version, user_id FROM b JOIN v ON v.batch IN (0, 10) AND b.batch <= v.batch AND t >= as_of - {SPAN * 1_000_000}),
n AS (SELECT version, user_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY version) AS total FROM win GROUP BY 1, 2),
s AS (SELECT *, -ln(n / total) AS s FROM n),
thr AS (SELECT version, any_value(total) AS total,
               sum(n * s) / any_value(total) + sqrt(greatest(sum(n * s * s) / any_value(total) - power(sum(n * s) / any_value(total), 2), 0)) AS thr
        FROM s GROUP BY version),
p AS (SELECT event_id, batch, version, t, as_of, coalesce(s, ln(thr.total + 1)) AS score, CAST(coalesce(s, ln(thr.total + 1)) > thr AS INTEGER) AS anomaly
      FROM b JOIN v USING (batch) JOIN thr USING (version) LEFT JOIN s USING (version, user_id)),
r AS (SELECT batch, any_value(version) AS model_version, CAST(batch IN (0, 10) AS INTEGER) AS trained, count(*) AS rows_in, count(*) AS rows_scored,
             CAST(sum(anomaly) AS BIGINT) AS anomalies, count(*) FILTER (WHERE t < as_of - 86400000000) AS rows_late FROM p GROUP BY batch)"""
    return {
        "stream_detector": base + " SELECT event_id, batch, version AS model_version, round(score, 6) AS score, anomaly FROM p",
        "stream_run_counters": base + " SELECT * FROM r",
        "stream_run_totals": base + """
SELECT CAST(sum(trained) AS BIGINT) AS trainings, count(*) FILTER (WHERE rows_scored > 0) AS inferences, CAST(sum(rows_in) AS BIGINT) AS rows_in,
       CAST(sum(rows_scored) AS BIGINT) AS rows_scored, CAST(sum(anomalies) AS BIGINT) AS anomalies,
       CAST(sum(rows_scored - anomalies) AS BIGINT) AS normals, CAST(sum(rows_late) AS BIGINT) AS rows_late FROM r""",
    }
