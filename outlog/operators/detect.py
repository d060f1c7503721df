"""Scoring, thresholds, flags, false-positive suppression and the prediction record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import config as C
from ..functions.ids import stable_id
from ..functions.text import percent_encode


@dataclass
class ScoreStats:
    """Baseline of normalised training distances (mean, population std, max raw distance, min)."""

    mean: float
    std: float
    max_dist: float
    min: float

    def threshold(self, factor: float = C.INFER_ANOMALY_THRESHOLD) -> float:
        """``factor * std + mean`` (a factor of 0 means: above the mean)."""
        return factor * self.std + self.mean

    def to_df(self, spark: SparkSession, model_version: str = "v1") -> DataFrame:
        return spark.createDataFrame([(model_version, self.mean, self.std, self.max_dist, self.min)],
                                     "model_version string, mean double, std double, max_dist double, min double")

    @classmethod
    def from_row(cls, r) -> "ScoreStats":
        return cls(float(r["mean"]), float(r["std"]), float(r["max_dist"]), float(r["min"]))


def normalised(dist: Column | str, max_dist: Column | float) -> Column:
    """``dist / max_dist``; a zero maximum (all lines identical) scores 0."""
    d = F.col(dist) if isinstance(dist, str) else dist
    m = max_dist if isinstance(max_dist, Column) else F.lit(float(max_dist))
    return F.coalesce(F.try_divide(d, m), F.lit(0.0))


def score_stats_df(scored: DataFrame, dist_col: str = "dist", weight_col: str | None = None) -> DataFrame:
    """One row ``(max_dist, mean, std, min)`` of the normalised distances.

    With ``weight_col`` each row stands for that many lines (distinct templates carrying
    their counts), which gives the same numbers as scoring every line.  Two
    aggregation passes: the mean, then extremes and squares around the mean; normalising by
    the maximum scales mean, std and min by the same factor.
    """
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    base = scored.select(F.col(dist_col).alias("d"), w.alias("w"))
    mean_d = F.sum(F.col("w") * F.col("d")) / F.sum("w")
    # squares around the mean (a scalar subquery): close distances do not cancel
    gap = F.col("d") - base.agg(mean_d.alias("m")).scalar()
    agg = base.select("d", "w", gap.alias("g")).agg(
        F.max("d").alias("max_dist"), F.min("d").alias("__lo"), mean_d.alias("__m"),
        F.sqrt(F.sum(F.col("w") * F.col("g") * F.col("g")) / F.sum("w")).alias("__s"))
    mean_d, std_d = F.col("__m"), F.col("__s")
    return agg.select("max_dist", normalised(mean_d, F.col("max_dist")).alias("mean"),
                      normalised(std_d, F.col("max_dist")).alias("std"),
                      normalised(F.col("__lo"), F.col("max_dist")).alias("min"))


def score_stats(scored: DataFrame, dist_col: str = "dist", weight_col: str | None = None) -> ScoreStats:
    r = score_stats_df(scored, dist_col, weight_col).first()
    if r is None or r["max_dist"] is None:
        raise ValueError("no scored rows: cannot fit a baseline on an empty window")
    return ScoreStats.from_row(r)


def flag(score: Column | str, threshold: float | Column, strict: bool = True) -> Column:
    """1 when the score is above the threshold (``>``; ``>=`` with ``strict=False``)."""
    s = F.col(score) if isinstance(score, str) else score
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.when(s > t if strict else s >= t, F.lit(1)).otherwise(F.lit(0))


def false_positive_marks(df: DataFrame, fp_messages: DataFrame | None, match_col: str = "message") -> DataFrame:
    """Add ``__fp`` (true when the row's ``match_col`` is a reported false positive).

    The false-positive set is distinct messages; it is broadcast only below a checked
    size, otherwise joined by shuffle.
    """
    if fp_messages is None:
        return df.withColumn("__fp", F.lit(False))
    from ..session import broadcast_if_small, cut_lineage

    fp = cut_lineage(fp_messages.select(F.col("message").alias("__fpm")).distinct().withColumn("__fp", F.lit(True)))
    # a stored message is at most 2,000 characters: budget the broadcast for that width
    fp = broadcast_if_small(fp, row_bytes=C.FEEDBACK_MESSAGE_MAX + 64)
    j = df.join(fp, df[match_col] == fp["__fpm"], "left").drop("__fpm")
    return j.withColumn("__fp", F.coalesce(F.col("__fp"), F.lit(False)))


def predictions(scored_lines: DataFrame, stats: ScoreStats, id_cols: list[str], batch_id: str,
                fp_messages: DataFrame | None = None, dist_col: str = "dist",
                factor: float = C.INFER_ANOMALY_THRESHOLD, model_version: str = "v1",
                elast_alert: int = C.ELAST_ALERT, namespace: str = C.PREDICTOR_NAMESPACE,
                match_col: str = "message") -> DataFrame:
    """The prediction record for every scored line.

    Adds ``predict_id`` (hash of model version, batch and line id, so a replayed batch
    gets the same ids), ``anomaly_score = dist / max_dist``, ``elast_alert``,
    ``inference_batch_id``, ``predictor_namespace``, ``e_message`` (percent-encoded raw
    message), ``suppressed`` and ``anomaly``.  A line over the threshold whose message was
    reported as a false positive is kept with ``suppressed = 1`` and ``anomaly = 0``;
    ``drop_suppressed`` removes such rows as the original output did.  Lines that hold the marks of
    ``false_positive_marks`` already are not marked again.
    """
    thr = stats.threshold(factor)
    df = scored_lines if "__fp" in scored_lines.columns else false_positive_marks(scored_lines, fp_messages, match_col)
    score = normalised(F.col(dist_col), stats.max_dist)
    over = score > F.lit(thr)
    return (df
            .withColumn("predict_id", stable_id(F.lit(model_version), F.lit(batch_id), *id_cols))
            .withColumn("anomaly_score", score)
            .withColumn("elast_alert", F.lit(int(elast_alert)))
            .withColumn("inference_batch_id", F.lit(batch_id))
            .withColumn("predictor_namespace", F.lit(namespace))
            .withColumn("e_message", percent_encode(F.col("message")))
            .withColumn("suppressed", F.when(over & F.col("__fp"), 1).otherwise(0))
            .withColumn("anomaly", F.when(over & ~F.col("__fp"), 1).otherwise(0))
            .drop("__fp"))


def drop_suppressed(preds: DataFrame) -> DataFrame:
    return preds.where(F.col("suppressed") == 0)


def suppressed_rows(preds: DataFrame) -> DataFrame:
    """The side output: over-threshold rows hidden because they were reported as false."""
    return preds.where(F.col("suppressed") == 1)


def last_anomaly_per_message(preds: DataFrame, order_cols: list[str]) -> DataFrame:
    """For each distinct anomalous message, the id and score of its last occurrence."""
    key = F.struct(*[F.col(c) for c in order_cols])
    return (preds.where(F.col("anomaly") == 1)
                 .groupBy("e_message")
                 .agg(F.max_by("predict_id", key).alias("last_predict_id"),
                      F.max_by("anomaly_score", key).alias("last_score"),
                      F.count("*").alias("occurrences")))


def top_scores(preds: DataFrame, n: int, order_cols: list[str]) -> DataFrame:
    """The ``n`` highest scores (ties by the line order): a top-k report."""
    return preds.orderBy(F.col("anomaly_score").desc(), *[F.col(c) for c in order_cols]).limit(n)


def window_rank(order_cols: list[str], partition_cols: list[str]):
    return Window.partitionBy(*partition_cols).orderBy(*[F.col(c) for c in order_cols])
