"""Versioned model store: word vectors, codebook and score baseline as Parquet tables.

A version is written completely first; the ``_current`` pointer table is written last, so
readers never see half a model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.detect import ScoreStats
from ..operators.som import Codebook


class ModelLoadError(Exception):
    pass


class ModelSaveError(Exception):
    pass


def save_model(spark: SparkSession, base: str, version: str, vectors: DataFrame, codebook: Codebook,
               stats: ScoreStats, publish: bool = True) -> None:
    try:
        vectors.select("word", "vector").write.mode("overwrite").parquet(f"{base}/vectors/version={version}")
        (codebook.to_df(spark).withColumn("rows", F.lit(codebook.rows)).withColumn("cols", F.lit(codebook.cols))
         .write.mode("overwrite").parquet(f"{base}/codebook/version={version}"))
        stats.to_df(spark, version).write.mode("overwrite").parquet(f"{base}/stats/version={version}")
        if publish:
            spark.createDataFrame([(version,)], "version string").write.mode("overwrite").parquet(f"{base}/_current")
    except Exception as ex:
        raise ModelSaveError(f"could not save model {version} to {base}: {ex}") from ex


def current_version(spark: SparkSession, base: str) -> str:
    try:
        return spark.read.parquet(f"{base}/_current").first()["version"]
    except Exception as ex:
        raise ModelLoadError(f"no published model under {base}") from ex


def load_model(spark: SparkSession, base: str, version: str | None = None):
    """``(vectors DataFrame, Codebook, ScoreStats)`` of a version (default: the published one)."""
    version = version or current_version(spark, base)
    try:
        vectors = spark.read.parquet(f"{base}/vectors/version={version}")
        cbdf = spark.read.parquet(f"{base}/codebook/version={version}")
        first = cbdf.select("rows", "cols").first()
        codebook = Codebook.from_df(cbdf, int(first["rows"]), int(first["cols"]))
        stats = ScoreStats.from_row(spark.read.parquet(f"{base}/stats/version={version}").first())
    except ModelLoadError:
        raise
    except Exception as ex:
        raise ModelLoadError(f"could not load model {version} from {base}: {ex}") from ex
    return vectors, codebook, stats
