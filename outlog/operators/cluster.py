"""K-means, the elbow curve, standardisation and PCA on Spark ML."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from .som import weighted_moments


def _vec(df: DataFrame, vec_col: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vec_col).cast("array<double>")))


FITS_AT_ONCE = 4     # fits side by side; each keeps its own copy of the vectors in Spark's cache


def _fits(df: DataFrame, vec_col: str, tried: list[tuple[int, int]], measure: str, max_iter: int) -> list[tuple]:
    """(model, training cost) of every (k, seed), several at a time: the short jobs of one fit fill the gaps of another.

    The table is not cached here: KMeans then keeps the vectors with their norms for its iterations itself.
    """
    from pyspark import inheritable_thread_target

    data = _vec(df, vec_col).select("features")

    def fit(k: int, seed: int) -> tuple:
        m = KMeans(k=k, seed=seed, maxIter=max_iter, distanceMeasure=measure, initMode="k-means||",
                   featuresCol="features").fit(data)
        return m, m.summary.trainingCost

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        running = [pool.submit(inheritable_thread_target(df.sparkSession)(fit), k, seed) for k, seed in tried]
        return [r.result() for r in running]


def fit_kmeans(df: DataFrame, vec_col: str, k: int, seeds=(1,), measure: str = "euclidean",
               max_iter: int = 300):
    """Best of several k-means++ (k-means||) restarts by training cost."""
    return min(_fits(df, vec_col, [(k, s) for s in seeds], measure, max_iter), key=lambda f: f[1])


def kmeans_assign(df: DataFrame, vec_col: str, k: int, seeds=(1,), measure: str = "euclidean") -> DataFrame:
    model, _ = fit_kmeans(df, vec_col, k, seeds, measure)
    return model.transform(_vec(df, vec_col)).drop("features")


def cluster_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("prediction").agg(F.count("*").alias("size"))


def elbow(df: DataFrame, vec_col: str, ks=range(1, 10), seeds=(1,)) -> DataFrame:
    """Within-cluster sum of squares for each k (k = 1 is the total scatter)."""
    tried = [(k, s) for k in ks if k > 1 for s in seeds]
    costs: dict[int, float] = {}
    for (k, _), (_, cost) in zip(tried, _fits(df, vec_col, tried, "euclidean", 300), strict=True):
        costs[k] = min(cost, costs.get(k, cost))
    if 1 in ks:
        _, cov = weighted_moments(df, vec_col)
        costs[1] = cov.trace() * df.count()
    return df.sparkSession.createDataFrame([(k, float(costs[k])) for k in ks], "k int, cost double")


def pca_fit(df: DataFrame, vec_col: str, k: int = 2, standardise: bool = True):
    """Standardise (mean 0, unit variance) then PCA; returns (models, projected DataFrame)."""
    data = _vec(df, vec_col)
    col = "features"
    scaler = None
    if standardise:
        scaler = StandardScaler(withMean=True, withStd=True, inputCol="features", outputCol="scaled").fit(data)
        data = scaler.transform(data)
        col = "scaled"
    pca = PCA(k=k, inputCol=col, outputCol="pc").fit(data)
    proj = pca.transform(data).withColumn("pc", vector_to_array("pc")).drop("features", "scaled")
    return (scaler, pca), proj


def explained_variance(pca_model, spark) -> DataFrame:
    ev = pca_model.explainedVariance.toArray().tolist()
    return spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(ev)], "component int, explained_variance double")
