"""Registered model queries: fits (Word2Vec, SOM, k-means, PCA) whose outputs are checked
by invariants in the tests rather than by a SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DetectorConfig, W2V_PARTITIONS
from ..operators import cluster, encoder as enc, outliers, som
from ..session import read_table
from ..sources.logs import conversation_lines, document_lines
from .pipeline import SomDetector, flagship
from .queries import R, emb_df

SEEDS = (1, 2, 3)
ELBOW_SEEDS = tuple(range(1, 11))      # the restarts of every point of the curve, as by default there


def _r(c, name):
    return F.round(c, R).alias(name)


def _w2v(spark, d):
    docs = read_table(spark, d, "documents")
    sents = enc.document_sentences(docs)
    _, vectors = enc.fit_word2vec(sents.select("sentence"), partitions=W2V_PARTITIONS)
    return docs, sents, vectors


def q_flagship(spark, d):
    return flagship(read_table(spark, d, "documents"))


def _small_map(epochs: int) -> DetectorConfig:
    """A map that SQL can unroll epoch by epoch; all else as in production."""
    return DetectorConfig(map_rows=4, map_cols=4, epochs=epochs, som_init="frequent")


def q_flagship_small_map(spark, d):
    """The flagship report by a 4 x 4 map and 5 epochs, every step of which the SQL repeats."""
    return flagship(read_table(spark, d, "documents"), cfg=_small_map(5))


def q_detector_small_map(spark, d):
    """``detector_predictions`` by a 4 x 4 map and 10 epochs, every step of which the SQL repeats."""
    docs = read_table(spark, d, "documents")
    lines = document_lines(docs)
    det = SomDetector(cfg=_small_map(10)).fit(lines, sentences=enc.document_sentences(docs), whole=True)
    p = det.predict(lines, ["doc_id", "line_no"], batch_id="b0", training=True)
    return p.select("doc_id", "line_no", "predict_id", "bmu", _r(F.col("anomaly_score"), "anomaly_score"), "anomaly")


def q_detector_predictions(spark, d):
    """Every document line scored by co-occurrence vectors + the production map with its flag."""
    docs = read_table(spark, d, "documents")
    lines = document_lines(docs)
    det = SomDetector().fit(lines, sentences=enc.document_sentences(docs), whole=True)
    p = det.predict(lines, ["doc_id", "line_no"], batch_id="b0", training=True)
    return p.select("doc_id", "line_no", "predict_id", "bmu", _r(F.col("anomaly_score"), "anomaly_score"), "anomaly")


def q_infer_new_lines(spark, d):
    """Fit on document lines, score conversation lines; unseen templates get seeded vectors."""
    docs = read_table(spark, d, "documents")
    lines = document_lines(docs)
    det = SomDetector().fit(lines, sentences=enc.document_sentences(docs), whole=True)
    new = conversation_lines(read_table(spark, d, "conversations")).withColumnRenamed("conv_id", "doc_id") \
        .withColumn("line_key", F.concat_ws(":", "turn", "line_no"))
    p = det.predict(new, ["doc_id", "line_key"], batch_id="b1")
    return p.select("doc_id", "turn", "line_no", _r(F.col("anomaly_score"), "anomaly_score"), "anomaly")


def q_infer_retrain_small_map(spark, d):
    """Fit on all sources but the last, infer that one's lines: unseen templates refit the map on both.

    A 4 x 4 map and 2 epochs, every step of which the SQL repeats.
    """
    docs = read_table(spark, d, "documents")
    last = docs.agg(F.max("source")).first()[0]
    is_new = F.coalesce(F.col("source") == F.lit(last), F.lit(False))
    old = docs.where(~is_new)
    lines = document_lines(docs)
    det = SomDetector(cfg=_small_map(2)).fit(lines.where(~is_new), sentences=enc.document_sentences(old), whole=True)
    p = det.infer(lines.where(is_new), ["doc_id", "line_no"], "b1", lines.where(~is_new), sentences=enc.document_sentences(docs))
    return p.select("doc_id", "line_no", "predict_id", "bmu", _r(F.col("anomaly_score"), "anomaly_score"), "anomaly")


def q_w2v_vectors(spark, d):
    _, _, vectors = _w2v(spark, d)
    return vectors


def q_w2v_similar_words(spark, d):
    """Top-3 neighbours of the five most frequent templates."""
    docs, sents, vectors = _w2v(spark, d)
    top = enc.sentence_vocabulary(sents).orderBy(F.col("n").desc(), "word").limit(5)
    probes = top.join(vectors, "word").select("word", "vector")
    return enc.similar_words(probes, vectors, k=3)


def q_w2v_pair_similarity(spark, d):
    docs, sents, vectors = _w2v(spark, d)
    return enc.pair_similarity(enc.cooccurrence_pairs(sents), vectors)


def q_kmeans_sizes(spark, d):
    a = cluster.kmeans_assign(emb_df(spark, d), "v", 2, SEEDS)
    return cluster.cluster_sizes(a)


def q_kmeans_cosine_sizes(spark, d):
    a = cluster.kmeans_assign(emb_df(spark, d), "v", 2, SEEDS, measure="cosine")
    return cluster.cluster_sizes(a)


def q_kmeans_centre_distances(spark, d):
    emb = emb_df(spark, d)
    model, _ = cluster.fit_kmeans(emb, "v", 3, SEEDS)
    centres = [c.tolist() for c in model.clusterCenters()]
    cb = som.Codebook(1, len(centres), __import__("numpy").array(centres))
    s = som.bmu_search(emb, "v", cb, keep_vector=False, bmu_col="cluster", dist_col="centre_distance")
    return s.select("vec_id", "cluster", _r(F.col("centre_distance"), "centre_distance"))


def q_elbow(spark, d):
    return cluster.elbow(emb_df(spark, d), "v", range(1, 10), seeds=ELBOW_SEEDS)


def q_pca_variance(spark, d):
    (_, pca), _ = cluster.pca_fit(emb_df(spark, d), "v", 2)
    return cluster.explained_variance(pca, spark)


def q_lof_pca(spark, d):
    _, proj = cluster.pca_fit(emb_df(spark, d), "v", 2)
    scores = outliers.lof(proj.select("vec_id", "pc"), "vec_id", "pc", 20, block_rows=512)
    return outliers.scaled_radius(scores)


def q_som_fit_warm(spark, d):
    """Fit a map, then continue training from it on the label-0 rows only (warm start)."""
    emb = emb_df(spark, d)
    cb = som.init_pca(emb, "v", 4, 4)
    first, _ = som.fit_som(emb, "v", cb, epochs=3)
    again, _ = som.fit_som(emb.where(F.col("label") == 0), "v", first, epochs=2)
    return som.bmu_hits(som.bmu_search(emb, "v", again, keep_vector=False))


def q_map_clusters(spark, d):
    """Cluster the fitted map's nodes into three groups (k-means on the codebook)."""
    emb = emb_df(spark, d)
    fitted, _ = som.fit_som(emb, "v", som.init_pca(emb, "v", 4, 4), epochs=3)
    nodes = fitted.to_df(spark)
    a = cluster.kmeans_assign(nodes, "w", 3, (1,))
    return a.select("node", "gx", "gy", F.col("prediction").alias("cluster"))


def registry() -> dict:
    return {name[2:]: fn for name, fn in globals().items() if name.startswith("q_") and callable(fn)}
