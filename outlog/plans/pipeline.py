"""End-to-end plans: fit a detector on log lines, score new lines, publish predictions.

Scoring works on distinct templates: lines are grouped by template (partial aggregation
absorbs hot templates), the distinct templates are encoded and scored once, and the scores
are joined back to the lines.  Weighted by their counts this gives exactly the numbers of
scoring every line, with work proportional to the number of distinct templates.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from ..config import DetectorConfig
from ..operators import encoder as enc
from ..operators import som
from ..operators.detect import ScoreStats, false_positive_marks, predictions, score_stats
from ..session import broadcast_if_small, cut_lineage


class Detector(Protocol):
    """What every detector offers: fit on lines, then score lines."""

    def fit(self, lines: DataFrame) -> "Detector": ...

    def score(self, lines: DataFrame) -> DataFrame: ...


def template_counts(lines: DataFrame, word_col: str = "template") -> DataFrame:
    return lines.groupBy(F.col(word_col).alias("template")).agg(F.count("*").alias("n"))


def template_key(word_col: str = "template") -> Column:
    """Sixteen bytes that stand for a template where scores meet lines: no long string is sorted or moved for it."""
    return F.unhex(F.md5(word_col))


def with_noise(lines: DataFrame, fp_messages: DataFrame | None, copies: int) -> DataFrame:
    """Training lines plus every reported false positive repeated ``copies`` times."""
    if fp_messages is None or copies <= 0:
        return lines
    from ..operators.feedback import noise_rows
    return lines.unionByName(noise_rows(fp_messages, copies), allowMissingColumns=True)


@dataclass
class SomDetector:
    """Template encoder + self-organising map + learned threshold."""

    cfg: DetectorConfig = field(default_factory=DetectorConfig)
    encoder: str = "cooccurrence"        # or "word2vec", "hash"
    kernel: str = "gaussian"
    vectors: DataFrame | None = None
    codebook: som.Codebook | None = None
    stats: ScoreStats | None = None
    qe_history: list = field(default_factory=list)
    vocab_size: int = 0
    noise: DataFrame | None = None
    noise_copies: int = 0
    whole: bool = False
    fits: int = 0

    @property
    def model_version(self) -> str:
        """The configured version for the first fit, ``<version>.1``, ``.2``, ... for those after it."""
        return self.cfg.model_version if self.fits <= 1 else f"{self.cfg.model_version}.{self.fits - 1}"

    def _sentences(self, lines: DataFrame, sentences: DataFrame | None) -> DataFrame:
        if sentences is not None:
            return sentences
        return enc.sequence_sentences(lines, ["source"], ["doc_id", "line_no"], window=self.cfg.window)

    def fit(self, lines: DataFrame, sentences: DataFrame | None = None,
            noise: DataFrame | None = None, noise_copies: int = 0, whole: bool = False) -> "SomDetector":
        """Fit encoder, map and baseline on ``lines`` (plus optional false-positive noise).

        ``whole``: the words of ``sentences`` are exactly the templates of ``lines``, so templates are counted
        where their vectors are summed and the lines are not read for it.
        """
        cfg = self.cfg
        self.noise, self.noise_copies, self.whole = noise, noise_copies, whole
        train = with_noise(lines.select("template", "message"), noise, noise_copies)
        counts = template_counts(train)
        if whole and sentences is not None and noise is None and self.encoder == "cooccurrence" and cfg.min_count <= 1 \
                and "after" not in sentences.columns:
            encoded = cut_lineage(enc.counted_vectors(sentences, cfg.vector_length, cfg.window, cfg.w2v_seed)
                                  .withColumnRenamed("word", "template"))
            self.vectors = encoded.select(F.col("template").alias("word"), "vector")
        elif self.encoder in ("cooccurrence", "word2vec"):
            sents = self._sentences(lines, sentences)
            sents = sents.select(*[c for c in ("sentence", "after") if c in sents.columns])
            if noise is not None and noise_copies > 0:
                from ..operators.feedback import noise_sentences
                sents = sents.unionByName(noise_sentences(noise, noise_copies).select("sentence"), allowMissingColumns=True)
            if self.encoder == "word2vec":
                _, vectors = enc.fit_word2vec(sents, cfg.vector_length, cfg.window, cfg.min_count, cfg.w2v_iter,
                                              cfg.w2v_seed, cfg.w2v_partitions, cfg.max_sentence_length)
            else:
                vectors = enc.cooccurrence_vectors(sents, cfg.vector_length, cfg.window, cfg.min_count, cfg.w2v_seed)
            encoded, self.vectors = enc.encode_counts(counts, vectors, cfg.vector_length, cfg.oov, cfg.w2v_seed)
        elif self.encoder == "hash":
            counts = cut_lineage(counts)
            self.vectors = enc.hash_vectors(counts.select(F.col("template").alias("word")),
                                            cfg.vector_length, cfg.w2v_seed)
            encoded = cut_lineage(enc.encode(counts, self.vectors, "template", "vector",
                                             cfg.vector_length, cfg.oov, cfg.w2v_seed))
        else:
            raise ValueError(f"unknown encoder {self.encoder!r}")
        self.vocab_size = encoded.count()
        init = som.init_codebook(encoded, "vector", cfg.map_rows, cfg.map_cols, cfg.som_init,
                                 word_col="template", count_col="n", seed=cfg.w2v_seed)
        self.codebook, self.qe_history = som.fit_som(encoded, "vector", init, cfg.epochs,
                                                     self.kernel, weight_col="n", cache=False)
        self.train_scored = cut_lineage(
            som.bmu_search(encoded.select(template_key().alias("key"), "n", "vector"), "vector", self.codebook, keep_vector=False))
        self.stats = score_stats(self.train_scored, "dist", "n")
        self.fits += 1
        return self

    def score_templates(self, lines: DataFrame) -> DataFrame:
        counts = template_counts(lines)
        encoded = enc.encode(counts, self.vectors, "template", "vector", self.cfg.vector_length,
                             self.cfg.oov, self.cfg.w2v_seed)
        return som.bmu_search(encoded, "vector", self.codebook, keep_vector=False)

    def score(self, lines: DataFrame, training: bool = False) -> DataFrame:
        """Every line with ``bmu`` and ``dist``.

        Lines and scores meet by ``template_key``, so a column of the lines that is not read
        afterwards (the template itself, the message) is not moved for the join.

        ``training=True`` means ``lines`` are the lines the model was fitted on, whose
        templates are already scored.  The scored templates are broadcast when their
        count is below a checked limit; otherwise the join back is a shuffle join whose
        hot-template partitions AQE splits.
        """
        if training:
            scored = self.train_scored.select(F.col("key").alias("__key"), "bmu", "dist")
        else:
            scored = cut_lineage(self.score_templates(lines).select(template_key().alias("__key"), "bmu", "dist"))
        first = ["template", *[c for c in lines.columns if c != "template"]]
        return lines.select(*first, template_key().alias("__key")).join(broadcast_if_small(scored), "__key", "left").drop("__key")

    def predict(self, lines: DataFrame, id_cols: list[str], batch_id: str,
                fp_messages: DataFrame | None = None, training: bool = False) -> DataFrame:
        # marked before the join with the scores, which then need not carry the messages
        marked = false_positive_marks(lines, fp_messages)
        return predictions(self.score(marked, training), self.stats, id_cols, batch_id,
                           factor=self.cfg.threshold_factor, model_version=self.model_version,
                           elast_alert=self.cfg.elast_alert, namespace=self.cfg.namespace)

    def infer(self, lines: DataFrame, id_cols: list[str], batch_id: str, train_lines: DataFrame,
              fp_messages: DataFrame | None = None, sentences: DataFrame | None = None) -> DataFrame:
        """Score new lines; when they hold templates the encoder has never seen, refit the
        detector on the training lines plus the new ones first (``oov='retrain'``), with the
        noise of the first fit and under a model version of its own.  ``sentences`` are those of both
        line sets, when the first fit was given its own."""
        unseen = enc.new_words(lines, self.vectors.select("word"))
        refit = not unseen.isEmpty()
        if refit:
            both = train_lines.unionByName(lines, allowMissingColumns=True)
            self.fit(both, sentences, self.noise, self.noise_copies, self.whole)
        # after a refit the new lines are training lines, whose templates are scored already
        return self.predict(lines, id_cols, batch_id, fp_messages, training=refit)

    def threshold(self) -> float:
        return self.stats.threshold(self.cfg.threshold_factor)

    def codebook_df(self, spark) -> DataFrame:
        return self.codebook.to_df(spark, self.model_version)


def flagship(documents: DataFrame, top: int = 20, cfg: DetectorConfig | None = None) -> DataFrame:
    """Which log lines are anomalous?  documents -> lines -> co-occurrence vectors -> SOM -> top scores.

    Lines are the non-empty lines of every document; a document is a sentence for the
    encoder.  Vectors, map and epochs are those of the production configuration
    (``DetectorConfig``: length 25, 24 x 24 from the principal components, 105 epochs); the
    threshold is ``3.1 * std + mean`` of the normalised training distances.  Returns the ``top`` highest-scoring lines with their flag.
    """
    from ..sources.logs import document_lines
    from ..operators.encoder import document_sentences

    cfg = cfg or DetectorConfig()
    lines = document_lines(documents)
    det = SomDetector(cfg=cfg).fit(lines, sentences=document_sentences(documents), whole=True)
    preds = det.predict(lines, ["doc_id", "line_no"], batch_id="flagship", training=True)
    return (preds.select("doc_id", "line_no", "source", "message", "template", "bmu",
                         F.round("anomaly_score", 6).alias("anomaly_score"), "anomaly")
                 .orderBy(F.col("anomaly_score").desc(), "doc_id", "line_no").limit(top))
