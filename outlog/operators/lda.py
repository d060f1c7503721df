"""Topics of count data by online variational Bayes, with topics sharded by word.

Topics are a table of one row per word (K numbers); the driver holds K column sums, nothing of the vocabulary.
A step takes a share of the documents (by a hash of the id, each epoch the same shares in turn): their words
meet the words' topic numbers in a join, Arrow batches of whole documents run the variational E-step in numpy,
and the expected counts come back by ``groupBy`` on the word, blended into the table with a falling rate.
A document's score is the log likelihood of its words under its own topics; a word the topics never saw
counts as one of a vocabulary one larger.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

ROUNDS, STILL = 60, 1e-4      # E-step rounds at most, and the mean change that ends them
DOCS_AT_ONCE = 256            # documents of an Arrow batch that a task holds as Python objects at once


@dataclass
class Topics:
    """``words``: (word, lam array<double>); ``sums``: K column sums; priors and the number of words."""

    words: DataFrame
    sums: np.ndarray
    alpha: float
    eta: float
    vocabulary: int


def _digamma(x: np.ndarray) -> np.ndarray:
    """Digamma for positive numbers: shifted above 6, then its asymptotic series."""
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(6):
        low = x < 6
        out = np.where(low, out - 1 / np.where(low, x, 1), out)
        x = np.where(low, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def e_step(n: np.ndarray, beta: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Topic weights of a document and the expected counts of its words; ``beta`` is exp E log of the words' topics."""
    k = beta.shape[1]
    gamma = np.full(k, alpha + n.sum() / k)
    for _ in range(ROUNDS):
        theta = np.exp(_digamma(gamma) - _digamma(np.array([gamma.sum()])))
        norm = beta @ theta + 1e-100
        new = alpha + theta * ((n / norm) @ beta)
        moved = np.abs(new - gamma).mean()
        gamma = new
        if moved < STILL:
            break
    theta = np.exp(_digamma(gamma) - _digamma(np.array([gamma.sum()])))
    return gamma, theta[None, :] * beta * (n / (beta @ theta + 1e-100))[:, None]


def _documents(counts: DataFrame, topics: Topics) -> DataFrame:
    """One row per document: its words, counts and their topic numbers (null: an unseen word)."""
    told = counts.join(topics.words, "word", "left")
    return told.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("word", "n", "lam"))).alias("t")) \
        .select("doc", F.col("t.word").alias("word"), F.col("t.n").alias("n"), F.col("t.lam").alias("lam"))


def _numbers(n: list, lam: list, eta: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.array(n, float), np.array([[eta] * k if x is None else x for x in lam], float)


def _few(batches):
    """The rows of the batches, a few documents at a time."""
    for b in batches:
        for a in range(0, b.num_rows, DOCS_AT_ONCE):
            yield b.slice(a, DOCS_AT_ONCE)


def fit(counts: DataFrame, k: int, epochs: int = 4, batches: int = 2, alpha: float | None = None, eta: float | None = None,
        seed: int = 1, offset: float = 1.0, power: float = 0.7) -> Topics:
    """Topics of (doc, word, n).  Rows with a null or without a count are left out; no rows are refused."""
    counts = cut_lineage(counts.where(F.col("doc").isNotNull() & F.col("word").isNotNull() & (F.col("n") > 0))
                         .groupBy("doc", "word").agg(F.sum("n").alias("n"))
                         .withColumn("share", F.pmod(F.xxhash64("doc"), F.lit(batches))))
    alpha, eta = alpha or 1.0 / k, eta or 1.0 / k
    start = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: 0.5 + F.conv(F.substring(F.md5(
        F.concat_ws(":", F.lit(str(seed)), F.col("word"), i.cast("string"))), 1, 8), 16, 10).cast("double") / 2 ** 32)
    words = cut_lineage(counts.select("word").distinct().select("word", start.alias("lam")))
    sizes = {r["share"]: r["d"] for r in counts.groupBy("share").agg(F.countDistinct("doc").alias("d")).collect()}
    total = sum(sizes.values())
    if not total:
        raise ValueError("no documents to fit")
    topics = Topics(words, _sums(words, k), alpha, eta, words.count())
    step = 0
    for _ in range(epochs):
        for share in sorted(sizes):
            rate = (offset + step) ** -power
            step += 1
            stats = _expected(_documents(counts.where(F.col("share") == share), topics), topics, k)
            scale = total / sizes[share]
            new = topics.words.join(stats, "word", "left").select("word", F.zip_with(
                "lam", F.coalesce("s", F.array_repeat(F.lit(0.0), k)),
                lambda a, b: (1 - rate) * a + rate * (eta + scale * b)).alias("lam"))
            words = cut_lineage(new)
            topics = Topics(words, _sums(words, k), alpha, eta, topics.vocabulary)
    return topics


def _sums(words: DataFrame, k: int) -> np.ndarray:
    row = words.agg(*[F.sum(F.col("lam")[i]).alias(f"s{i}") for i in range(k)]).first()
    return np.array([x or 0.0 for x in row])


def _expected(docs: DataFrame, topics: Topics, k: int) -> DataFrame:
    """(word, s): expected counts per topic, summed over the documents; a batch sends each word once."""
    base, alpha, eta = _digamma(topics.sums), topics.alpha, topics.eta

    def work(batches):
        for b in _few(batches):
            words, parts = [], []
            for w, n, lam in zip(b["word"].to_pylist(), b["n"].to_pylist(), b["lam"].to_pylist(), strict=True):
                c, m = _numbers(n, lam, eta, k)
                parts.append(e_step(c, np.exp(_digamma(m) - base), alpha)[1])
                words += w
            if words:
                names, at = np.unique(np.array(words, object), return_inverse=True)
                s = np.zeros((len(names), k))
                np.add.at(s, at, np.concatenate(parts))
                yield pa.record_batch([pa.array(names.tolist(), pa.string()), pa.array(s.tolist(), pa.list_(pa.float64()))], ["word", "s"])

    each = docs.mapInArrow(work, "word string, s array<double>")
    return each.groupBy("word").agg(F.array(*[F.sum(F.col("s")[i]) for i in range(k)]).alias("s"))


def score(counts: DataFrame, topics: Topics) -> DataFrame:
    """(doc, n_words, log_likelihood, topic): natural log of the words' probability, and the leading topic."""
    k = len(topics.sums)
    total, base, alpha, eta = topics.sums + topics.eta, _digamma(topics.sums), topics.alpha, topics.eta
    counts = counts.where(F.col("doc").isNotNull() & F.col("word").isNotNull() & (F.col("n") > 0)) \
        .groupBy("doc", "word").agg(F.sum("n").alias("n"))
    docs = _documents(counts, topics)
    kind = docs.schema["doc"].dataType.simpleString()

    def work(batches):
        for b in _few(batches):
            rows = []
            for n, lam in zip(b["n"].to_pylist(), b["lam"].to_pylist(), strict=True):
                c, m = _numbers(n, lam, eta, k)
                gamma, _ = e_step(c, np.exp(_digamma(m) - base), alpha)
                p = (m / total) @ (gamma / gamma.sum())
                rows.append((int(c.sum()), float(c @ np.log(p)), int(gamma.argmax())))
            n, ll, top = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([b["doc"], pa.array(n, pa.int64()), pa.array(ll, pa.float64()), pa.array(top, pa.int32())],
                                  ["doc", "n_words", "log_likelihood", "topic"])

    return docs.mapInArrow(work, f"doc {kind}, n_words long, log_likelihood double, topic int")


def perplexity(scored: DataFrame) -> float:
    r = scored.agg(F.sum("log_likelihood").alias("l"), F.sum("n_words").alias("n")).first()
    return math.exp(-r["l"] / r["n"])
