"""Sharded embeddings, count invariants and the subspace detector against brute force and planted structure."""

import collections
import itertools
import math
import os
import threading

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from outlog.operators import cluster, invariants, lda, sgns, subspace, tfidf
from outlog.plans import models


def topic_pairs(spark):
    """Two groups of ten words; words of a group stand near each other, and each group has its documents."""
    rng = np.random.default_rng(4)
    near = [(f"{t}{i}", f"{t}{j}", int(rng.integers(3, 9))) for t in "ab" for i in range(10) for j in range(10) if i != j]
    counts = spark.createDataFrame(near, "word string, context string, n long")
    words = spark.createDataFrame([(k, f"{'ab'[k % 2]}{j}") for k in range(12) for j in rng.integers(0, 10, 8).tolist()], "doc_id long, word string")
    return sgns.word_pairs(counts).unionByName(sgns.document_pairs(words, "doc_id", "word"))


def cosine(a, b):
    return float(a @ b / np.linalg.norm(a) / np.linalg.norm(b))


@pytest.mark.parametrize("block_keys", [1000, 12])
def test_sharded_embeddings_find_the_planted_groups(spark, block_keys):
    """One block or several, words and documents lie nearest to those of their group; the loss falls."""
    rows, cols, loss = sgns.train(topic_pairs(spark), dim=8, epochs=6, block_keys=block_keys)
    words = {r.word: np.array(r.vector) for r in sgns.word_vectors(rows).collect()}
    docs = {r.doc_id: np.array(r.vector) for r in sgns.document_vectors(rows).collect()}
    assert len(words) == 20 and sorted(docs) == list(range(12)) and cols.count() == 20
    same = [cosine(words[a], words[b]) for a, b in itertools.combinations(words, 2) if a[0] == b[0]]
    other = [cosine(words[a], words[b]) for a, b in itertools.combinations(words, 2) if a[0] != b[0]]
    assert min(same) > max(other) and np.mean(same) > np.mean(other) + 0.5
    for k, v in docs.items():
        best = max(words, key=lambda w: cosine(words[w], v))
        assert best[0] == "ab"[k % 2]
    falls = [r.loss for r in loss.orderBy("epoch").collect()]
    assert len(falls) == 6 and falls[-1] < falls[0]


def test_sharded_embeddings_are_equal_on_every_run(spark):
    pairs = topic_pairs(spark)
    runs = []
    for parts, shuffles in ((1, "3"), (7, "8")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        rows, _, _ = sgns.train(pairs.repartition(parts), dim=4, epochs=2, block_keys=9)
        runs.append({r.key: r.vector for r in rows.collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert runs[0] == runs[1] and len(runs[0]) == 32


def test_every_pair_is_trained_once_an_epoch(spark, monkeypatch):
    """Without negatives and with a step of zero, each epoch's loss is log 2 a pair: all cells were met."""
    _, _, loss = sgns.train(topic_pairs(spark), dim=3, epochs=1, negatives=0, rate=0.0, block_keys=7)
    assert abs(loss.first().loss - math.log(2)) < 1e-12


def test_draws_follow_the_pairs_of_a_cell():
    """Rows without a pair in a cell draw only as often as they expect negatives there."""
    taken = []

    class Rng:
        def __init__(self):
            self.rng = np.random.default_rng(1)

        def __getattr__(self, name):
            return getattr(self.rng, name)

        def permutation(self, n):
            taken.append(n)
            return self.rng.permutation(n)

    rows, cols, n = np.arange(10), np.arange(10), np.ones(10)
    args = np.zeros((1000, 4)), np.zeros(1000), np.zeros((20, 4)), np.zeros(20), np.ones(20), 0.01, np.ones(1000)
    sgns.train_cell(*args, rows, cols, n, 5, 0.1, Rng())
    assert 60 <= sum(taken) < 300


def test_a_cell_is_trained_in_parts(monkeypatch):
    """Cells of many pairs draw part by part; every pair is met once."""
    monkeypatch.setattr(sgns, "PAIRS_AT_ONCE", 7)
    rows = np.arange(50) % 10
    loss = sgns.train_cell(np.zeros((10, 2)), np.zeros(10), np.zeros((5, 2)), np.zeros(5), np.ones(5), 1.0, np.full(10, 5.0), rows,
                           np.arange(50) % 5, np.ones(50), 2, 0.0, np.random.default_rng(1))
    assert np.isclose(loss, 150 * math.log(2))


def test_parameters_lie_packed_between_turns(spark, monkeypatch):
    made = []
    cut = sgns.cut_over

    def noted(df, old):
        out = cut(df, old)
        if "vec" in df.columns:
            made.append(out[0].count())
        return out

    monkeypatch.setattr(sgns, "cut_over", noted)
    sgns.train(topic_pairs(spark), dim=2, epochs=1, block_keys=12)     # 32 rows and 20 columns in three blocks
    assert len(made) == 4 and made[0] == 6 and made[1:] == [9, 9, 9]


def test_embeddings_of_odd_pairs(spark):
    df = spark.createDataFrame([(None, "x", 1), ("w:a", None, 1), ("w:a", "x", 1), ("w:a", "x", 2)], "row string, col string, n long")
    rows, cols, _ = sgns.train(df, dim=2, epochs=1)
    assert [r.key for r in rows.collect()] == ["w:a"] and [r.key for r in cols.collect()] == ["x"]
    rows, cols, loss = sgns.train(df.where("false"), dim=2, epochs=1)
    assert rows.count() == cols.count() == loss.count() == 0


def test_alias_table_is_the_distribution():
    p = np.array([5.0, 1, 0.5, 3, 0.5])
    keep, other = sgns._alias(p)
    back = keep.copy()
    np.add.at(back, other, 1 - keep)
    assert np.allclose(back / len(p), p / p.sum())


def brute_relations(x, tolerance, terms, coef):
    found = {}
    for theta in itertools.product(range(-coef, coef + 1), repeat=x.shape[1]):
        used = {i for i, c in enumerate(theta) if c}
        if not 2 <= len(used) <= terms or math.gcd(*theta) != 1 or next(c for c in theta if c) < 0:
            continue
        if ((x @ np.array(theta)) ** 2).mean() <= tolerance:
            found[theta] = used
    return {t for t, u in found.items() if not any(v < u for v in found.values())}


def test_relations_against_all_coefficients():
    rng = np.random.default_rng(8)
    for trial in range(20):
        n = 60
        a, b = rng.integers(0, 4, n), rng.integers(0, 3, n)
        x = np.stack([a, 2 * a, b, a + b, rng.integers(0, 2, n)], axis=1)[:, rng.permutation(5)]
        x[rng.integers(0, n, trial % 3), rng.integers(0, 5)] += 1
        got = invariants.relations(x.T @ x, n, 0.06, 4, 2)
        assert set(got) == brute_relations(x, 0.06, 4, 2) and len(got) == len(set(got)), trial


def test_mining_names_the_broken_windows(spark):
    """Every open has its close but in two of 300 sessions, one of which holds a third of all rows."""
    rows = [(s, e) for s in range(300) for e in ["open"] * (1 + s % 3) + ["read"] * (s % 5) + ["close"] * (1 + s % 3)]
    rows += [(7, "open"), (8, "close"), (8, "read")] + [(9, e) for e in ("open", "close") for _ in range(700)] + [(None, "open"), (3, None)]
    found, broken = invariants.mine(spark.createDataFrame(rows, "s long, e string"), "s", "e")
    assert [(r.invariant, r.n_terms, r.n_windows, r.n_broken) for r in found.collect()] == [("1*close + -1*open", 2, 300, 2)]
    assert sorted((r.window, r.value) for r in broken.collect()) == [(7, -1), (8, 1)]
    none, no_window = invariants.mine(spark.createDataFrame([], "s long, e string"), "s", "e")
    assert none.count() == no_window.count() == 0


def test_subspace_scores_limit_and_planted_rows(spark):
    rng = np.random.default_rng(5)
    plane, _ = np.linalg.qr(rng.normal(size=(10, 10)))
    x = (rng.normal(size=(4000, 10)) * ([5, 4] + [0.3] * 8)) @ plane.T + 1e4
    x[:20] += 6 * plane[:, 9]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(-1, None)], "id long, v array<double>")
    space = subspace.fit(df.where("id >= 20"), "v", 0.95)
    assert space.components.shape == (2, 10)
    got = {r.id: r.spe for r in subspace.score(df, "v", space).collect()}
    y = x - x[20:].mean(0)
    rest = y - y @ space.components.T @ space.components
    assert got.pop(-1) is None and np.allclose([got[i] for i in range(4000)], (rest ** 2).sum(1))
    limit = space.limit(0.01)
    flagged = {i for i, s in got.items() if s > limit}
    assert set(range(20)) <= flagged and 10 < len(flagged - set(range(20))) < 90      # about 1 % of 3,980


def test_subspace_without_any_rest(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "id long, v array<double>")
    space = subspace.fit(df, "v")
    assert space.limit() == 0.0 and {r.spe for r in subspace.score(df, "v", space).collect()} == {0.0}


# ---- neighbours by words -----------------------------------------------------------------------------

def brute_neighbours(docs, k):
    """The k nearest by TF-IDF cosine: every pair of {id: [words]}."""
    docs = {i: w for i, w in docs.items() if w}
    df = collections.Counter(t for w in docs.values() for t in set(w))
    vec = {}
    for i, w in docs.items():
        x = {t: c * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, c in collections.Counter(w).items()}
        n = math.sqrt(sum(v * v for v in x.values()))
        vec[i] = {t: v / n for t, v in x.items()}
    out = []
    for q in vec:
        near = sorted((-round(sum(v * vec[d].get(t, 0) for t, v in vec[q].items()), 6), d) for d in vec
                      if d != q and vec[q].keys() & vec[d].keys())
        out += [(q, r + 1, d, -s) for r, (s, d) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("rare,chunk", [(3, 4), (1000, 4096)])
def test_tfidf_neighbours_are_exact(spark, monkeypatch, rare, chunk):
    """Copies (ties), a word of every row, rows alone with their words, small chunks: as by every pair."""
    monkeypatch.setattr(tfidf, "CHUNK", chunk)
    rng = np.random.default_rng(6)
    docs = {i: ["the"] * (i % 3 + 1) + [f"w{x}" for x in rng.zipf(1.5, rng.integers(1, 12)) if x < 200] for i in range(60)}
    docs |= {100 + i: docs[5] for i in range(8)} | {200: ["alone"], 201: []}
    rows = [(i, w) for i, ws in docs.items() for w in ws] + [(None, "the"), (3, None)]
    index = tfidf.postings(spark.createDataFrame(rows, "id long, term string"), "id", "term")
    want = brute_neighbours(docs, 4)
    got = tfidf.nearest(index, 4, rare=rare)
    assert sorted((r.query_id, r.rank, r.id, r.similarity) for r in got.collect()) == want
    some = tfidf.nearest(index, 4, spark.createDataFrame([(3,), (3,), (104,)], "k long"), rare)
    assert sorted(tuple(r) for r in some.collect()) == [w for w in want if w[0] in (3, 104)]
    nothing = tfidf.postings(spark.createDataFrame([], "id long, term string"), "id", "term")
    assert tfidf.nearest(nothing, 4).count() == 0


def test_tfidf_neighbours_write_no_pairs_of_rows(spark, monkeypatch):
    """Equal rows and a word of every row: no table written on the way is longer than the postings."""
    sizes, cut = [], tfidf.cut_lineage

    def noted(df):
        out = cut(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(tfidf, "cut_lineage", noted)
    docs = {i: ["the", "same"] if i % 2 else ["the", f"w{i % 20}"] for i in range(300)}
    index = tfidf.postings(spark.createDataFrame([(i, w) for i, ws in docs.items() for w in ws], "id long, term string"), "id", "term")
    got = tfidf.nearest(index, 4).collect()
    assert sorted((r.query_id, r.rank, r.id, r.similarity) for r in got) == brute_neighbours(docs, 4)
    assert max(sizes) <= 2 * len(docs)


@pytest.mark.parametrize("chunk", [20, 9])
def test_tfidf_blocks_meet_in_rounds(spark, monkeypatch, chunk):
    """An even and an odd number of blocks, one distance a round: exact, and no round moves a row more than twice."""
    monkeypatch.setattr(tfidf, "CHUNK", chunk)
    monkeypatch.setattr(tfidf, "ROUND_POSTINGS", 1)
    rng = np.random.default_rng(8)
    docs = {i: [f"t{x}" for x in rng.zipf(1.4, rng.integers(1, 12)).clip(max=60).tolist()] for i in range(77)}
    made, cut = [], tfidf.cut_over
    monkeypatch.setattr(tfidf, "cut_over", lambda df, old: made.append(cut(df, old)) or made[-1])
    index = tfidf.postings(spark.createDataFrame([(i, w) for i, ws in docs.items() for w in ws], "id long, term string"), "id", "term")
    got = tfidf.nearest(index, 3)
    assert sorted((r.query_id, r.rank, r.id, r.similarity) for r in got.collect()) == brute_neighbours(docs, 3)
    blocks = max(tfidf.LEAST_BLOCKS, -(-77 // chunk))
    assert len(made) == 2 + blocks // 2 + 1        # counts, terms, the best after every round
    assert [os.path.isdir(path.removeprefix("file:")) for _, path in made] == [False] * (len(made) - 1) + [True]


def test_elbow_fits_run_side_by_side(spark, monkeypatch):
    """At least two fits are under way at once, and costs are those of fits one by one."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(rng.normal(size=3).tolist(),) for _ in range(200)], "v array<double>").repartition(3).cache()
    alone = {k: cluster.fit_kmeans(df, "v", k)[1] for k in (2, 3, 4)}
    fit, met = cluster.KMeans.fit, threading.Barrier(2)

    def noted(self, data):
        if self.getK() < 4:
            met.wait(60)
        return fit(self, data)

    monkeypatch.setattr(cluster.KMeans, "fit", noted)
    got = {r.k: r.cost for r in cluster.elbow(df, "v", range(1, 5)).collect()}
    assert sorted(got) == [1, 2, 3, 4] and all(np.isclose(got[k], alone[k], rtol=1e-9) for k in alone)
    x = np.array([r.v for r in df.collect()])
    assert np.isclose(got[1], ((x - x.mean(axis=0)) ** 2).sum())
    df.unpersist()


def test_every_point_of_the_elbow_is_the_best_of_ten_restarts(spark, sf_small, monkeypatch):
    tried = []
    monkeypatch.setattr(cluster, "_fits", lambda df, v, ks, *a: tried.extend(ks) or [(None, 100.0 * k - s) for k, s in ks])
    costs = {r.k: r.cost for r in models.q_elbow(spark, sf_small).collect()}
    assert sorted(tried) == [(k, s) for k in range(2, 10) for s in range(1, 11)]
    assert sorted(costs) == list(range(1, 10)) and all(costs[k] == 100.0 * k - 10 for k in range(2, 10))


# ---- topics ---------------------------------------------------------------------------------------------

def test_digamma():
    h = [0.5772156649015329 * -1 + sum(1 / k for k in range(1, n)) for n in range(1, 12)]
    assert np.allclose(lda._digamma(np.arange(1, 12)), h, atol=1e-10)


def test_topics_recover_planted_groups_and_held_out_perplexity_falls(spark):
    """Three groups of ten words: each topic's heaviest words are one group, documents follow their group."""
    rng = np.random.default_rng(9)
    rows = [(i, f"{'abc'[i % 3]}{w}", 1) for i in range(150) for w in rng.integers(0, 10, 30).tolist()]
    counts = spark.createDataFrame(rows, "doc long, word string, n long")
    fit, held = counts.where("doc < 120"), counts.where("doc >= 120")
    rough = lda.perplexity(lda.score(held, lda.fit(fit, 3, epochs=1, batches=1, offset=64.0)))
    topics = lda.fit(fit, 3, epochs=5)
    scored = lda.score(held, topics)
    assert lda.perplexity(scored) < 15 < rough      # 10 words are as likely each, of 30
    lam = {r.word: np.array(r.lam) / topics.sums for r in topics.words.collect()}
    tops = [{w[0] for w in sorted(lam, key=lambda w: -lam[w][t])[:10]} for t in range(3)]
    assert sorted(x for s in tops for x in s) == ["a", "b", "c"]
    leading = {}
    for r in scored.collect():
        assert leading.setdefault(r.doc % 3, r.topic) == r.topic and r.n_words == 30
    strange = spark.createDataFrame([(1, "never", 5), (2, "a1", 5), (None, "a1", 1), (3, None, 1), (4, "a1", 0)], "doc long, word string, n long")
    got = {r.doc: r.log_likelihood for r in lda.score(strange, topics).collect()}
    assert sorted(got) == [1, 2] and got[1] < got[2]
    with pytest.raises(ValueError):
        lda.fit(counts.where("false"), 3)


def test_a_turn_leaves_no_parameters_of_the_turns_before(spark, monkeypatch):
    """Of all turns' folders only the last one's stays, and the pairs by turn are gone."""
    made = []
    path = sgns.scratch_path
    monkeypatch.setattr("outlog.session.scratch_path", lambda s, name: made.append(path(s, name)) or made[-1])
    monkeypatch.setattr(sgns, "scratch_path", lambda s, name: made.append(path(s, name)) or made[-1])
    rows, _, loss = sgns.train(topic_pairs(spark), dim=2, epochs=2, block_keys=7)
    assert rows.count() and loss.count() == 2 and len(made) > 6
    assert sum(os.path.isdir(p) for p in made) == 2     # the counted pairs and the last parameters


def test_topics_hold_few_documents_as_objects(monkeypatch):
    monkeypatch.setattr(lda, "DOCS_AT_ONCE", 3)
    b = pa.record_batch([pa.array(range(8))], ["doc"])
    assert [x["doc"].to_pylist() for x in lda._few([b, b.slice(0, 0)])] == [[0, 1, 2], [3, 4, 5], [6, 7]]
