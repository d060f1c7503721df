import collections

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window, functions as F

from outlog.operators import encoder as enc
from outlog.sources import logs


def test_vocabulary_of_hadoop_2k_is_141(spark, hadoop_json):
    df = logs.read_json_logs(spark, hadoop_json)
    assert enc.vocabulary(df, "template", 1).count() == 141


def test_cooccurrence_equals_lead_window(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    pairs = enc.cooccurrence_counts(enc.document_sentences(docs), 5)
    lines = logs.document_lines(docs)
    w = Window.partitionBy("doc_id").orderBy("line_no")
    parts = [lines.select(F.col("template").alias("word"), F.lead("template", k).over(w).alias("context"))
             for k in range(1, 6)]
    ref = parts[0]
    for p in parts[1:]:
        ref = ref.unionByName(p)
    ref = ref.where(F.col("context").isNotNull()).groupBy("word", "context").agg(F.count("*").alias("n"))
    assert pairs.exceptAll(ref).count() == 0 and ref.exceptAll(pairs).count() == 0


def test_new_words_and_hash_oov(spark):
    vocab = spark.createDataFrame([("a", 1), ("b", 2)], "word string, n long")
    batch = spark.createDataFrame([("a",), ("c",), ("c",)], "template string")
    assert [r["word"] for r in enc.new_words(batch, vocab).collect()] == ["c"]
    vec = spark.createDataFrame([("a", [1.0, 1.0])], "word string, vector array<double>")
    out = {r["template"]: r["vector"] for r in enc.encode(batch, vec, dim=2, oov="hash").collect()}
    assert out["a"] == [1.0, 1.0] and len(out["c"]) == 2 and out["c"] != [0.0, 0.0]
    z = {r["template"]: r["vector"] for r in enc.encode(batch, vec, dim=2, oov="zero").collect()}
    assert z["c"] == [0.0, 0.0]


def test_word2vec_is_deterministic_and_finds_neighbours(spark):
    # two families of templates that always co-occur with their own kind
    fam_a = ["alpha", "beta", "gamma"]
    fam_b = ["delta", "epsilon", "zeta"]
    rows = []
    for i in range(60):
        fam = fam_a if i % 2 == 0 else fam_b
        rows.append((i, [fam[(i + k) % 3] for k in range(12)]))
    s = spark.createDataFrame(rows, "id long, sentence array<string>")
    _, v1 = enc.fit_word2vec(s, vector_length=10, window=2, max_iter=5, seed=1)
    _, v2 = enc.fit_word2vec(s, vector_length=10, window=2, max_iter=5, seed=1)
    a = {r["word"]: np.array(r["vector"]) for r in v1.collect()}
    b = {r["word"]: np.array(r["vector"]) for r in v2.collect()}
    assert all(np.allclose(a[w], b[w]) for w in a)
    probe = v1.where(F.col("word") == "alpha")
    top = [r["neighbour"] for r in enc.similar_words(probe, v1, k=2).orderBy("rank").collect()]
    assert set(top) == {"beta", "gamma"}


def test_word2vec_keeps_its_vocabulary_off_the_driver(spark, monkeypatch):
    """Spark's Word2Vec, which holds it there, is not used; words without neighbours have vectors, too; rare words are left out."""
    def refused(*a, **k):
        raise AssertionError("vocabulary on the driver")

    monkeypatch.setattr("pyspark.ml.feature.Word2Vec.__init__", refused)
    rows = [(["a", "b", "a", "b"],), (["alone"],), (None,), ([],), (["a", "rare", "b"],), (["alone"],)]
    s = spark.createDataFrame(rows, "sentence array<string>")
    model, v = enc.fit_word2vec(s, vector_length=3, window=2, min_count=2, max_iter=2, partitions=3)
    got = {r.word: r.vector for r in v.collect()}
    assert sorted(got) == ["a", "alone", "b"] and all(len(x) == 3 and all(np.isfinite(x)) and any(x) for x in got.values())
    assert model.loss.count() == 2 and sorted(r.word for r in model.contexts.collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        enc.fit_word2vec(s.where("sentence is null"))


def test_codes_sort_as_the_words_and_sentences_keep_their_order(spark):
    words = ["", "b", "a", "Z", "aa", "ab", "zz", "B"] + [f"w{i}" for i in range(100)]
    codes = enc.word_codes(spark.createDataFrame([(w,) for w in words], "word string").repartition(5))
    got = {r.word: r.code for r in codes.collect()}
    assert sorted(words) == sorted(words, key=got.get) and len(set(got.values())) == 108 and {len(c) for c in got.values()} == {7}
    rows = [(["b", "a", "b", None, "nobody"],), (None,), ([],), (words,), (words,)]
    coded = enc.coded_sentences(spark.createDataFrame(rows, "sentence array<string>"), codes)
    assert sorted(r.sentence for r in coded.collect()) == sorted([[got[w] for w in s] for s in (["b", "a", "b"], words, words)])


@pytest.mark.parametrize("at_once", [1, 1000])
def test_pair_similarity_in_rounds(spark, monkeypatch, at_once):
    monkeypatch.setattr(enc, "ROUND_PAIRS", at_once)
    vec = {"a": [1.0, 0.0], "b": [1.0, 1.0], "c": [0.0, 0.0]}
    pairs = [("a", "b", 1), ("a", "b", 2), ("b", "b", 1), ("a", "c", 1), ("a", "gone", 1), (None, "a", 1)] + [("b", "a", 1)] * 5
    r = enc.pair_similarity(spark.createDataFrame(pairs, "word string, context string, offset int"),
                            spark.createDataFrame(list(vec.items()), "word string, vector array<double>")).first()
    assert r.pairs == 9 and np.isclose(r.mean_pair_similarity, (7 * 0.5 ** 0.5 + 1) / 8)


def test_similar_words_brute_force(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(40, 6))
    vec = spark.createDataFrame([(f"w{i}", X[i].tolist()) for i in range(40)], "word string, vector array<double>")
    probe = vec.where(F.col("word").isin("w3", "w7"))
    got = {(r["probe"], r["rank"]): r["neighbour"] for r in enc.similar_words(probe, vec, k=3).collect()}
    Xn = X / np.linalg.norm(X, axis=1, keepdims=True)
    for p in (3, 7):
        sim = Xn @ Xn[p]
        sim[p] = -np.inf
        best = np.argsort(-sim)[:3]
        assert [got[(f"w{p}", r + 1)] for r in range(3)] == [f"w{i}" for i in best]


def test_sequence_sentences_are_chunked_in_order(spark):
    rows = [("s", 0, i, f"w{i}") for i in range(25)] + [("t", 1, i, f"v{i}") for i in range(3)]
    lines = spark.createDataFrame(rows, "source string, doc_id long, line_no long, template string")
    got = enc.sequence_sentences(lines, ["source"], ["doc_id", "line_no"], max_len=10).orderBy("source", "__chunk").collect()
    assert [len(r["sentence"]) for r in got] == [10, 10, 5, 3]
    assert got[1]["sentence"][0] == "w10" and got[3]["sentence"] == ["v0", "v1", "v2"]


def test_neighbours_across_a_cut_are_counted_once(spark):
    rows = [("s", i // 9, i, f"w{i % 6}") for i in range(47)] + [("t", 1, i, f"w{i % 4}") for i in range(20)] + [(None, 2, i, "w1") for i in range(3)]
    lines = spark.createDataFrame(rows, "source string, doc_id long, line_no long, template string")
    whole = enc.sequence_sentences(lines, ["source"], ["doc_id", "line_no"], window=4)
    want = sorted(map(tuple, enc.cooccurrence_counts(whole, 4).collect()))
    vectors = {r.word: r.vector for r in enc.cooccurrence_vectors(whole, 4, 4, 1).collect()}
    for max_len in (4, 5, 10, 20):
        cut = enc.sequence_sentences(lines, ["source"], ["doc_id", "line_no"], max_len=max_len, window=4)
        assert sorted(map(tuple, enc.cooccurrence_counts(cut, 4).collect())) == want
    assert {r.word: r.vector for r in enc.cooccurrence_vectors(cut, 4, 4, 1).collect()} == vectors
    with pytest.raises(ValueError):
        enc.sequence_sentences(lines, ["source"], ["doc_id", "line_no"], max_len=3, window=4)


def test_vectors_in_place_equal_the_vectors_by_pairs(spark, monkeypatch):
    """Sums inside the sentences give the vectors that counted pairs give, and no pair is shuffled."""
    rows = [(["a", "b", "a", "", "c", "b", "d", "a", "e"],), (["x"],), ([],), (None,), (["a", None, "b"],), ([None],), (["é", "b"] * 9,)]
    sents = spark.createDataFrame(rows, "sentence array<string>")
    monkeypatch.setattr(enc, "LINES_AT_ONCE", 4)
    got = enc.cooccurrence_vectors(sents, dim=3, window=2)
    want = enc.cooccurrence_vectors(sents.withColumn("after", F.lit(None).cast("array<string>")), dim=3, window=2)
    as_dict = lambda df: {r["word"]: r["vector"] for r in df.collect()}
    assert as_dict(got) == as_dict(want) and len(as_dict(got)) == 9
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1 and "Join" not in got._jdf.queryExecution().toString()


def test_counts_and_vectors_of_one_written_join(spark):
    """Templates without a vector are filled, words without a count stay in the vector table, null keys meet nothing."""
    counts = spark.createDataFrame([("a", 3), ("new", 1), (None, 2)], "template string, n long")
    vectors = spark.createDataFrame([("a", [1.0, 2.0]), ("far", [3.0, 4.0]), (None, [5.0, 6.0])], "word string, vector array<double>")
    encoded, known = enc.encode_counts(counts, vectors, dim=2)
    want = enc.encode(counts, vectors, "template", "vector", 2)
    key = lambda r: str(r)
    assert sorted(map(tuple, encoded.select("template", "n", "vector").collect()), key=key) == sorted(
        map(tuple, want.select("template", "n", "vector").collect()), key=key)
    assert sorted(map(tuple, known.collect()), key=key) == sorted(map(tuple, vectors.collect()), key=key)


def test_pair_counts_travel_once_per_word(spark, monkeypatch):
    """Frequent words dealt out, few lines at once, nulls, empty and one-word sentences: as by every pair; rows shuffled are words, not pairs."""
    sents = [[f"w{(i * j) % 23}" if j % 3 else "hot" for j in range(i % 40)] for i in range(60)] + [None, [], ["hot"], ["x", None, "y"]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sents)], "doc_id long, sentence array<string>")
    want = collections.Counter((s[i], s[j]) for s in sents if s for i in range(len(s)) for j in range(i + 1, min(len(s), i + 5)))
    for lines in (1, 64, 1 << 16):
        monkeypatch.setattr(enc, "LINES_AT_ONCE", lines)
        got = enc.cooccurrence_counts(df, 4).collect()
        assert {(r.word, r.context): r.n for r in got} == want and len(got) == len(want)
    flat = pa.array([s for s in sents if s])
    rows = enc._pair_counts(flat, flat.value_lengths().to_numpy(), 4, {"hot"}).to_pylist()
    grouped = collections.Counter(r["word"] for r in rows)
    assert 1 < grouped.pop("hot") <= enc.HOT_PARTS and set(grouped.values()) == {1}
    assert {(r["word"], c): n for r in rows for c, n in zip(r["contexts"], r["counts"])} == want
