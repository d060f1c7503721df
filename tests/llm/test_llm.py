"""Operators against brute force on small tables, and defined results for odd rows."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from outlog.llm import ann, bpe, common, langid, lm, minhash, mixing, quality, queries, sharding, suffix, url_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.fixture(scope="module")
def docs(spark, sf_small):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, blank and very long texts, repeated rows, and columns with clashing names."""
    same = "the same line of words again and again, " * 6
    rows = [(None, None, None, None), (None, "no id here but enough words to count as one text", "en", "a"), (1, None, "en", None),
            (2, "", None, "a"), (3, " \n\t", "de", "a"), (4, "12 345 !!", "en", "b"), (5, LONG, "en", "b"),
            (6, same, "en", None), (6, same, "en", None), (7, same, "de", "b"), (8, "Ünd größer über, STRASSE", "de", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in ("n", "size", "block", "row", "id", "h", "kept", "shard", "ids", "score", "train", "spans", "u", "v", "_src", "bucket"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")


def near_truth(texts, width):
    sets = {}
    for k, t in texts.items():
        w = WORD.findall(lower(t))
        sets[k] = set(zip(*(w[i:] for i in range(width)))) if len(w) >= width else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), top(k), top(k) == k) for k in sets}


def cut_truth(texts):
    seen, out = set(), {}
    for k in sorted(texts):
        raw = (texts[k] or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            w = raw[i:i + 100]
            if w in seen:
                gone[i:i + 100] = True
            seen.add(w)
        left = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(raw) else 0
        out[k] = (len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


def test_url_rules(spark, sf_small):
    urls = ["http://A.Example.NET/en/x?q", "https://x.example.net/de/1", "http://example.com/de/", "http://example.com/en/?a=1#f", "x.org/fr/",
            "http://b.org/fr/2", None, "", "://", "http://net/a", "http://h.net?x"]
    rule, verdict = url_rules.apply_rules(F.col("host"), F.col("path"), queries.URL_RULES)
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(
        "url", url_rules.host_of(F.col("url")).alias("host"), url_rules.path_of(F.col("url")).alias("path"))
    got = {r[0]: tuple(r)[1:] for r in df.select("url", "host", "path", rule, verdict).collect()}
    assert got["http://A.Example.NET/en/x?q"] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got["https://x.example.net/de/1"] == ("x.example.net", "/de/1", "net/", "block")
    assert got["http://example.com/de/"][2:] == ("example.com/de/", "block")
    assert got["http://example.com/en/?a=1#f"] == ("example.com", "/en/", None, None)
    assert got["http://b.org/fr/2"][2:] == ("org/fr/", "allow")
    assert got[None] == got["x.org/fr/"] == ("", "", None, None)
    assert got["http://net/a"][2] == "net/" and got["http://h.net?x"] == ("h.net", "", None, None)
    out = queries.op1_url_filters(spark, sf_small)
    assert out.count() == spark.read.parquet(f"{sf_small}/pages.parquet").count()


def rule_truth(rows, min_bad, min_confidence, min_sigma):
    """Minimal rules over the tokens that stand for all that share their pages: {tokens: (confidence, support)}."""
    rows = [(frozenset(t), b) for t, b in rows if b is not None]
    total, bad = len(rows), sum(b for _, b in rows)
    pages = {}
    for t in sorted({x for s, _ in rows for x in s}):
        pages.setdefault(frozenset(i for i, (s, _) in enumerate(rows) if t in s), t)
    kept, passing = set(pages.values()), {}
    for s, _ in {r for r in rows if r[1]}:
        for size in range(1, len(s & kept) + 1):
            for need in itertools.combinations(sorted(s & kept), size):
                hold = [b for t, b in rows if t >= set(need)]
                n, k = len(hold), sum(hold)
                if k >= min_bad and k / n >= min_confidence and k * total - n * bad >= min_sigma * math.sqrt(n * bad * (total - bad)):
                    passing[need] = (k / n, k / total)
    return {r: v for r, v in passing.items() if not any(set(o) < set(r) for o in passing)}


def test_mined_rules_and_inverted_index(spark):
    rows = [(["h:spam", "p:win"], True)] * 9 + [(["h:spam", "p:a"], False)] * 3 + [(["h:ok"], False)] * 20 + [(["h:ok"], None)]
    df = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    rules = url_rules.mine_rules(df, 2, 0.7)
    assert {r.rule: round(r.confidence, 2) for r in rules.collect()} == {"p:win": 1.0, "h:spam": 0.75}
    hit = {tuple(r.tokens): r.mined_rule for r in url_rules.match_rules(df, rules).collect()}
    assert hit == {("h:spam", "p:win"): "p:win", ("h:spam", "p:a"): "h:spam"}
    assert url_rules.mine_rules(df.where("false")).count() == 0


def test_rules_of_any_length_and_of_rare_hosts(spark):
    four = ["a", "b", "c", "d"]
    rows = [(four, True)] * 12 + [([x for x in four if x != y], False) for y in four for _ in range(12)]
    rows += [(["h:rare", "p:x"], True)] * 5 + [(["h:big", f"p:{i % 7}"], False) for i in range(3000)]
    df = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    rules = {r.rule: r.confidence for r in url_rules.mine_rules(df).collect()}
    assert rules == {"a b c d": 1.0, "h:rare": 1.0}  # five pages of 3,065; p:x stands where h:rare does


def test_mined_rules_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(260):
        t = [x for x in "abcdefg" if rng.random() < 0.45]
        bad = ({"a", "b", "c"} <= set(t) or {"d", "g"} <= set(t)) and rng.random() < 0.85 or rng.random() < 0.1
        rows.append((t + (["twin"] if "e" in t else []), bool(bad)))
    rows += [(["a"], None), ([], True), ([], False)]
    df = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    for args in ((4, 0.6, 1.96), (2, 0.5, 0.0), (1, 1.0, 1.0)):
        got = {tuple(r.tokens): (r.confidence, r.support) for r in url_rules.mine_rules(df, *args).collect()}
        assert got == rule_truth(rows, *args) and got


def test_url_filters_on_odd_rows(spark, tmp_path):
    url = "http://bad.example/x/" + "long/" * 3000
    pages = [(None, None), (1, None), (2, ""), (3, url), (3, url), (4, url + "?a=1"), (5, "http://good.example/"), (6, "http://bad.example/y")]
    extra = "page_id long, url string, tokens string, host string, rule string, mined_rule string, bad string"
    spark.createDataFrame([(*p, "x", "x", "x", "x", "x") for p in pages], extra).write.parquet(f"{tmp_path}/pages.parquet")
    labels = [(3, 0, None, "x"), (3, 0, 0, "x"), (4, 0, 1, "x"), (6, None, None, "x"), (None, 0, 1, "x")] + [(5, 1, 0, "x")] * 20
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, url string").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted((r.page_id or 0, r.host, r.verdict) for r in queries.op1_url_filters(spark, str(tmp_path)).collect())
    # labelled rows are 3 (twice by two labels) and 4, all bad, and 5 (twenty good labels)
    assert got == [(0, "", "allow"), (1, "", "allow"), (2, "", "allow"), (3, "bad.example", "block"), (3, "bad.example", "block"),
                   (4, "bad.example", "block"), (5, "good.example", "allow"), (6, "bad.example", "block")]
    for name in ("pages", "labels"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert queries.op1_url_filters(spark, f"{tmp_path}/none").count() == 0


def test_ann_recall_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 24))
    x[100:160] = x[40]  # one very common vector
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] + [1.0] * 23), (5060, [None] + [1.0] * 23), (None, [1.0] * 24), (5080, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.neighbours(df, lambda i: i % 20 == 0, "vec_id", "embedding", 20).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 20))
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(3000), -np.round(s, 9)))[:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(abs(s[f[1]] - f[2]) < 1e-9 for f in found)
        assert [(-round(f[2], 9), f[1]) for f in found] == sorted((-round(f[2], 9), f[1]) for f in found)
        hit += len(set(best) & {f[1] for f in found})
    assert hit / (20 * len(got)) >= 0.9
    few = ann.neighbours(df.where("vec_id < 5"), lambda i: i % 20 == 0, "vec_id", "embedding", 20)
    assert few.count() == 4
    assert ann.neighbours(df.where("false"), lambda i: i % 20 == 0, "vec_id", "embedding", 20).count() == 0


def test_permutation_and_draws():
    for n in (1, 2, 3, 5, 64, 1000):
        p = mixing.permute(np.arange(n), np.full(n, n), np.full(n, 77))
        assert sorted(p) == list(range(n))
    c = mixing.draw_counts([1000, 10, 0, 377], 16, 3)
    assert c.sum(axis=0).tolist() == [1000, 10, 0, 377] and (c >= 0).all()
    assert mixing.share([10, 10, 80], [5, 2, 1]) == [30.0, 30.0, 40.0]


def test_mixing(spark, sf_small, odd, nothing, docs):
    out = queries.op3_mixing(spark, sf_small).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    by = collections.defaultdict(list)
    for r in out:
        assert r["size"] == len(WORD.findall(docs[r.doc_id].text or "")) and 0 <= r.taken <= 3 * r["size"]
        by[docs[r.doc_id].source].append(r)
    for rows in by.values():
        assert rows[0].source_size == sum(r["size"] for r in rows)
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 2 * mixing.BLOCK_WORDS
    assert abs(sum(rows[0].target for rows in by.values()) - sum(r["size"] for r in out)) < 1e-6
    assert all(sum(x.words for x in r.shards or []) == r.taken for r in out)
    clash = odd.withColumn("_words", F.lit(999)).withColumn("_n", F.lit("mine")).withColumn("_size", F.lit(7))
    numbers = mixing.numbered(clash)
    placed = mixing.streams(numbers)
    mix = mixing.draw(placed)
    assert mix.keys == ["=a", "=b", "=c", "-"]
    assert mixing.taken_words(numbers, placed, mix).count() == odd.count()
    rows = mixing.mixed_rows(numbers, placed, mix)
    assert rows.columns == clash.columns
    got = rows.collect()
    taken = mixing.taken_words(numbers, placed, mix).agg(F.sum("taken")).first()[0]
    assert sum(len(WORD.findall(r.text)) for r in got) == taken and all(r["_n"] == "mine" and r["_size"] == 7 for r in got)
    no_rows = mixing.numbered(nothing)
    empty = mixing.streams(no_rows)
    assert mixing.taken_words(no_rows, empty, mixing.draw(empty)).count() == 0 == mixing.mixed_rows(no_rows, empty, mixing.draw(empty)).count()


def test_mixing_follows_the_drawn_counts_of_the_shards(spark, sf_small):
    """Words per shard are those of the slots that the shard's multinomial draw gave each source."""
    rows = mixing.numbered(spark.read.parquet(f"{sf_small}/documents.parquet"), keep_text=False)
    placed = mixing.streams(rows)
    shards = {}
    for seed in (29, 30):
        mix = mixing.draw(placed, n_shards=4, seed=seed)
        got = mixing.taken_words(rows, placed, mix)
        each = got.select("_row.source", F.explode("shards").alias("s")).groupBy("source", "s.shard").agg(F.sum("s.words").alias("w"))
        shards[seed] = {(r.source, r.shard): r.w for r in each.collect()}
        for (source, shard), w in shards[seed].items():
            slots = int(mix.counts[shard, mix.keys.index(f"={source}")])
            # the last block of a stream is short, and in each epoch one slot holds it
            assert (slots - mixing.MAX_EPOCHS) * mixing.BLOCK_WORDS < w <= slots * mixing.BLOCK_WORDS
    assert shards[29] != shards[30]


def test_bpe_against_the_library(spark, sf_small, odd, nothing, docs):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(bpe.default_path())
    for r in queries.op4_bpe(spark, sf_small).collect():
        ids = tok.encode(docs[r.doc_id].text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    texts = ["!" * 999, "aaab" * 300, "ΑΣ σΣ İ ẞ é é", "<|endoftext|>x<|startoftext|><|ENDOFTEXT|>", "it's 12½ ² don't", "\x1c\x85　 ​", "\0\0the"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    both = bpe.decode(bpe.encode(df)).orderBy("doc_id").collect()
    for t, r in zip(texts, both):
        ids = tok.encode(t, add_special_tokens=False).ids
        assert (r.ids, r.decoded) == (ids, tok.decode(ids, skip_special_tokens=False)), t
    out = bpe.encode(odd).collect()
    assert all(r.ids == [] for r in out if not (r.text or "").strip()) and len(out) == odd.count()
    assert bpe.decode(bpe.encode(nothing)).count() == 0


def test_near_duplicates(spark, sf_small, odd, nothing, docs):
    truth = near_truth({k: r.text for k, r in docs.items()}, 2)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op5_minhash(spark, sf_small).collect()}
    assert got == truth
    rows = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect()]
    assert len(rows) == odd.count()
    assert {r for r in rows if r[0] in (1, 2, 3)} == {(i, 0, i, True) for i in (1, 2, 3)}
    assert [r[2:] for r in rows if r[0] == 6] == [(6, True)] * 2 and [r[2:] for r in rows if r[0] == 7] == [(6, False)]
    assert minhash.near_duplicates(nothing).count() == 0


def test_near_duplicates_of_a_chain_of_edits(spark):
    """A large group whose members mostly resemble only some of the others."""
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(60)]
    texts, cur = {}, list(base)
    for k in range(150):
        texts[k] = " ".join(cur)
        cur = list(cur if k % 7 else base)
        cur[int(rng.integers(60))] = f"n{k}"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, width=2).collect()}
    assert got == {k: v[1] for k, v in near_truth(texts, 2).items()}


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (9, 10), (20, 21), (21, 22), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.root for r in minhash.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {got[x] for x in (1, 2, 3, 9, 10)} == {1} and {got[x] for x in (20, 21, 22)} == {20}
    assert {got[x] for x in range(100, 141)} == {100}


@pytest.mark.parametrize("seed", [0, 1])
def test_ann_finds_all_neighbours_of_rare_directions(spark, seed):
    rng = np.random.default_rng(seed)
    big, small = rng.standard_normal((2, 16)) * 5, rng.standard_normal((4, 16)) * 5
    x = np.concatenate([np.repeat(small, 6, axis=0), np.repeat(big, 750, axis=0)]) + rng.standard_normal((1524, 16)) * 0.05
    ids = np.append(np.arange(24) * 20, 1000 + np.arange(1500) * 20 + 1)  # the rare ones ask
    df = spark.createDataFrame([(int(i), v.tolist(), "x", 1.0) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, cid string, score double")
    got = collections.defaultdict(set)
    for r in ann.neighbours(df.unionByName(df.limit(30)), lambda i: i % 20 == 0, "vec_id", "embedding", 20).collect():
        got[r.query_id].add(r.vec_id)
    assert len(got) == 24 and all(len(f) == 20 for f in got.values())
    recall = []
    for q in range(24):
        s = x @ x[q]
        s[q] = -np.inf
        recall.append(len(got[q * 20] & set(ids[np.argsort(-s)[:20]].tolist())) / 20)
    assert np.mean(recall) >= 0.9


def test_ann_huge_and_tiny_components(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 0.0]), (2, [1e200, 2e200]), (20, [1e-200, 0.0]), (40, [1e-100, 3e-100])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in sorted(ann.neighbours(df, lambda i: i % 20 == 0, "vec_id", "embedding", 20).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, r.score))
    assert {q: {i for i, _ in f} for q, f in got.items()} == {q: {0, 1, 2, 20, 40} - {q} for q in (0, 20, 40)}
    assert [i for i, _ in got[40][:3]] == [2, 0, 1] and got[0][0] == (1, float("inf"))  # two overflow: the smaller id


def test_quality(spark, sf_small, odd, nothing, docs):
    def brute(t):
        w = WORD.findall(t or "")
        at = collections.defaultdict(list)
        for i in range(len(w) - 4):
            at[tuple(w[i:i + 5])].append(i)
        cover = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover)

    out = queries.op6_quality(spark, sf_small).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    for r in out:
        b = brute(docs[r.doc_id].text)
        assert tuple(r[1:6]) == b
        assert r.base_failed == (b[0] < 10 or 100 * b[4] > 20 * b[0]) and not (r.base_failed and r.kept)
    m = quality.measure(odd.select("doc_id", "text"))
    for r in m.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text)
    order = quality.order_rules(odd, quality.default_rules())
    assert sorted(r.name for r, _, _ in order) == sorted(r.name for r in quality.default_rules())
    one = quality.cascade(m, [r for r, _, _ in order]).select("rejected_by").collect()
    two = quality.cascade(m, quality.default_rules()).select("rejected_by").collect()
    assert [a[0] is None for a in one] == [b[0] is None for b in two]
    assert len(quality.order_rules(nothing, quality.default_rules())) == len(order)


def test_sharding(spark, sf_small, odd, nothing, docs):
    out = queries.op7_sharding(spark, sf_small).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    slots = collections.defaultdict(list)
    mixture = collections.defaultdict(collections.Counter)
    for r in out:
        raw = (docs[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))
        slots[r.shard].append(r.slot)
        mixture[r.shard][docs[r.doc_id].source] += 1
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(abs(m[s] - 10 / 24) <= 2 for m in mixture.values() for s in m)
    assert sharding.interleave(odd, 3).count() == odd.count() and sharding.interleave(nothing, 3).count() == 0
    small = sharding.interleave(odd, 4, bucket_rows=2).collect()
    assert sorted(collections.Counter(r.shard for r in small).values()) == [2, 3, 3, 3]


def test_language_id(spark, sf_small, odd, nothing, docs):
    out = queries.op8_language_id(spark, sf_small).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.95 * len(held)
    crf = langid.fit(spark.read.parquet(f"{sf_small}/documents.parquet"))
    rows = langid.predict(odd, crf, words_col="words").collect()
    assert len(rows) == odd.count() and all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (1, 2, 3, 4))
    mixed = spark.createDataFrame([(1, docs[1].text[:300] + " " + docs[0].text[:300])], "doc_id long, text string")
    tags = langid.predict(mixed, crf, words_col="words").first().words
    assert collections.Counter(tags[:20]).most_common(1)[0][0] == docs[1].lang
    assert collections.Counter(tags[-20:]).most_common(1)[0][0] == docs[0].lang
    none = langid.fit(nothing)
    assert none.labels == [] and {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}


def test_language_id_reads_whole_runs(spark):
    run = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(1000))
    grams = collections.Counter()
    for p in langid.pieces(run):
        grams.update(langid.word_features(*p))
    edged = f"^{run}$"
    want = collections.Counter(zlib.crc32(f"{n}{edged[i:i + n]}".encode()) % langid.FEATURES
                               for n in (2, 3) for i in range(len(edged) - n + 1))
    ends = collections.Counter(zlib.crc32(f.encode()) % langid.FEATURES
                               for k in (1, 2, 3, 4) for f in (f"p{run[:k]}", f"s{run[-k:]}"))
    whole = collections.Counter(zlib.crc32(f"w{p[0]}".encode()) % langid.FEATURES for p in langid.pieces(run))
    assert "".join(p[0] for p in langid.pieces(run)) == run and grams == want + ends + whole
    # a shared start of 60 letters, then 300 letters that tell the languages apart
    rng = np.random.default_rng(4)

    def text(letters):
        return "nm" * 30 + "".join(rng.choice(list(letters), 300))

    rows = [(i, text("abcdef") if i % 2 else text("uvwxyz"), "x" if i % 2 else "y") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.predict(df, langid.fit(df.where("doc_id < 40")), words_col="words").where("doc_id >= 40").collect()
    assert all(r.lang_pred == r.lang and r.words == [r.lang] for r in out)


def test_language_id_learns_rare_languages_and_long_texts(spark):
    rng = np.random.default_rng(6)

    def text(letters, n):
        return " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))

    rows = [(i, text("abcdef", 6), "common") for i in range(4000)] + [(4000 + i, text("uvwxyz", 6), "rare") for i in range(2)]
    rows += [(5000 + i, text("mnopqr", 4000), "long") for i in range(3)]
    rows += [(None, text("ghijkl", 6), "no id") for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    crf = langid.fit(df)
    assert crf.labels == ["common", "long", "no id", "rare"]
    new = [(i, text(a, 8), l) for i, (a, l) in enumerate([("abcdef", "common"), ("uvwxyz", "rare"), ("mnopqr", "long"), ("ghijkl", "no id")] * 5)]
    out = langid.predict(spark.createDataFrame(new, "doc_id long, text string, lang string"), crf).collect()
    assert all(r.lang_pred == r.lang for r in out)


def test_language_id_learns_starts_switches_and_lexicons(spark):
    """Words whose letters tell nothing: only the lexicons and neighbours can; texts that switch twice."""
    rng = np.random.default_rng(12)
    vocab = {l: ["".join(rng.choice(list("abcd"), 6)) for _ in range(120)] for l in "xyz"}
    text = lambda l, n: " ".join(rng.choice(vocab[l], n))
    rows = [(100 * k + i, text(l, n), l) for k, (l, n) in enumerate((("x", 200), ("y", 40), ("z", 40))) for i in range(60)]
    crf = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    count = collections.Counter((w, l) for _, t, l in rows for w in set(t.split()))
    assert crf.lexicon == {w: sorted(l for l in "xyz" if count[w, l] >= 3) for w in {w for (w, _), n in count.items() if n >= 3}}
    assert abs(crf.start).min() > 0
    emit = lambda label: crf.emit[zlib.crc32(f"l{label}".encode()) % langid.FEATURES]
    assert all(emit(l).argmax() == i for i, l in enumerate("xyz"))
    assert all(crf.move[i, i] > max(np.delete(crf.move[i], i)) for i in range(3)) and crf.move.min() > -6
    new = [(i, " ".join([text("x", 12), text("y", 12), text("z", 12)]), None) for i in range(20)]
    out = langid.predict(spark.createDataFrame(new, "doc_id long, text string, lang string"), crf, words_col="words").collect()
    right = [a == b for r in out for a, b in zip(r.words, ["x"] * 12 + ["y"] * 12 + ["z"] * 12)]
    assert np.mean(right) >= 0.97


def test_forward_backward_against_enumeration():
    import itertools
    rng = np.random.default_rng(2)
    score, move, start = rng.standard_normal((4, 3)), rng.standard_normal((3, 3)), rng.standard_normal(3)
    want, total = np.zeros((4, 3)), 0.0
    for path in itertools.product(range(3), repeat=4):
        p = math.exp(start[path[0]] + sum(score[i, s] for i, s in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        total += p
        for i, s in enumerate(path):
            want[i, s] += p
    both = np.concatenate([score, score[:1]])
    got = langid.posteriors(both, np.array([4, 1]), move, start)
    assert np.allclose(got[:4], want / total)


def test_lm_scores(spark, sf_small, odd, nothing, docs):
    pieces, logs, byte_logs, end = lm.load_pieces()
    table = dict(zip(pieces, logs))
    assert abs(sum(map(math.exp, logs)) + sum(map(math.exp, byte_logs)) + math.exp(end) - 1) < 1e-6
    memo = {}

    def marginal(w):
        if w not in memo:
            s = "▁" + w
            a = [0.0] + [-math.inf] * len(s)
            for j in range(1, len(s) + 1):
                xs = [a[i] + table[s[i:j]] for i in range(max(0, j - 16), j) if s[i:j] in table]
                if s[j - 1] not in table:
                    xs.append(a[j - 1] + byte_logs[0] * len(s[j - 1].encode()))
                a[j] = max(xs) + math.log(sum(math.exp(x - max(xs)) for x in xs))
            memo[w] = a[-1]
        return memo[w]

    toks = {k: [*WORD.findall(lower(r.text)), None] for k, r in docs.items()}
    count = collections.Counter(t for k, ts in toks.items() if zlib.crc32(str(k).encode()) % 10 for t in ts)
    n, v = sum(count.values()), len(count)
    for r in queries.op9_lm_score(spark, sf_small).collect():
        ts = toks[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(count[t] > 0 for t in ts), n)
        assert math.isclose(r.base_score, sum(math.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts), rel_tol=1e-9)
        assert math.isclose(r.score, (sum(marginal(t) for t in ts if t is not None) + end) / math.log(10), rel_tol=1e-9)
    rows = lm.score(odd, F.lit(True)).collect()
    assert len(rows) == odd.count() and all(r.n_tokens == 1 for r in rows if r.doc_id in (1, 2, 3))
    assert lm.score(nothing, F.lit(True)).count() == 0


def test_pipeline_workers(spark, odd):
    """The last stage has one Python worker a task; a pass gives its memory back at its end, ended early or not."""
    import corpus_pipeline as cp
    import pyarrow as pa

    both = cp.encode(spark, odd, "")
    assert both._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    assert sorted(map(repr, both.collect())) == sorted(map(repr, bpe.decode(bpe.encode(odd)).collect()))
    ended = []

    def twice(batches):
        kept = pa.array(np.arange(1 << 20))
        try:
            for b in batches:
                yield b
                yield b
        finally:
            ended.append(len(kept))

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["x"])
    assert [b.num_rows for b in common.gives_back(twice)(iter([batch, batch]))] == [2] * 4
    some = common.gives_back(twice)(iter([batch]))
    next(some)
    some.close()
    assert ended == [1 << 20] * 2


def test_lm_score_learns_from_training_rows(spark):
    """The score against EM and the discounted counts taken word by word; held-out rows come near ``base_score``."""
    rng = np.random.default_rng(3)
    known, seen = ["the", "ntion", "heble", "eathwh", "日本", "日本語", "é|", "rerea"], ["".join(rng.choice(["th", "eng", "wh", "on", "日"], 3)) for _ in range(60)]
    texts = [" ".join(rng.choice([*known * 8, *seen], 40)) + "\n" + "".join(rng.choice(["th", "eng", "on"], 4)) for _ in range(60)]
    texts += [None, " \n", "Æ😀" * 40 + " x" * 3, "wh" * 4000]
    df = spark.createDataFrame([(i, t, i % 10 != 0) for i, t in enumerate(texts)], "doc_id long, text string, train boolean")
    toks = {i: WORD.findall(lower(t)) if t else [] for i, t in enumerate(texts)}
    count = collections.Counter(w for i, ws in toks.items() if i % 10 for w in ws)
    ends = sum(i % 10 != 0 for i in toks)
    n, v = sum(count.values()) + ends, len(count) + 1
    pieces, logs, byte_logs, _ = lm.load_pieces()
    number = {p: k for k, p in enumerate(pieces)}
    first = np.append(np.exp(logs), 256 * math.exp(byte_logs[0]))
    first /= first.sum()

    def sums(w, p):
        """log of the word's marginal, and how often it uses each piece (the last: bytes)."""
        s = "▁" + w
        into = [[(i, number[s[i:j]], 1) for i in range(max(0, j - 16), j) if s[i:j] in number] for j in range(len(s) + 1)]
        for j, c in enumerate(s, 1):
            if c not in number:
                into[j].append((j - 1, len(pieces), len(c.encode())))
        weight = lambda k, m: (math.log(p[-1] / 256) * m if k == len(pieces) else math.log(p[k]))
        a, b = [0.0] + [-math.inf] * len(s), [-math.inf] * len(s) + [0.0]
        for j in range(1, len(s) + 1):
            a[j] = np.logaddexp.reduce([a[i] + weight(k, m) for i, k, m in into[j]])
        for j in range(len(s), 0, -1):
            for i, k, m in into[j]:
                b[i] = np.logaddexp(b[i], b[j] + weight(k, m))
        return a[-1], [(k, m * math.exp(a[i] + weight(k, m) + b[j] - a[-1])) for j in range(1, len(s) + 1) for i, k, m in into[j]]

    p = first
    for _ in range(lm.ROUNDS):
        uses = first * len(first)
        for w in count:
            for k, x in sums(w, p)[1]:
                uses[k] += x
        p = uses / uses.sum()
    once, twice = (sum(c == k for c in count.values()) for k in (1, 2))
    d = (once + 1) / (once + 2 * twice + 2)
    memo = {}

    def of(w):
        if w not in memo:
            spelt = sums(w, p)[0] + math.log(d * v / n)
            memo[w] = np.logaddexp(math.log((count[w] - d) / n), spelt) if count[w] else spelt
        return memo[w]

    rows = lm.score(df, F.col("train")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = (sum(of(w) for w in toks[r.doc_id]) + math.log((ends - d) / n)) / math.log(10)
        assert math.isclose(r.score, want, rel_tol=1e-9), r.doc_id
    held = [r for r in rows if not r.train and r.doc_id < 60]
    assert held and all(math.isfinite(r.score) and r.score > 1.2 * r.base_score for r in held)
    untrained = {r.doc_id: r.score for r in lm.score(df, F.lit(False)).collect()}
    assert all(map(math.isfinite, untrained.values()))


def test_suffix_dedup(spark, sf_small, odd, nothing, docs, monkeypatch):
    truth = cut_truth({k: r.text for k, r in docs.items()})
    got = {r.doc_id: tuple(r[1:]) for r in queries.op10_suffix_dedup(spark, sf_small).collect()}
    assert got == truth
    rows = suffix.remove_repeats(odd).collect()
    assert len(rows) == odd.count() and set(odd.columns) <= set(rows[0].asDict())
    six, seven = [r for r in rows if r.doc_id == 6], [r for r in rows if r.doc_id == 7]
    assert six[0].n_removed == six[1].n_removed > 0 and seven[0].text == "" and seven[0].n_removed == seven[0].n_bytes
    assert suffix.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("hot", [4096, 0])
def test_suffix_dedup_of_overlaps_runs_and_hot_anchors(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "SEGMENT", 700)
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 3000)
    rng = np.random.default_rng(3)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    line, texts = word(130), {}
    for k in range(40):
        texts[k] = word(int(rng.integers(0, 90))) + line + word(50) + line[20:125] + ("z" * 230 if k % 5 == 0 else "") + (line * 3 if k % 9 == 0 else "")
    texts[40] = texts[3]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    out = suffix.remove_repeats(df, keep_text=False)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out.collect()} == cut_truth(texts)


def test_helpers(spark):
    df = spark.createDataFrame([("A\x1cb \x0b c D\n",), (None,)], "t string")
    assert [r[0] for r in df.select(common.words(F.col("t"))).collect()] == [["A\x1cb", "c D"], []]
    assert common.spread(np.array([3, 10]), np.array([2, 3])).tolist() == [3, 4, 10, 11, 12]


def test_pipeline_stages(spark, sf_small, docs):
    import corpus_pipeline as cp
    rows = spark.read.parquet(f"{sf_small}/documents.parquet")
    kept = cp.language_id(spark, rows, sf_small)
    assert kept.columns == rows.columns and kept.count() == rows.count()
    truth = near_truth({k: r.text for k, r in docs.items()}, 5)
    one = cp.near_dedup(spark, rows, sf_small)
    assert sorted(r.doc_id for r in one.collect()) == sorted(k for k, t in truth.items() if t[2])
    cut = cp.suffix_dedup(spark, one, sf_small)
    whole = {k: docs[k].text for k, t in truth.items() if t[2]}
    want = cut_truth(whole)
    got = {r.doc_id: r.text for r in cut.collect()}
    assert all(len(want_text := got[k].encode()) <= want[k][0] - want[k][1] and (want[k][1] or got[k] == whole[k]) for k in got) and want_text is not None
    assert set(whole) - set(got) <= {k for k in whole if want[k][1]}
    assert cp.mix_sources(spark, cut, sf_small).columns == rows.columns
    final = cp.run(spark, sf_small)
    assert final.where(F.size("ids") == 0).count() == 0 and final.count() > 0


def test_near_dedup_stage_with_repeated_and_missing_ids(spark):
    """Copies go whatever their ids; blank texts stay; columns come back as they were."""
    import corpus_pipeline as cp
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, a), (1, a + " more"), (2, a), (None, b), (None, b), (3, b), (None, None), (4, ""), (4, ""), (None, "c d e f g h i j")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("n", "row", "id", "kept", "size", "component_id", "_hot"):
        df = df.withColumn(c, F.lit("mine"))
    got = cp.near_dedup(spark, df, "")
    assert got.columns == df.columns
    left = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    firsts = [r for r in left if r[0] == 1]
    assert len(firsts) == 1 and sorted((r for r in left if r[0] != 1), key=str) == sorted(
        [(3, b), (None, None), (4, ""), (4, ""), (None, "c d e f g h i j")], key=str)
    assert cp.near_dedup(spark, df.where("false"), "").count() == 0


def test_pipeline_keeps_texts_in_several_languages(spark, sf_small, docs):
    import corpus_pipeline as cp
    rows = spark.read.parquet(f"{sf_small}/documents.parquet")
    by_lang = collections.defaultdict(list)
    for r in sorted(docs.values()):
        by_lang[r.lang].append(" ".join(r.text.split()[:40]))
    firsts = [t[0] for _, t in sorted(by_lang.items())]
    mixed = [" ".join(firsts[:2]), " ".join(firsts[1:3]), " ".join(firsts[:3]), " ".join(firsts),
             " ".join(w for ws in zip(*(t.split() for t in firsts)) for w in ws)]
    bad = ["", "12 345 !!", " \n\t"]
    new = [(-1 - i, t, None) for i, t in enumerate([*mixed, *bad])]
    more = rows.unionByName(spark.createDataFrame(new, "doc_id long, text string, lang string"), allowMissingColumns=True)
    kept = {r.doc_id for r in cp.language_id(spark, more, sf_small).collect()}
    assert kept == set(docs) | {-1 - i for i in range(len(mixed))}
    # words that both languages share, and rows whose languages are not known at all
    shared = [(i, "hotel taxi radio", "de" if i % 2 else "fr") for i in range(40)]
    df = spark.createDataFrame(shared, "doc_id long, text string, lang string")
    assert cp.language_id(spark, df, sf_small).count() == 40
    for odd in (more.withColumn("lang", F.lit(None).cast("string")),
                more.withColumn("lang", F.when(F.col("text").isin(bad), F.col("doc_id").cast("string")))):
        got = cp.language_id(spark, odd, sf_small)
        assert got.columns == odd.columns and {r.doc_id for r in got.collect()} == kept
