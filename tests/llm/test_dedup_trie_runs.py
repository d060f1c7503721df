"""Exact duplicates, the prefix trie and periodic runs against brute force, and on odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from outlog.llm import exact, queries, runs, suffix, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- exact duplicates ------------------------------------------------------------------------------

def best_rows(rows):
    """{(id, text): (keep_id, size)} of (id, text) rows by the definition."""
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i if i is not None else 0, i))
    return {norm: (min(g)[3], len(g)) for norm, g in groups.items()}


def test_exact_duplicates_of_documents(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    want = best_rows(rows)
    got = {r.doc_id: r for r in queries.op11_exact_dedup(spark, sf_small).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep, size = want[norm]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (keep, size, keep == i, sha(norm))


def odd_documents(spark):
    same = "the same text\twith white space " * 40
    rows = [(None, None), (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "o n e"), (None, "o n e"), (6, "two"),
            (7, same), (8, same.replace(" ", "")), (9, same + "x"), (10, same[:-6] + "y" * 6), (11, " "), (11, " "),
            (12, "long " * 60_000), (13, "long " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("len", "full", "row", "n", "size", "best", "kept", "group_size", "company", "_hot"):
        df = df.withColumn(c, F.lit("mine"))
    return rows, df


def test_exact_duplicates_on_odd_rows(spark):
    rows, df = odd_documents(spark)
    out = exact.exact_duplicates(df)
    assert set(out.columns) == set(df.columns) | {"keep_id", "group_size", "kept", "text_sha256"}
    got = out.collect()
    assert len(got) == len(rows) and all(r.len == "mine" and r["_hot"] == "mine" for r in got)
    want = best_rows(rows)
    kept = collections.Counter()
    for r in got:
        norm = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        assert (r.keep_id, r.group_size) == want[norm]
        kept[norm] += r.kept
        assert r.text_sha256 in (None, sha(norm)) and (r.group_size == 1 or r.text_sha256)
    assert set(kept.values()) == {1}      # one row of each group, also of rows that repeat with their id
    assert exact.exact_duplicates(df.where("false")).count() == 0


def test_full_hashes_only_where_length_and_prefix_have_company(spark):
    p = "p" * exact.PREFIX
    rows = [(1, "abc"), (2, "abd"), (3, "abcd"), (4, p + "x"), (5, p + "y"), (6, "q" + p)]
    seen = {r.id: (r.open, r.full) for r in exact.refine(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, (open_, _) in seen.items() if open_} == {4, 5}
    assert {i for i, (_, full) in seen.items() if full} == {4, 5}


def test_exact_duplicates_with_a_hot_group(spark):
    """A group far above the hot share goes by broadcast, the others by join: one result."""
    df = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(
        F.col("id") % 3 == 1, F.concat(F.lit("pair "), (F.col("id") / 6).cast("int"))).otherwise(F.col("id").cast("string")).alias("text"))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = best_rows(rows)
    for r, t in zip(exact.exact_duplicates(df).orderBy("doc_id").collect(), [t for _, t in rows], strict=True):
        assert (r.keep_id, r.group_size) == want[t.replace(" ", "")] and r.kept == (r.keep_id == r.doc_id)


# ---- prefix trie -------------------------------------------------------------------------------------

def brute_trie(convs):
    """Nodes of {conv_id: [(role, text), ...]} by the definition."""
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, m in members.items():
        under = [k for k in members if k[:len(node)] == node]
        kids = {k: [x for x in under if len(x) == len(k) + 1 and x[:len(k)] == k] for k in under}
        own = sorted(c for c in m if len(convs[c]) == len(node))
        out.append((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]),
                    sum(not v for v in kids.values()), sum((len(members[k]) - 1) * len(k[-1][1]) for k in under if k),
                    sha(",".join(map(str, own)))))
    return sorted(out, key=str)


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + turns[h:]
    return out


def conversations(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        convs[c].append((role or "", text or ""))
    return dict(convs)


def node_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_trie_of_the_conversations(spark, sf_small):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert node_rows(queries.op12_prefix_trie(spark, sf_small)) == brute_trie(rebuilt(conversations(rows)))


def made_up(seed, n=60):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        c = r.choice([c, c + 100, 300 + c])
        path = [r.choice("ab") for _ in range(r.choice([0, 1, 2, 5, 9, 23]))]
        rows += [(c, t, r.choice(["user", None]) if r.random() < .1 else "user", x * 3) for t, x in enumerate(path)]
    seen, out = set(), []
    for row in rows:
        if row[:2] not in seen:
            seen.add(row[:2])
            out.append(row)
    return out


@pytest.mark.parametrize("first,widest,cells", [(2, 4, 40), (1, 2, 8), (32, 64, 1 << 20)])
def test_trie_over_blocks_and_shards(spark, first, widest, cells):
    """Small blocks and shards: shared long beginnings, boundary nodes and chains all occur."""
    rows = made_up(7) + [(c, t, "user", f"long {t}") for c in (900, 901, 902) for t in range(11 + c % 3)]
    turns = trie.positions(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = node_rows(trie.prefix_trie(trie.whole(turns), first, widest, cells))
    assert got == brute_trie(conversations(rows))


def test_trie_with_copies_and_absent_bases(spark):
    same = [("user", "q" * 9), (None, None), ("assistant", "")]
    rows = [(c, t, r, x) for c in list(range(100, 160)) + list(range(250, 280)) for t, (r, x) in enumerate(same)]
    rows += [(401, None, "user", "null turn first"), (401, 0, "user", "then 0"), (None, 0, "user", "no conversation")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("mine")) \
        .withColumn("digest", F.lit(None).cast("string"))
    turns = trie.positions(df)
    got = node_rows(trie.prefix_trie(trie.on_shared_heads(turns, 100, 5), shard_cells=64))
    assert got == brute_trie(rebuilt(conversations(rows)))
    assert any(r[1] == 0 and r[7] != trie.NOTHING for r in got)     # conversations left without turns end at the root


def test_trie_of_repeated_rows_and_of_nothing(spark):
    df = spark.createDataFrame([(1, 0, "u", "a"), (1, 0, "u", "a"), (2, 0, "u", "a")], "conv_id long, turn long, role string, text string")
    got = node_rows(trie.prefix_trie(trie.whole(trie.positions(df))))
    assert got == brute_trie({1: [("u", "a")] * 2, 2: [("u", "a")]})
    assert trie.prefix_trie(trie.on_shared_heads(trie.positions(df.where("false")), 100, 5)).count() == 0


# ---- periodic runs -------------------------------------------------------------------------------------

def brute_runs(x):
    out, n = set(), len(x)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            size = i - s + q
            if size >= max(12, 2 * q):
                y = x[s:s + size]
                if next(p for p in range(1, size + 1) if y[p:] == y[:size - p]) == q:
                    out.add((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, plant):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if plant and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    return (len(found), *top, 1000 * top[1] // top[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_of_documents(spark, sf_small):
    short = spark.read.parquet(f"{sf_small}/documents.parquet").where(F.length("text") < 4000)
    rows = short.select("doc_id", "text").collect()
    got = {r[0]: tuple(r)[1:] for r in runs.periodic_runs(short, plant=True).collect()}
    assert len(got) == len(rows) > 100 and sum(g[0] > 0 for g in got.values()) > 5
    for r in rows:
        assert got[r.doc_id] == brute_row(r.doc_id, r.text, True), r.doc_id
    assert queries.op13_periodic_runs(spark, sf_small).count() == spark.read.parquet(f"{sf_small}/documents.parquet").count()


def sequences():
    r = random.Random(11)
    for _ in range(250):
        kind = r.random()
        if kind < .35:
            yield [r.randint(0, 1) for _ in range(r.randint(0, 140))]
        elif kind < .8:
            u = [r.randint(0, r.choice([1, 2, 8])) for _ in range(r.randint(1, 40))]
            x = [r.randint(0, 40) for _ in range(r.randint(0, 20))] + (u * 6)[:r.randint(0, len(u) * 5)] + [r.randint(0, 40) for _ in range(9)]
            yield x * r.randint(1, 3)
        else:
            yield ([0] * r.randint(0, 20) + [1] + [0] * r.randint(0, 20)) * r.randint(1, 4)


def test_runs_of_small_alphabets_side_by_side():
    """All documents of one flat array; runs never cross, of any period, nested or overlapping."""
    docs = list(sequences())
    first = np.cumsum([0] + [len(d) for d in docs])
    s, m, q = runs.find_runs(np.array([c for d in docs for c in d], np.int64), np.repeat(np.arange(len(docs)), [len(d) for d in docs]))
    want = [(a + int(first[k]), b, c) for k, d in enumerate(docs) for a, b, c in brute_runs(d)]
    assert list(zip(s.tolist(), m.tolist(), q.tolist(), strict=True)) == want and len({c for _, _, c in want}) > 20


def test_splitting_settles_on_words_met_twice():
    words = "a b c a b c x a b a b a b a b a b a b y d e f d e f".split()
    codes = np.unique(words, return_inverse=True)[1].astype(np.int64)
    place, segment = runs.split_by_frequency(codes, np.zeros(len(codes), np.int64))
    assert place.tolist() == list(range(7, 19)) and len(set(segment.tolist())) == 1     # the rest is too short
    for s in np.unique(segment):
        assert min(collections.Counter(codes[place[segment == s]].tolist()).values()) >= 2


def test_runs_on_odd_rows(spark):
    rows = [(None, None), (None, "a " * 20), (1, ""), (2, " \n"), (3, "a b " * 7), (3, "a b " * 7), (4, "a " * 11), (5, "x" * 50_000),
            (6, " ".join(f"w{i % 4999}" for i in range(30_000))), (7, "é ü é ü " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("mine")).withColumn("start", F.lit(1))
    got = runs.periodic_runs(df, keep_text=True).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_runs, r.period): r for r in got}
    assert by[(6, 1, 4999)].length == 30_000 and by[(3, 1, 2)].length == 14 and by[(None, 1, 1)].length == 20
    assert by[(3, 1, 2)].collapsed == "a b" and by[(4, 0, None)].start is None and by[(4, 0, None)].exponent_milli is None
    assert by[(None, 0, None)].collapsed_sha256 == sha("") and [tuple(x) for x in by[(3, 1, 2)].runs] == [(0, 14, 2)]
    assert runs.periodic_runs(df.where("false")).count() == 0


def test_batches_do_not_change_runs():
    texts = ["a b c d e f " * 5, "q", None, "x y " * 9, "z " * 13]
    batch = pa.record_batch([pa.array(range(5)), pa.array([t or "" for t in texts])], ["id", "text"])
    whole = runs.judge(batch, True, True).to_pylist()
    assert whole == [x for i in range(5) for x in runs.judge(batch.slice(i, 1), True, True).to_pylist()]


def test_anchors_of_a_block_are_found_in_little_memory():
    """A block's texts are worked on in segments whose temporary arrays are a fraction of an executor's memory."""
    import tracemalloc

    text = np.random.default_rng(1).integers(97, 123, 4 << 20).astype(np.uint8).tobytes()
    tracemalloc.start()
    suffix.block_anchors([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
