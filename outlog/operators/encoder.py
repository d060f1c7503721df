"""Template encoders: sentences of templates, Word2Vec, vocabulary upkeep and lookup.

A log line's context is the lines around it.  A document (one log file / one stream
chunk) is a sentence whose words are the templates of its lines in order.  Sentences are
built inside the row that carries the document, so building them needs no shuffle.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .. import config as C
from ..functions.text import template
from ..functions.vectors import as_double_array, cosine_distance, hash_vector, zeros
from ..session import cut_lineage, cut_over, drop_path, shuffles_dropped


def document_sentences(documents: DataFrame, text_col: str = "text", keep=("doc_id", "source")) -> DataFrame:
    """One sentence per document: templates of its non-empty lines, in line order."""
    lines = F.filter(F.split(F.col(text_col), "\n", -1), lambda x: x != F.lit(""))
    return documents.select(*keep, F.transform(lines, lambda s: template(s)).alias("sentence"))


def sequence_sentences(lines: DataFrame, seq_cols: list[str], order_cols: list[str],
                       word_col: str = "template", max_len: int = 1000, window: int = C.W2V_WINDOW) -> DataFrame:
    """Sentences from separate line rows: templates per sequence key, sorted by ``order_cols``.

    A sequence is cut into chunks of ``max_len`` consecutive lines, so no group grows with the
    data even when one sequence key holds a large share of all lines.  ``after`` holds the
    ``window`` lines that follow a chunk: they are context of its last lines and no words of
    its own, so every pair of neighbours is met once.  Chunks come from each line's position
    in its sequence, computed with block-wise prefix sums.
    """
    from .prefix import ordered_position

    if window > max_len:
        raise ValueError(f"a window of {window} lines is longer than a chunk of {max_len}")
    pos = ordered_position(lines.select(*seq_cols, *order_cols, word_col), order_cols, seq_cols, "__pos")
    chunk = F.floor((F.col("__pos") - 1) / F.lit(max_len))
    first = (chunk > 0) & ((F.col("__pos") - 1) % max_len < window)
    own, before = F.struct(chunk.alias("c"), F.lit(0).alias("t")), F.struct((chunk - 1).alias("c"), F.lit(1).alias("t"))
    placed = pos.withColumn("__at", F.explode(F.when(first, F.array(own, before)).otherwise(F.array(own))))
    packed = F.struct(F.col("__at.t").alias("__t"), *[F.col(c) for c in order_cols], F.col(word_col).alias("__w"))
    part = lambda t: F.transform(F.filter("__s", lambda s: s["__t"] == t), lambda s: s["__w"])
    return (placed.groupBy(*seq_cols, F.col("__at.c").alias("__chunk"))
                  .agg(F.sort_array(F.collect_list(packed)).alias("__s"))
                  .select(*seq_cols, "__chunk", part(0).alias("sentence"), part(1).alias("after")))


def cooccurrence_pairs(sentences: DataFrame, window: int = C.W2V_WINDOW,
                       sentence_col: str = "sentence") -> DataFrame:
    """Every (word, following word within ``window`` positions) pair, with its offset.

    Computed per sentence array (narrow); identical to ``lead(word, k)`` for k = 1..window
    over the line order.  The words of a column ``after``, if there is one, are context only.
    """
    own = F.col(sentence_col)
    after = F.coalesce(F.col("after"), F.array().cast("array<string>")) if "after" in sentences.columns else F.array().cast("array<string>")
    s = sentences.select(F.concat(own, after).alias("__s"), F.size(own).alias("__n"))
    # each word takes only its own context along, so a row stays linear in the sentence's length
    near = F.transform(F.slice("__s", 1, F.col("__n")), lambda w, i: F.struct(w.alias("word"), F.slice(F.col("__s"), i + 2, window).alias("ctx")))
    return (s.select(F.explode(near).alias("g"))
             .select(F.col("g.word").alias("word"), F.posexplode("g.ctx").alias("o", "context"))
             .select("word", "context", (F.col("o") + 1).alias("offset")))


LINES_AT_ONCE = 1 << 16      # lines of whole sentences whose components or pairs a task holds at once


def _whole_sentences(s: pa.ListArray) -> Iterator[tuple[int, int]]:
    """Ranges of sentences, at least one, of about LINES_AT_ONCE lines; those without a line are passed over."""
    upto = np.cumsum(s.value_lengths().fill_null(0).to_numpy(), dtype=np.int64)
    a = 0
    while a < len(s):
        before = int(upto[a - 1]) if a else 0
        z = max(a + 1, int(np.searchsorted(upto, before + LINES_AT_ONCE, side="right")))
        if upto[z - 1] > before:
            yield a, z
        a = z


HOT_SHARE, HOT_PARTS = 0.01, 64      # words above that share of all lines have their contexts dealt to so many groups


def _pair_counts(sentences: pa.ListArray, own: np.ndarray, window: int, hot: set) -> pa.RecordBatch:
    """(word, part, contexts, counts) over whole sentences, whose first ``own`` words have contexts; ``part`` deals out hot words'."""
    flat = sentences.flatten().dictionary_encode(null_encoding="encode")
    code, names = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary
    length = sentences.value_lengths().fill_null(0).to_numpy()
    end = np.repeat(np.cumsum(length), length)
    at, upto = np.arange(len(code)), end - np.repeat(length - own, length)
    keys = []
    for o in range(1, window + 1):
        first = at[(at < upto) & (at + o < end)]
        keys.append(code[first] * len(names) + code[first + o])
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    word, context = key // max(1, len(names)), key % max(1, len(names))
    part = np.zeros(len(key), np.int32)
    if hot:
        text = names.to_pylist()
        dealt = np.array([w in hot for w in text], bool)[word]
        part[dealt] = [zlib.crc32((text[c] or "").encode()) % HOT_PARTS for c in context[dealt]]
        order = np.lexsort((part, word))
        word, context, part, n = word[order], context[order], part[order], n[order]
    first = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (part[1:] != part[:-1]))[:len(word)])
    ends = pa.array(np.append(first, len(word)), pa.int32())
    return pa.RecordBatch.from_arrays(
        [names.take(pa.array(word[first])), pa.array(part[first]), pa.ListArray.from_arrays(ends, names.take(pa.array(context))),
         pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int64)))], ["word", "part", "contexts", "counts"])


def cooccurrence_counts(sentences: DataFrame, window: int = C.W2V_WINDOW) -> DataFrame:
    """The pairs of ``cooccurrence_pairs`` and how often each occurs: (word, context, n).

    Pairs are counted over some whole sentences first and shuffled as a word with the list of its contexts,
    so a word travels once for all of them; frequent words are dealt out by context.
    """
    own = F.col("sentence")
    after = F.coalesce(F.col("after"), F.array().cast("array<string>")) if "after" in sentences.columns else F.array().cast("array<string>")
    hot = {r[0] for r in sentences.select(F.explode("sentence").alias("word")).freqItems(["word"], HOT_SHARE)
           .select(F.explode("word_freqItems")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, n = b["sentence"], b["n"].to_numpy()
            for a, z in _whole_sentences(s):
                yield _pair_counts(s.slice(a, z - a), n[a:z], window, hot)

    near = (sentences.where(own.isNotNull()).select(F.concat(own, after).alias("sentence"), F.size(own).alias("n"))
            .mapInArrow(run, "word string, part int, contexts array<string>, counts array<bigint>"))
    return (near.repartition("word", "part").select("word", "part", F.explode(F.arrays_zip("contexts", "counts")).alias("c"))
            .groupBy("word", "part", F.col("c.contexts").alias("context")).agg(F.sum("c.counts").alias("n"))
            .select("word", "context", "n"))


def vocabulary(words: DataFrame, word_col: str = "template", min_count: int = C.W2V_MIN_COUNT) -> DataFrame:
    """Word -> count, keeping words seen at least ``min_count`` times."""
    return (words.groupBy(F.col(word_col).alias("word")).agg(F.count("*").alias("n"))
                 .where(F.col("n") >= min_count))


def new_words(words: DataFrame, vocab: DataFrame, word_col: str = "template") -> DataFrame:
    """Distinct words of a batch that the vocabulary does not know yet (vocabulary growth)."""
    w = words.select(F.col(word_col).alias("word")).distinct()
    return w.join(vocab.select("word"), "word", "left_anti")


def sentence_vocabulary(sentences: DataFrame, min_count: int = C.W2V_MIN_COUNT) -> DataFrame:
    return (sentences.select(F.explode("sentence").alias("word"))
                     .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count))


CODE_DIGITS = 7      # of base 36


def _digest(word: str | Column) -> Column:
    """Sixteen bytes by which words meet: no long string is moved or sorted for it."""
    return F.unhex(F.md5(word))


def word_codes(words: DataFrame) -> DataFrame:
    """(word, code) of distinct words: short strings of one length that sort as the words do, the same on every run."""
    ranked = cut_lineage(words.orderBy("word").select("word", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    upto, first = 0, {}
    for p, n in sorted(ranked.groupBy(part).count().collect()):      # a row per range of words
        first[p], upto = upto, upto + n
    start = F.get(F.array(*[F.lit(first.get(p, 0)).cast("long") for p in range(max(first, default=0) + 1)]), part.cast("int"))
    code = F.conv((start + F.col("at").bitwiseAND((1 << 33) - 1)).cast("string"), 10, 36)
    return ranked.select("word", F.lpad(code, CODE_DIGITS, "0").alias("code"))


def coded(rows: DataFrame, word_col: str, codes: DataFrame) -> DataFrame:
    """Rows with the code of their word in its place; null where it has none."""
    known = codes.select(_digest("word").alias("__key"), F.col("code").alias("__code"))
    return rows.withColumn("__key", _digest(F.col(word_col))).drop(word_col).join(known, "__key", "left") \
        .drop("__key").withColumnRenamed("__code", word_col)


def coded_sentences(sentences: DataFrame, codes: DataFrame) -> DataFrame:
    """The sentences (column ``sentence``) that hold a word, as the codes of their words; words without one are left out."""
    places = sentences.withColumn("s", F.monotonically_increasing_id()).select("s", F.posexplode("sentence").alias("at", "word"))
    return coded(places, "word", codes).where(F.col("word").isNotNull()) \
        .groupBy("s").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("places")) \
        .select(F.col("places.word").alias("sentence"))


@dataclass
class Word2Vec:
    """Tables of a fit: vectors of words, vectors of words as contexts (word, vector), loss (epoch, loss)."""

    vectors: DataFrame
    contexts: DataFrame
    loss: DataFrame


def fit_word2vec(sentences: DataFrame, vector_length: int = C.W2V_VECTOR_LENGTH,
                 window: int = C.W2V_WINDOW, min_count: int = C.W2V_MIN_COUNT,
                 max_iter: int = C.W2V_ITER, seed: int = C.W2V_SEED, partitions: int = 1,
                 max_sentence_length: int = 1000):
    """Train skip-gram Word2Vec with negative samples on template sentences; returns (model, vectors DataFrame).

    Vocabulary and vectors are tables cut into blocks (``sgns.train``), so nothing of the vocabulary's size comes to
    the driver, and the vectors are the same on every run.  Sentences longer than ``max_sentence_length`` are cut into
    chunks (no word is dropped); words seen less than ``min_count`` times are left out.  A word without neighbours keeps
    its seeded first vector.  The number of tasks follows the vocabulary and the pairs, so ``partitions`` changes nothing.
    """
    from . import sgns

    own = F.col("sentence")
    if sentences.where(F.size(own) > 0).isEmpty():
        raise ValueError("empty vocabulary: nothing to train on")
    with shuffles_dropped(sentences.sparkSession):
        codes = word_codes(sentence_vocabulary(sentences, min_count).select("word").where(F.col("word").isNotNull()))
        starts = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / max_sentence_length)).cast("array<int>")
        chunks = sentences.where(F.size(own) > 0).select(own, F.explode(starts).alias("c")) \
            .select(F.slice(own, F.col("c") * max_sentence_length + 1, max_sentence_length).alias("sentence"))
        pairs = sgns.word_pairs(cooccurrence_counts(cut_lineage(coded_sentences(chunks, codes)), window))
        names = codes.select(F.concat(F.lit("w:"), "code").alias("key"), F.concat(F.lit("w:"), "word").alias("name"))
        rows, cols, loss = sgns.train(pairs, vector_length, max_iter, seed=seed, names=names, each=True)
        vectors = cut_lineage(codes.join(sgns.word_vectors(rows).withColumnRenamed("word", "code"), "code", "left")
                              .select("word", F.coalesce("vector", hash_vector(F.col("word"), vector_length, seed)).alias("vector")))
    contexts = codes.join(cols.withColumnRenamed("key", "code"), "code").select("word", "vector")
    return Word2Vec(vectors, contexts, loss), vectors


def cooccurrence_vectors(sentences: DataFrame, dim: int = C.W2V_VECTOR_LENGTH, window: int = C.W2V_WINDOW,
                         min_count: int = C.W2V_MIN_COUNT, seed: int = C.W2V_SEED) -> DataFrame:
    """``word`` and ``vector``: the mean seeded vector of the words within ``window`` places.

    Words that stand among the same words get close vectors.  A context word's components are
    20 bits of a seeded hash, summed as whole numbers, so the vectors do not depend on the order
    of the rows and are the same on every run; a word without neighbours keeps its own
    components.  Nothing of the vocabulary's size comes to the driver.  Where every word of a sentence
    counts, sums are taken inside the sentence and one exchange by word adds them up; else (words too rare,
    lines ``after`` a chunk) pairs are counted before they meet the components, and words travel as digests.
    """
    if min_count <= 1 and "after" not in sentences.columns:
        return counted_vectors(sentences, dim, window, seed).select("word", "vector")
    words = sentence_vocabulary(sentences, min_count)
    bits = [F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("word"), F.lit(str(i)))), 1, 5), 16, 10)
            .cast("long").alias(f"h{i}") for i in range(dim)]
    words = cut_lineage(words.select("word", F.md5("word").alias("key"), *bits))
    parts = [c for c in ("sentence", "after") if c in sentences.columns]
    counts = cooccurrence_counts(sentences.select(*[F.transform(c, lambda w: F.md5(w)).alias(c) for c in parts]), window)
    both = counts.select(F.explode(F.array(F.struct(F.col("word").alias("key"), F.col("context").alias("near")),
                                           F.struct(F.col("context").alias("key"), F.col("word").alias("near")))).alias("p"), "n")
    comps = words.select(F.col("key").alias("near"), *[f"h{i}" for i in range(dim)])
    sums = (both.select("p.*", "n").join(comps, "near").groupBy("key")
            .agg(F.sum("n").alias("m"), *[F.sum(F.col("n") * F.col(f"h{i}")).alias(f"s{i}") for i in range(dim)]))
    total = F.coalesce(F.col("m"), F.lit(1)).cast("double")
    comp = [(F.coalesce(F.col(f"s{i}"), F.col(f"h{i}")).cast("double") / total / F.lit(1048576.0) - F.lit(0.5)) / F.lit(float(dim))
            for i in range(dim)]
    return words.join(sums, "key", "left").select("word", F.array(*comp).alias("vector"))


def _components(words: list[str], dim: int, seed: int) -> np.ndarray:
    """The 20-bit components of words: the first five hex digits of md5(seed:word:i)."""
    tails = [str(i).encode() for i in range(dim)]
    out = np.empty((len(words), dim), np.int64)
    for r, w in enumerate(words):
        head = hashlib.md5(f"{seed}:{w}:".encode(), usedforsecurity=False)
        for i, tail in enumerate(tails):
            h = head.copy()
            h.update(tail)
            out[r, i] = int.from_bytes(h.digest()[:3], "big") >> 4
    return out


def _near_sums(sentences: pa.ListArray, dim: int, window: int, seed: int) -> pa.RecordBatch:
    """(word, n, m, sums): the places of each word; over them, the number and the components of the words near it."""
    flat = sentences.flatten().dictionary_encode()
    code = flat.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    told = (code >= 0).astype(np.int64)
    comps = np.concatenate([_components(flat.dictionary.to_pylist(), dim, seed), np.zeros((1, dim), np.int64)])
    own = np.concatenate([told[:, None], comps[code]], axis=1)
    upto = np.concatenate([np.zeros((1, dim + 1), np.int64), np.cumsum(own, axis=0)])
    length = sentences.value_lengths().fill_null(0).to_numpy()
    end = np.repeat(np.cumsum(length), length)
    start, at = end - np.repeat(length, length), np.arange(len(code))
    near = (upto[np.minimum(at + window + 1, end)] - upto[np.maximum(at - window, start)] - own) * told[:, None]
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.append(True, code[order][1:] != code[order][:-1]))
    total = np.add.reduceat(near[order], first, axis=0)
    names = flat.dictionary.take(pa.array(code[order][first], mask=code[order][first] < 0))
    sums = pa.ListArray.from_arrays(np.arange(0, dim * len(first) + 1, dim, dtype=np.int32), total[:, 1:].ravel())
    places = np.diff(np.append(first, len(code)))
    return pa.RecordBatch.from_arrays([names, pa.array(places, pa.int64()), pa.array(total[:, 0]), sums], ["word", "n", "m", "sums"])


def counted_vectors(sentences: DataFrame, dim: int = C.W2V_VECTOR_LENGTH, window: int = C.W2V_WINDOW,
                    seed: int = C.W2V_SEED) -> DataFrame:
    """``cooccurrence_vectors`` of whole sentences with each word's count: (word, n, vector).

    A row per distinct word of a few sentences is shuffled, no pairs; counts and sums share that one exchange.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b["sentence"]
            for a, z in _whole_sentences(s):
                yield _near_sums(s.slice(a, z - a), dim, window, seed)

    near = sentences.select("sentence").mapInArrow(run, "word string, n long, m long, sums array<bigint>")
    total = near.groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)])
    alone = [F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("word"), F.lit(str(i)))), 1, 5), 16, 10).cast("long")
             for i in range(dim)]
    met = F.col("m") > 0
    comp = [(F.when(met, F.col(f"s{i}")).otherwise(alone[i]).cast("double") / F.when(met, F.col("m")).otherwise(1).cast("double")
             / F.lit(1048576.0) - F.lit(0.5)) / F.lit(float(dim)) for i in range(dim)]
    return total.select("word", "n", F.array(*comp).alias("vector"))


def _vector_to_array(c: Column) -> Column:
    from pyspark.ml.functions import vector_to_array
    return vector_to_array(c, "float64")


def hash_vectors(words: DataFrame, dim: int = C.W2V_VECTOR_LENGTH, seed: int = C.W2V_SEED,
                 word_col: str = "word") -> DataFrame:
    """Deterministic stand-in vectors for words that join the vocabulary untrained."""
    return words.select(F.col(word_col).alias("word"), hash_vector(F.col(word_col), dim, seed).alias("vector"))


def encode(df: DataFrame, vectors: DataFrame, word_col: str = "template", out_col: str = "vector",
           dim: int = C.W2V_VECTOR_LENGTH, oov: str = "hash", seed: int = C.W2V_SEED,
           broadcast_vocab: bool | None = None) -> DataFrame:
    """Look each word up in the vector table (left join); unseen words follow ``oov``.

    ``hash``: seeded deterministic vector, ``zero``: all zeros, ``null``: left null.
    The vocabulary side is broadcast only when the caller has checked its size
    (``broadcast_vocab=True``); otherwise the join is a shuffle join whose skewed word
    partitions AQE splits.
    """
    v = vectors.select(F.col("word").alias("__word"), F.col("vector").alias("__vec"))
    if broadcast_vocab:
        v = F.broadcast(v)
    j = df.join(v, df[word_col] == v["__word"], "left")
    fill = _filled(F.col("__vec"), word_col, dim, oov, seed)
    return j.withColumn(out_col, fill).drop("__word", "__vec")


def _filled(vec: Column, word_col: str, dim: int, oov: str, seed: int) -> Column:
    """A word's vector, or what ``oov`` puts for a word without one."""
    if oov == "hash":
        return F.coalesce(vec, hash_vector(F.col(word_col), dim, seed))
    if oov == "zero":
        return F.coalesce(vec, zeros(dim))
    if oov == "null":
        return vec
    raise ValueError(f"unknown oov policy {oov!r}")


def encode_counts(counts: DataFrame, vectors: DataFrame, dim: int = C.W2V_VECTOR_LENGTH, oov: str = "hash",
                  seed: int = C.W2V_SEED) -> tuple[DataFrame, DataFrame]:
    """Counted templates (template, n) with their vectors as ``encode`` gives them, and the vector table itself.

    Both are read from one written join.  Where counts and vectors come from aggregations by the same key,
    the join needs no exchange of its own.
    """
    v = vectors.select(F.col("word").alias("__word"), F.col("vector").alias("__vec"))
    both = counts.join(v, counts["template"] == v["__word"], "full_outer")
    both = both.withColumn("template", F.coalesce("template", "__word")).withColumn("known", F.col("__vec").isNotNull())
    both = cut_lineage(both.select("template", "n", "known", _filled(F.col("__vec"), "template", dim, oov, seed).alias("vector")))
    return (both.where(F.col("n").isNotNull()).select("template", "n", "vector"),
            both.where("known").select(F.col("template").alias("word"), "vector"))


def encode_columns(df: DataFrame, vectors_by_col: dict[str, DataFrame], dim: int,
                   out_col: str = "features") -> DataFrame:
    """Several encoded columns concatenated in a fixed order; a column the model does not
    know is skipped, a missing vector is ``dim`` zeros."""
    from ..functions.vectors import concat_vectors

    known = [c for c in vectors_by_col if c in df.columns]
    out = df
    for c in known:
        out = encode(out, vectors_by_col[c], word_col=c, out_col=f"__v_{c}", dim=dim, oov="null")
    return out.withColumn(out_col, concat_vectors([f"__v_{c}" for c in known], dim)) \
              .drop(*[f"__v_{c}" for c in known])


def similar_words(probes: DataFrame, vectors: DataFrame, k: int = 3, probe_col: str = "word",
                  probe_vec: str = "vector", id_col: str = "word", vec_col: str = "vector",
                  exclude_self: bool = True) -> DataFrame:
    """Top-``k`` entries of ``vectors`` by cosine similarity to each probe (self excluded).

    The probe set is small by construction (a handful of query words); its size is
    checked and it is broadcast, each task keeps a top-k per probe over its own rows and
    only those candidates are shuffled for the final top-k: no pair table is built.
    """
    import numpy as np
    import pandas as pd

    pr = probes.select(F.col(probe_col).alias("probe"), as_double_array(probe_vec).alias("pv")).collect()
    if len(pr) * len(pr[0]["pv"] if pr else []) * 8 > C.BROADCAST_MAX_BYTES:
        raise ValueError("probe set too large to broadcast")
    names = [r["probe"] for r in pr]
    P = np.array([r["pv"] for r in pr], dtype=np.float64) if pr else np.zeros((0, 1))
    bp = vectors.sparkSession.sparkContext.broadcast((names, P))
    id_type = vectors.schema[id_col].dataType
    probe_type = probes.schema[probe_col].dataType
    schema = T.StructType([T.StructField("probe", probe_type), T.StructField("neighbour", id_type),
                           T.StructField("similarity", T.DoubleType())])

    def local_topk(batches):
        names, P = bp.value
        pn = np.linalg.norm(P, axis=1)
        best = {i: [] for i in range(len(names))}
        for pdf in batches:
            if pdf.empty:
                continue
            X = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            ids = pdf["id"].to_numpy()
            xn = np.linalg.norm(X, axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                sim = (P @ X.T) / (pn[:, None] * xn[None, :])
            for i, name in enumerate(names):
                s = sim[i]
                keep = ~np.isnan(s) & ((ids != name) if exclude_self else True)
                cand = pd.DataFrame({"neighbour": ids[keep], "similarity": s[keep]})
                best[i].append(cand.sort_values(["similarity", "neighbour"], ascending=[False, True]).head(k))
        for i, name in enumerate(names):
            if best[i]:
                allc = pd.concat(best[i]).sort_values(["similarity", "neighbour"], ascending=[False, True]).head(k)
                allc.insert(0, "probe", name)
                yield allc

    cand = vectors.select(F.col(id_col).alias("id"), as_double_array(vec_col).alias("v")).mapInPandas(local_topk, schema)
    from pyspark.sql import Window as W
    w = W.partitionBy("probe").orderBy(F.col("similarity").desc(), F.col("neighbour"))
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


ROUND_PAIRS = 1 << 19      # different pairs that meet their vectors at once, or as many as there are vectors


def pair_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Mean cosine similarity of co-occurring words: a training-quality read-out that
    a loss does not give (higher is better).

    Pairs are counted by digests first and meet their vectors in rounds, so no more than a round's vectors are moved at once.
    """
    with shuffles_dropped(pairs.sparkSession):
        counts, held = cut_over(pairs.groupBy(_digest("word").alias("word"), _digest("context").alias("context")).agg(F.count("*").alias("n")), None)
        known, kept = cut_over(vectors.select(_digest("word").alias("word"), "vector"), None)
        rounds = max(1, -(-counts.count() // max(ROUND_PAIRS, known.count())))
        v1 = known.withColumnRenamed("vector", "v1")
        v2 = known.select(F.col("word").alias("context"), F.col("vector").alias("v2"))
        total, alike, told = 0, [], 0
        for r in range(rounds):
            now = lambda x: x.where(F.pmod(F.xxhash64("word"), F.lit(rounds)) == r)  # noqa: B023, E731
            j = now(counts).join(now(v1), "word").join(v2, "context").select("n", (F.lit(1.0) - cosine_distance("v1", "v2")).alias("s"))
            one = j.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("s")).alias("s"), F.sum(F.when(F.col("s").isNotNull(), F.col("n"))).alias("told")).first()
            total, told = total + (one["n"] or 0), told + (one["told"] or 0)
            alike.append(one["s"] or 0.0)
        for path in (held, kept):
            drop_path(pairs.sparkSession, path)
    mean = math.fsum(alike) / told if told else None
    return pairs.sparkSession.createDataFrame([(mean, total)], "mean_pair_similarity double, pairs long")
