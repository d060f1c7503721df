"""Language-model scores of documents: marginal likelihood over all subword segmentations.

An existing subword vocabulary gives the pieces; EM learns their probabilities from the distinct words
of the training rows.  Every segmentation of a word into pieces counts with the product of its piece
probabilities, and a forward recursion over the word's lattice sums them all.  A word that occurs in the
training rows is more than its spelling: its discounted count is added, and what the discounts leave is
spread by the lattice over all words, known and new (an interpolated, absolutely discounted model).

Corpus counts (how often each token occurs in the training rows) join the texts by blocks:
a block's distinct words go once to the task that owns the word, which counts it over all
blocks; each word's lattice runs once, and words come back as the block's dictionary.  So what is moved
grows with the distinct words of a block, a common word has one row per block, and no
vocabulary is ever whole in one place.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import contiguous_groups, slices, tasks, whole_runs

VOCABULARY = "piece_bpe_32k.model"
BLOCK_BYTES = 24 << 20
LATTICE_CHARS = 150_000
SMOOTH = 0.1
ROUNDS = 2  # of EM over the training words
LOG2_10 = float(np.log2(10))
RANK_SHIFT = 10.0  # probability of a piece before learning: 1 / (RANK_SHIFT - score), normalised


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def load_pieces(path: str | None = None) -> tuple[list[str], list[float], list[float], float]:
    """(pieces, their log probabilities, log probabilities of the 256 byte pieces, of the end).

    The file's scores are minus the merge rank.  Word frequencies fall with the rank about as
    its inverse, so a score s weighs 1 / (RANK_SHIFT - s); byte pieces, which stand in for
    characters without a piece, weigh like the last rank, the end like the first.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or default_path())
    pieces, scores = [], []
    for i in range(sp.get_piece_size()):
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)):
            pieces.append(sp.id_to_piece(i))
            scores.append(sp.get_score(i))
    weight = 1 / (RANK_SHIFT - np.array(scores))
    byte_weight, end_weight = weight[weight > 1e-8].min(), 1 / RANK_SHIFT
    total = weight.sum() + 256 * byte_weight + end_weight
    log = lambda x: np.log(x / total)
    return pieces, log(weight).tolist(), [float(log(byte_weight))] * 256, float(log(end_weight))


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _extend(h: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Rolling hash of a substring lengthened by one code point."""
    with np.errstate(over="ignore"):
        h = (h ^ (code + np.uint64(0x632BE59BD9B4E019))) * _MIX
        return h ^ (h >> np.uint64(29))


class Lattice:
    """Sums over the segmentations of many words at once.

    Values are kept as they are, not as logarithms, and scaled up where they get small; an edge
    is a piece, or the bytes of a character without one (numbers from len(pieces) on: 1 to 4 bytes).
    """

    def __init__(self, pieces: list[str], logs: list[float], byte_logs: list[float]):
        self.longest = max(map(len, pieces))
        self.tables = []
        codes = [np.array([ord(c) for c in p], np.uint64) for p in pieces]
        for n in range(1, self.longest + 1):
            own = [i for i, p in enumerate(pieces) if len(p) == n]
            h = np.zeros(len(own), np.uint64)
            for k in range(n):
                h = _extend(h, np.array([codes[i][k] for i in own], np.uint64))
            order = np.argsort(h)
            self.tables.append((h[order], np.array(own, np.int32)[order]))
        self.n_pieces = len(pieces)
        self.logs = np.concatenate([logs, byte_logs[0] * np.arange(1, 5)])
        self.probs = np.append(np.exp(self.logs), 0.0)  # the last: no edge (number -1)

    def _look(self, n: int, h: np.ndarray) -> np.ndarray:
        keys, own = self.tables[n - 1]
        if not len(keys):
            return np.full(len(h), -1, np.int32)
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, own[at], np.int32(-1))

    def _batches(self, words: list[str]) -> Iterator[tuple[int, int]]:
        start, chars = 0, 0
        for i, w in enumerate(words):
            if chars and chars + len(w) > LATTICE_CHARS:
                yield start, i
                start, chars = i, 0
            chars += len(w) + 1
        if start < len(words):
            yield start, len(words)

    def word_logs(self, words: list[str]) -> np.ndarray:
        """log10 marginal probability of each word (with the word-start mark before it)."""
        out = np.empty(len(words))
        for a, z in self._batches(words):
            order, size, begin, edges = self._edges(words[a:z])
            probs = [None if e is None else self.probs[e] for e in edges]
            out[a + order] = self._sums(probs, size, lambda t, n, k: begin[:k] + t - n)
        return out / np.log(10)

    def expected(self, words: list[str]) -> np.ndarray:
        """How often each edge is used in the words' segmentations, on average over these by probability."""
        total = np.zeros(len(self.logs))
        for a, z in self._batches(words):
            _, size, begin, edges = self._edges(words[a:z])
            probs = [None if e is None else self.probs[e] for e in edges]
            ends = begin + size
            before, after = np.empty(int(ends[-1])), np.empty(int(ends[-1]))
            whole = self._sums(probs, size, lambda t, n, k: begin[:k] + t - n, before, lambda t, k: begin[:k] + t)
            self._sums(probs, size, lambda t, n, k: ends[:k] - t, after, lambda t, k: ends[:k] - 1 - t)
            before -= np.repeat(whole, size)
            for n, edge in enumerate(edges, 1):
                if edge is not None:
                    at = np.flatnonzero(edge >= 0)
                    used = np.exp(before[at] + self.logs[edge[at]] + after[at + n - 1])
                    total += np.bincount(edge[at], used, len(total))
        return total

    def _edges(self, words: list[str]):
        """Places of the words in falling length, the lengths, where each begins, and by length of
        the edge the numbers of those that begin at each character (None: there are none)."""
        marked = ["▁" + w for w in words]
        lengths = np.array([len(w) for w in marked])
        order = np.argsort(-lengths, kind="stable")
        size = lengths[order]
        flat = np.frombuffer("".join(marked[i] for i in order).encode("utf-32-le"), np.uint32).astype(np.uint64)
        ends = np.cumsum(size)
        left = np.repeat(ends, size) - np.arange(len(flat))  # characters to the word's end
        edges, h = [], np.zeros(len(flat), np.uint64)
        at = np.arange(len(flat))
        for n in range(1, min(self.longest, int(size[0])) + 1):
            h = _extend(h, flat[at + n - 1])
            found = self._look(n, h)
            edge = None
            if n == 1 or (found >= 0).any():
                edge = np.full(len(flat), -1, np.int32)
                edge[at] = found
            edges.append(edge)
            keep = left[at] >= n + 1
            at, h = at[keep], h[keep]
        unknown = edges[0] < 0
        if unknown.any():  # a character without a piece goes byte by byte
            code = flat[unknown]
            edges[0][unknown] = self.n_pieces + (code >= 0x80).astype(np.int32) + (code >= 0x800) + (code >= 0x10000)
        return order, size, ends - size, edges

    def _sums(self, probs: list[np.ndarray | None], size: np.ndarray, edge_at, kept: np.ndarray | None = None, kept_at=None) -> np.ndarray:
        """Log of each word's sum over its segmentations, taken character by character.

        ``edge_at(t, n, k)`` is where the first ``k`` words have the edge of length n that leads to step t.
        The logs of the steps before the last go to ``kept`` at ``kept_at(t, k)``.
        """
        ring: list[np.ndarray] = [np.ones(len(size))]
        scale, result = np.zeros(len(size)), np.empty(len(size))
        if kept is not None:
            kept[kept_at(0, len(size))] = 0.0
        for t in range(1, int(size[0]) + 1):
            alive = int(np.searchsorted(-size, -t, side="right"))  # words with at least t characters
            now = np.zeros(alive)
            for n in range(1, min(len(probs), t) + 1):
                if probs[n - 1] is not None:
                    now += ring[-n][:alive] * probs[n - 1][edge_at(t, n, alive)]
            ring.append(now)
            if len(ring) > self.longest:
                ring.pop(0)
            small = np.flatnonzero(now < 1e-150)
            if len(small):
                scale[small] -= 150 * np.log(10)
                for r in ring:
                    r[small] = np.minimum(r[small] * 1e150, 1e300)
            longer = int(np.searchsorted(-size, -t, side="left"))
            log = np.log(now) + scale[:alive]
            result[longer:alive] = log[longer:]
            if kept is not None and longer:
                kept[kept_at(t, longer)] = log[:longer]
        return result


def blocks(docs: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    """block, id, train, body (compressed text with A-Z lower-cased); a task starts a new block
    whenever the last one holds BLOCK_BYTES characters.  Written, so that all later steps agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        block, held = TaskContext.get().partitionId() << 24, 0
        for whole in batches:
            for b in slices(whole, "text"):
                ids, body = [], []
                for t in b["text"].to_pylist():
                    raw = (t or "").encode("utf-8").lower()
                    if held and held + len(raw) > BLOCK_BYTES:
                        block, held = block + 1, 0
                    held += len(raw)
                    ids.append(block)
                    body.append(z.compress(raw))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), b["id"], b["train"], pa.array(body, pa.binary())],
                                                 ["block", "id", "train", "body"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(train, F.lit(True)).alias("train"), F.col(text_col).alias("text"))
    return cut_lineage(rows.mapInArrow(run, "block long, id long, train boolean, body binary"))


def _texts(t: pa.Table) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(b, max_output_size=1 << 31) if b else b"" for b in t["body"].to_pylist()]


def block_words(held: DataFrame) -> DataFrame:
    """block, word, n (its count in the block's training rows, 0 if it only occurs elsewhere)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in contiguous_groups(batches, ["block"]):
            counts: Counter = Counter()
            other: set = set()
            for raw, train in zip(_texts(t), t["train"].to_pylist(), strict=True):
                if train:
                    counts.update(raw.split())
                else:
                    other.update(raw.split())
            for w in other:
                counts.setdefault(w, 0)
            block = t["block"][0].as_py()
            names = list(counts)
            for k in range(0, len(names), 50_000):
                part = names[k:k + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(part), pa.int64()), pa.array(part, pa.binary()),
                     pa.array([counts[w] for w in part], pa.int64())], ["block", "word", "n"])

    return held.mapInArrow(run, "block long, word binary, n long")


def counted_words(words: DataFrame) -> DataFrame:
    """word, n (count over all blocks), blocks (those it occurs in): one row per word, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_runs(batches, "word"):
            name, n = t["word"].combine_chunks(), t["n"].to_numpy()
            if isinstance(name, pa.ChunkedArray):
                name = name.combine_chunks()
            code = name.dictionary_encode().indices.to_numpy()  # sorted by word: 0, 0, 1, ...
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            blocks = pa.ListArray.from_arrays(pa.array(np.append(first, len(code)), pa.int32()), pa.array(t["block"].to_numpy()))
            yield pa.RecordBatch.from_arrays([name.take(pa.array(first)), pa.array(np.add.reduceat(n, first)), blocks],
                                             ["word", "n", "blocks"])

    placed = words.repartition(tasks(words), "word").sortWithinPartitions("word")
    return cut_lineage(placed.mapInArrow(run, "word binary, n long, blocks array<bigint>"))


def learn_pieces(types: DataFrame, loaded: tuple, rounds: int = ROUNDS) -> tuple[list[float], list[float]]:
    """Log probabilities of the pieces and of the 256 byte pieces after ``rounds`` of EM over the words ``types``.

    Each word counts once.  A round adds up over all words how often each piece is used on average in
    their segmentations; only these sums, one per piece, come to the driver.  The weights ``loaded`` go
    along as one use per piece on average, so no piece is left without probability.
    """
    spark = types.sparkSession
    pieces, logs, byte_logs, end = loaded
    first = np.exp(np.append(logs, np.log(256) + byte_logs[0]))
    first /= first.sum()
    now = first
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, np.log(now[:-1]), [float(np.log(now[-1] / 256))]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice, total = None, None
            for b in batches:
                lattice = lattice or Lattice(*shared.value)
                used = lattice.expected([w.decode("utf-8") for w in b["word"].to_pylist()]) if b.num_rows else 0
                total = used if total is None else total + used
            if lattice is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "uses"])

        uses = np.zeros(len(pieces) + 4)
        for r in types.select("word").mapInArrow(run, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            uses[r["piece"]] = r["uses"]
        of_bytes = float(uses[len(pieces):] @ np.arange(1, 5))
        now = np.append(uses[:len(pieces)], of_bytes) + first * len(first)
        now /= now.sum()
        shared.destroy()
    return np.log(now[:-1]).tolist(), [float(np.log(now[-1] / 256))] * 256


def dictionaries(words: DataFrame, model) -> DataFrame:
    """block, h (word hash), n (count over all blocks), log10 probability of each block's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, logs, byte_logs, seen, discount, n_distinct = model.value
        lattice = Lattice(pieces, logs, byte_logs)
        for b in batches:
            if not b.num_rows:
                continue
            names, n = b["word"].to_pylist(), b["n"].to_numpy()
            spelt = lattice.word_logs([w.decode("utf-8") for w in names])
            if seen:
                with np.errstate(divide="ignore"):  # a word that does not occur in training: spelling alone
                    counted = np.log10(np.maximum(n - discount, 0) / seen)
                spelt = np.logaddexp2(counted * LOG2_10, (spelt + np.log10(discount * n_distinct / seen)) * LOG2_10) / LOG2_10
            h = np.array([xxhash.xxh64_intdigest(w) for w in names], np.uint64).view(np.int64)
            at = np.repeat(np.arange(len(names)), b["blocks"].value_lengths().to_numpy())
            yield pa.RecordBatch.from_arrays([b["blocks"].flatten(), pa.array(h[at]), pa.array(n[at]), pa.array(spelt[at])],
                                             ["block", "h", "n", "marginal"])

    return words.mapInArrow(run, "block long, h long, n long, marginal double")


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text",
          path: str | None = None) -> DataFrame:
    """One row per row: id, train, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words of the whole text (A-Z lower-cased) and one end.  ``base_score`` is the
    add-0.1 unigram log10 probability from the counts of the training rows.  ``score`` is the log10
    probability of the text under the model learned from them: a token of count c has
    (c - d + d V q) / N, where q is the marginal over all segmentations of the word (the end has none)
    into pieces whose probabilities EM learned from the V training words, and the discount d, between
    0 and 1, comes from the words that occur once and twice.  Without a training row, the pieces keep
    the file's weights and q is the probability.  Null, empty and blank texts have the end alone; a null id
    is scored like any other; rows whose ``train`` is null train.  An empty table gives no rows.
    """
    spark: SparkSession = docs.sparkSession
    pieces, logs, byte_logs, end = load_pieces(path)
    held = blocks(docs, id_col, text_col, train)
    words = counted_words(block_words(held))
    ends = held.agg(F.sum(F.col("train").cast("long")).alias("n")).first()["n"] or 0
    known_words = words.where("n > 0")
    of = known_words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"),
                         F.count(F.when(F.col("n") == 1, 1)).alias("once"), F.count(F.when(F.col("n") == 2, 1)).alias("twice")).first()
    n_train = of["n"] + ends
    n_distinct = of["v"] + (1 if ends else 0)
    discount = (of["once"] + 1) / (of["once"] + 2 * of["twice"] + 2)
    end_log = end / float(np.log(10))
    if n_train:
        logs, byte_logs = learn_pieces(known_words, (pieces, logs, byte_logs, end))
        end_log = float(np.log10((ends - discount) / n_train))
    # a vocabulary's size, not the data's
    model = spark.sparkContext.broadcast((pieces, logs, byte_logs, n_train, discount, n_distinct))
    found = dictionaries(words, model)

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        order = np.argsort(known["h"].to_numpy())
        h = known["h"].to_numpy()[order]
        n = known["n"].to_numpy()[order]
        marginal = known["marginal"].to_numpy()[order]
        raw = _texts(texts)
        number: dict[bytes, int] = {}
        rows = []
        for r in raw:
            ws = r.split()
            for w in ws:
                if w not in number:
                    number[w] = len(number)
            rows.append(np.fromiter(map(number.__getitem__, ws), np.int64, len(ws)))
        digest = np.array([xxhash.xxh64_intdigest(w) for w in number], np.uint64).view(np.int64)
        at = np.searchsorted(h, digest)
        n, marginal = n[at], marginal[at]
        base = np.log10(n + SMOOTH)
        return pa.table({
            "id": texts["id"], "train": texts["train"],
            "n_words": pa.array([len(r) for r in rows], pa.int64()),
            "known": pa.array([int((n[r] > 0).sum()) for r in rows], pa.int64()),
            "base": pa.array([float(base[r].sum()) for r in rows], pa.float64()),
            "marginal": pa.array([float(marginal[r].sum()) for r in rows], pa.float64())})

    by_block = held.groupBy("block").cogroup(found.groupBy("block"))
    scored = by_block.applyInArrow(run, "id long, train boolean, n_words long, known long, base double, marginal double")
    n_tokens = F.col("n_words") + 1
    base = (F.col("base") + F.lit(float(np.log10(ends + SMOOTH)))
            - n_tokens * F.lit(float(np.log10(n_train + SMOOTH * (n_distinct + 1)))))
    return scored.select(
        F.col("id").alias(id_col), "train", n_tokens.alias("n_tokens"),
        (F.col("known") + F.lit(1 if ends else 0)).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        base.alias("base_score"), (F.col("marginal") + F.lit(end_log)).alias("score"))
