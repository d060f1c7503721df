"""Language of words and documents by a linear-chain conditional random field.

Every word of a text is labelled: hashed affix, character n-gram and whole-word features and the lexicons
of the languages (words of ``LEXICON_ROWS`` fit rows or more) score the word, learned start weights and transitions
score first words and neighbours, and forward-backward gives each word's
posterior, so code-switched texts get one language per word.  Transitions learn switches from segments of two rows put
end to end, a share ``SWITCHED`` of all segments.  A document's language is the one
with the largest mean posterior over its words.  A run of more than ``PIECE`` letters (scripts
without spaces, texts without separators) counts as several words: it is divided into consecutive
pieces of about equal size that together hold every letter and every n-gram of the run.

The field is fitted on a bounded, documented sample by mini-batch gradient steps on the driver: of
every language the same number of rows with the smallest hashes (``TRAIN_DOCS`` over the number of
languages, at least ``LABEL_DOCS``), of long texts ``CUTS`` spread stretches.  Labelling covers every whole text and needs no shuffle.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import broadcast_if_small
from .common import bounded_batches, gives_back, slices

TRAIN_DOCS = 1500  # labelled rows the fit reads, shared evenly by the languages
LABEL_DOCS = 50  # rows a language has in the fit at least, as far as there are any
TRAIN_CHARS = 20_000  # letters and signs of a text that the fit reads
CUTS = 20  # stretches of equal length that a longer text gives instead
FEATURES = 1 << 16
SEGMENT = 24  # words of a training segment
PIECE = 48  # letters of a run that is one word; longer runs are divided into pieces
EPOCHS = 4
LEXICON_ROWS = 3  # fit rows of a language that a word of its lexicon is in
SWITCHED = 0.25  # segments that the fit also sees followed by a segment of another row
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
CACHE_WORDS = 200_000
SLICE_CHARS = 1 << 20


@dataclass(frozen=True)
class Crf:
    """Learned weights: (features x labels), transitions, start weights; a few MB at most.

    ``lexicon`` gives the labels of the words in some lexicon; the bound on the fit's rows and letters bounds it.
    """

    labels: list[str]
    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray
    lexicon: dict[str, list[str]] = field(default_factory=dict)


def text_words(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return _LETTERS.findall(text.lower()) if text else []


def pieces(word: str) -> list[str | tuple[str, str, str]]:
    """The word, or the pieces of a longer run: (letters, what stands before, what follows).

    Nothing stands before an inner piece, whose n-grams begin with its own letters; the next two
    letters follow it, so n-grams across a border are taken once.
    """
    if len(word) <= PIECE:
        return [word]
    n = -(-len(word) // PIECE)
    at = [i * len(word) // n for i in range(n + 1)]
    return [(word[a:b], "" if a else "^", word[b:b + 2] or "$") for a, b in zip(at, at[1:])]


def word_features(word: str, before: str = "^", after: str = "$") -> list[int]:
    """Hashed features: whole word, prefixes and suffixes up to 4, character 2- and 3-grams.

    Prefixes are taken where the run of letters starts, suffixes where it ends.
    """
    edged = before + word + after
    own = len(before + word)  # n-grams that begin further on are the next piece's
    feats = ["w" + word]
    for k in (1, 2, 3, 4):
        if len(word) >= k:
            if before:
                feats.append(f"p{word[:k]}")
            if after == "$":
                feats.append(f"s{word[-k:]}")
    feats += ["2" + edged[i:i + 2] for i in range(min(own, len(edged) - 1))]
    feats += ["3" + edged[i:i + 3] for i in range(min(own, len(edged) - 2))]
    return [zlib.crc32(f.encode()) % FEATURES for f in feats]


class _Words:
    """Numbers of words and pieces and their feature rows (flat ids, offsets), filled as they are met."""

    def __init__(self, lexicon: dict[str, list[str]]):
        self.lexicon = lexicon
        self.number: dict[str | tuple[str, str, str], int] = {}
        self.flat = array("i")
        self.ends = array("q")

    def look(self, words: list[str]) -> np.ndarray:
        """The numbers of the words, one for each piece of a longer run."""
        if words and max(map(len, words)) > PIECE:
            words = [p for w in words for p in pieces(w)]
        out = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            n = self.number.get(w)
            if n is None:
                n = self.number[w] = len(self.number)
                self.flat.extend(word_features(w) if isinstance(w, str) else word_features(*w))
                self.flat.extend(zlib.crc32(f"l{x}".encode()) % FEATURES for x in self.lexicon.get(w, ()))
                self.ends.append(len(self.flat))
            out[i] = n
        return out


def _means(emit: np.ndarray, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.add.reduceat(emit[flat], starts, axis=0) / np.sqrt(sizes)[:, None]


def forward_backward(score: np.ndarray, lengths: np.ndarray, move: np.ndarray, start: np.ndarray):
    """Scaled forward and backward messages of many sequences at once: (alpha, beta, like, step).

    ``score`` (words x labels) holds the sequences one after the other; every message is scaled
    to sum one, so texts of any length neither under- nor overflow.  Longest first: step t
    handles the sequences that still have a word t.
    """
    n_labels = score.shape[1]
    order = np.argsort(-lengths, kind="stable")
    length = lengths[order]
    first = (np.cumsum(lengths) - lengths)[order]
    like = score - score.max(axis=1, keepdims=True)
    np.exp(like, out=like)
    step, begin = np.exp(move - move.max()), np.exp(start - start.max())
    alpha, beta = np.empty_like(like), np.ones_like(like)
    longest = int(length[0]) if len(length) else 0
    alive_at = np.searchsorted(-length, -np.arange(longest), side="left")  # sequences longer than t
    a = np.empty((0, n_labels))
    for t in range(longest):
        alive = alive_at[t]
        at = first[:alive] + t
        a = (begin if t == 0 else a[:alive] @ step) * like[at]
        a = a / a.sum(axis=1, keepdims=True)
        alpha[at] = a
    b = np.empty((0, n_labels))
    for t in range(longest - 2, -1, -1):
        alive = alive_at[t + 1]
        at = first[:alive] + t
        if len(b) < alive:  # sequences that end here join in
            b = np.concatenate([b, np.ones((alive - len(b), n_labels))])
        b = (b * like[at + 1]) @ step.T
        b = b / b.sum(axis=1, keepdims=True)
        beta[at] = b
    return alpha, beta, like, step


def posteriors(score: np.ndarray, lengths: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Probability of each label at each word given the whole sequence."""
    alpha, beta, _, _ = forward_backward(score, lengths, move, start)
    alpha *= beta
    alpha /= alpha.sum(axis=1, keepdims=True)
    return alpha


def lexicons(split: list[tuple[str, list[list[str]]]]) -> dict[str, list[str]]:
    """The languages in whose rows (language, stretches of words) each word is often enough, in order."""
    seen = Counter((w, l) for l, stretches in split for w in set().union(*stretches))
    out: dict[str, list[str]] = {}
    for w, l in sorted(x for x, n in seen.items() if n >= LEXICON_ROWS):
        out.setdefault(w, []).append(l)
    return out


def _sample(some: DataFrame, row_id: Column, text: Column, lang: Column, sizes: dict[str, int], k: int,
            max_chars: int) -> list[Row]:
    """(hash, label, stretches of the text) of the ``k`` smallest hashes of every label."""
    spark = some.sparkSession
    hashed = some.where(text.isNotNull()).select(F.xxhash64(row_id, text).alias("h"), text.alias("t"), lang.alias("l"))

    def below(bounds: dict[str, int]) -> DataFrame:
        limits = spark.createDataFrame(list(bounds.items()), "l string, most long")
        return hashed.join(broadcast_if_small(limits), "l").where(F.col("h") <= F.col("most"))

    # hashes alone, of a share of the rows that holds k of a label but for rare cases; those get a larger one
    share = {l: (k + 6 * k ** 0.5 + 20) / n for l, n in sizes.items()}
    last: dict[str, int] = {}
    while share:
        bounds = {l: min((1 << 63) - 1, int(s * (1 << 64)) - (1 << 63)) for l, s in share.items()}
        found: dict[str, list[int]] = {l: [] for l in share}
        for r in below(bounds).select("l", "h").distinct().collect():
            found[r["l"]].append(r["h"])
        last |= {l: sorted(hs)[:k][-1] for l, hs in found.items() if hs and (len(hs) >= k or share[l] >= 1)}
        share = {l: 8 * s for l, s in share.items() if s < 1 and len(found[l]) < k}
    if not last:
        return []
    n = F.length("t").cast("long")
    cut = max_chars // CUTS
    spread = F.transform(F.sequence(F.lit(0), F.lit(CUTS - 1)),
                         lambda i: F.col("t").substr((F.floor(i * (n - cut) / (CUTS - 1)) + 1).cast("int"), F.lit(cut)))
    stretches = F.when(n <= max_chars, F.array("t")).otherwise(spread)
    return sorted(below(last).select("h", "l", stretches.alias("t")).dropDuplicates(["h", "l"]).collect())


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        max_docs: int = TRAIN_DOCS, max_chars: int = TRAIN_CHARS, seed: int = 5) -> Crf:
    """Fit on the rows with text and label that have the smallest hashes of their language.

    Each language gives its share of ``max_docs`` rows, ``LABEL_DOCS`` at least, each row
    ``max_chars`` characters at most; equal rows count once.  Learning without a labelled word
    gives a field without labels, which answers ``und``.
    """
    some = labelled.where(F.col(lang_col).isNotNull())
    sizes = dict(some.groupBy(F.col(lang_col).alias("l")).count().collect())
    rows = _sample(some, F.col(id_col), F.col(text_col), F.col(lang_col), sizes,
                   max(LABEL_DOCS, -(-max_docs // len(sizes))), max_chars) if sizes else []
    split = [(r["l"], [text_words(t) for t in r["t"]]) for r in rows]
    # the words at the borders of a stretch may be cut
    split = [(l, got if len(got) == 1 else [w[1:-1] or w for w in got]) for l, got in split]
    labels = sorted({l for l, got in split if any(got)})
    n_labels = max(1, len(labels))
    lexicon = lexicons(split)
    words, ids, tags = _Words(lexicon), [], []
    for label, stretches in split:
        for got in map(words.look, stretches):
            for k in range(0, len(got), SEGMENT):
                ids.append(got[k:k + SEGMENT])
                tags.append(np.full(len(ids[-1]), labels.index(label)))
    emit, move, start = np.zeros((FEATURES, n_labels)), np.zeros((n_labels, n_labels)), np.zeros(n_labels)
    if not ids or n_labels == 1:
        return Crf(labels, emit, move, start, lexicon)
    flat, ends = np.array(words.flat), np.array(words.ends)
    rng = np.random.default_rng(seed)
    for i, j in zip(rng.permutation(len(ids))[:int(SWITCHED * len(ids))], rng.permutation(len(ids))):
        ids.append(np.concatenate([ids[i], ids[j]]))
        tags.append(np.concatenate([tags[i], tags[j]]))
    lengths = np.array([len(x) for x in ids])
    g_emit, g_move, g_start = np.full((FEATURES, n_labels), 1e-6), np.full((n_labels, n_labels), 1e-6), np.full(n_labels, 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(len(ids))
        for k in range(0, len(order), 256):
            pick = order[k:k + 256]
            seq, size = np.concatenate([ids[i] for i in pick]), lengths[pick]
            # the distinct words of the step and their features
            uniq, back = np.unique(seq, return_inverse=True)
            w_end = ends[uniq]
            w_start = np.where(uniq > 0, ends[uniq - 1], 0)
            sizes = w_end - w_start
            rows_ = np.repeat(w_start - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
            f = flat[rows_]
            f_start = np.cumsum(sizes) - sizes
            score = _means(emit, f, f_start, sizes)[back]
            alpha, beta, like, step = forward_backward(score, size, move, start)
            post = alpha * beta
            post /= post.sum(axis=1, keepdims=True)
            target = np.zeros_like(post)
            y = np.concatenate([tags[i] for i in pick])
            target[np.arange(len(y)), y] = 1
            # gradient of the log-likelihood: observed minus expected
            per_word = np.zeros((len(uniq), n_labels))
            np.add.at(per_word, back, target - post)
            grad = np.repeat(per_word / np.sqrt(sizes)[:, None], sizes, axis=0)
            touched, f_back = np.unique(f, return_inverse=True)
            g = np.zeros((len(touched), n_labels))
            np.add.at(g, f_back, grad)
            g = g / len(pick) - 1e-6 * emit[touched]
            g_emit[touched] += g * g
            emit[touched] += 0.5 * g / np.sqrt(g_emit[touched])
            # neighbours: observed pair counts minus the expected ones
            inner = np.ones(len(y), bool)
            inner[np.cumsum(size) - 1] = False
            at = np.flatnonzero(inner)
            both = alpha[at][:, :, None] * step[None] * (like[at + 1] * beta[at + 1])[:, None, :]
            both /= both.sum(axis=(1, 2), keepdims=True)
            pair = (target[at].T @ target[at + 1] - both.sum(axis=0)) / len(pick)
            g_move += pair * pair
            move += 0.1 * pair / np.sqrt(g_move)
            begin = np.cumsum(size) - size
            first = (target[begin] - post[begin]).sum(axis=0) / len(pick)
            g_start += first * first
            start += 0.1 * first / np.sqrt(g_start)
    np.clip(move, -6, 6, out=move)
    np.clip(start, -6, 6, out=start)
    return Crf(labels, emit.astype(np.float32), move, start, lexicon)


def _label(texts: list[str | None], crf: Crf, words: _Words, scores: list[np.ndarray]):
    """(posteriors of the words and pieces, how many each text has) of a list of texts."""
    ids = [words.look(text_words(t)) for t in texts]
    if len(words.ends):  # words met for the first time; their features are not needed again
        ends = np.array(words.ends)
        starts = np.append(0, ends[:-1])
        new = np.concatenate([_means(crf.emit, np.array(words.flat[starts[k]:ends[min(k + 8192, len(ends)) - 1]]),
                                     starts[k:k + 8192] - starts[k], (ends - starts)[k:k + 8192])
                              for k in range(0, len(ends), 8192)])
        scores.append(new.astype(np.float32))
        words.flat, words.ends = array("i"), array("q")
    table = np.concatenate(scores) if len(scores) > 1 else scores[0] if scores else np.empty((0, len(crf.labels)))
    scores[:] = [table]
    lengths = np.array([len(x) for x in ids], np.int64)
    used = np.concatenate(ids) if ids else np.empty(0, np.int64)
    filled = lengths[lengths > 0]
    post = posteriors(table[used], filled, crf.move, crf.start) if len(used) else np.empty((0, len(crf.labels)))
    return post, lengths


def predict(df: DataFrame, crf: Crf, text_col: str = "text", pred_col: str = "lang_pred",
            score_col: str = "score", words_col: str | None = None, sure_col: str | None = None) -> DataFrame:
    """Add the document's language and its mean posterior; with ``words_col`` also the language
    of every word (array, in text order), with ``sure_col`` also the mean over the words of each
    word's largest posterior, whichever language that is.

    A null text, a text without letters, and any text under a field without labels are ``und``
    with scores 0.  Equal means go to the label that sorts first.  Columns of the result's names
    are replaced, all others pass through.
    """
    new = [pred_col, score_col, *([words_col] if words_col else []), *([sure_col] if sure_col else [])]
    df = df.drop(*[c for c in new if c in df.columns])
    # plain arrays: broadcasts are unpickled where this package need not be installed
    model = df.sparkSession.sparkContext.broadcast(vars(crf))
    fields = [T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())]
    if words_col:
        fields.append(T.StructField(words_col, T.ArrayType(T.StringType())))
    if sure_col:
        fields.append(T.StructField(sure_col, T.DoubleType()))

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Crf(**model.value)
        words, scores = _Words(m.lexicon), []
        for whole in batches:
            for b in slices(whole, text_col, SLICE_CHARS):
                if len(words.number) > CACHE_WORDS:
                    words, scores = _Words(m.lexicon), []
                texts = b[text_col].to_pylist()
                langs, values, tags = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
                sure = [0.0] * len(texts)
                if m.labels:
                    post, lengths = _label(texts, m, words, scores)
                    at = 0
                    for i, n in enumerate(lengths):
                        if n:
                            mean = post[at:at + n].mean(axis=0)
                            best = int(mean.argmax())
                            langs[i], values[i] = m.labels[best], min(1.0, float(mean[best]))
                            if sure_col:
                                sure[i] = min(1.0, float(post[at:at + n].max(axis=1).mean()))
                            if words_col:
                                parts = np.array([-(-len(w) // PIECE) for w in text_words(texts[i])])
                                by_word = np.add.reduceat(post[at:at + n], np.cumsum(parts) - parts, axis=0)
                                tags[i] = [m.labels[j] for j in by_word.argmax(axis=1)]
                        at += n
                cols = [pa.array(langs, pa.string()), pa.array(values, pa.float64())]
                if words_col:
                    cols.append(pa.array(tags, pa.list_(pa.string())))
                if sure_col:
                    cols.append(pa.array(sure, pa.float64()))
                yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *new])

    return bounded_batches(df).mapInArrow(run, T.StructType([*df.schema.fields, *fields]))
