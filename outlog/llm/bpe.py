"""BPE encoding and decoding with an existing vocabulary, by batched numpy merge rounds.

The distinct pre-tokens of an Arrow batch are encoded together: their symbols lie in one flat
array, and in every round the adjacent pairs are looked up by binary search over the sorted
pair keys of the merge list; each word merges its lowest-ranked pair until no word has one.
Encoded words are remembered within a task (a bounded memory that is emptied when full, so
results never depend on it).  No shuffle: texts are encoded where they are read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import bounded_batches, gives_back, slices, spread

TOKENIZER = "word_bpe_49k.json"
# Fixed values of the vocabulary file's normalizer and pre-tokenizer.
SPACE_CHARS = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACE_CHARS + r"\p{L}\p{N}]+"
NO_RANK = np.iinfo(np.int64).max
CACHE_WORDS = 200_000
SLICE = 1 << 20  # characters or ids worked on at once


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def byte_alphabet() -> list[str]:
    """One printable character per byte: printable Latin-1 bytes stand for themselves, the others
    take the code points from 256 on, in byte order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars = {b: chr(b) for b in printable}
    rest = [b for b in range(256) if b not in chars]
    chars.update({b: chr(256 + i) for i, b in enumerate(rest)})
    return [chars[b] for b in range(256)]


class Bpe:
    """Tables of one vocabulary file: plain arrays, built once per task from the file's text."""

    def __init__(self, spec: str):
        raw = json.loads(spec)
        model = raw["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        alphabet = byte_alphabet()
        self.inner = np.array([vocab[c] for c in alphabet], np.int64)
        self.final = np.array([vocab[c + end] for c in alphabet], np.int64)
        self.special = {t["content"]: t["id"] for t in raw["added_tokens"]}
        self.base = 1 + max([*vocab.values(), *self.special.values()])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        product = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left * self.base + right
        # a pair listed twice keeps its last rank, as a mapping would
        self.keys, last = np.unique(keys[::-1], return_index=True)
        self.rank_of = (len(pairs) - 1 - last).astype(np.int64)
        self.product = product
        # Merging every occurrence of a pair in one round equals merging one at a time unless the
        # product takes part in a merge of a lower rank; such ranks are merged leftmost first.
        first_use = np.full(self.base, NO_RANK, np.int64)
        np.minimum.at(first_use, left, np.arange(len(pairs)))
        np.minimum.at(first_use, right, np.arange(len(pairs)))
        self.one_by_one = first_use[product] <= np.arange(len(pairs))
        self.tokens = [""] * self.base
        for t, i in vocab.items():
            self.tokens[i] = t
        for t, i in self.special.items():
            self.tokens[i] = t
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pretoken = regex.compile(PRETOKEN)

    # -- text to words -------------------------------------------------------------------

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text; special tokens come out whole, marked by a leading NUL pair."""
        if self.split_special is None or "<|" not in text:
            return self.plain_pieces(text)
        out: list[str] = []
        for part in self.split_special.split(text):
            if part in self.special:
                out.append("\0\0" + part)
            elif part:
                out += self.plain_pieces(part)
        return out

    def plain_pieces(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower() is per character
        # no pre-token holds white space, so how much of it stands between them does not matter
        return self.pretoken.findall(text.lower())

    # -- words to ids --------------------------------------------------------------------

    def encode_words(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each): merge rounds over all
        words of the batch at once."""
        if not batch:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        raw = [w.encode("utf-8") for w in batch]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[flat]
        ends = np.cumsum(size)
        symbols[ends - 1] = self.final[flat[ends - 1]]
        owner = np.repeat(np.arange(len(raw)), size)
        done_symbols, done_owner = [], []
        rank = np.full(len(symbols), NO_RANK)  # of the pair that starts here
        self._look_up(rank, symbols, owner, np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(symbols))))
            active = best != NO_RANK
            if not active.all():
                done_symbols.append(symbols[~active])
                done_owner.append(owner[~active])
                symbols, owner, rank, best = symbols[active], owner[active], rank[active], best[active]
                if not len(symbols):
                    break
            hit = self._not_overlapping(rank == best)
            self._leftmost_only(hit, rank, owner)
            merged = np.flatnonzero(hit)
            symbols[merged] = self.product[rank[merged]]
            keep = np.ones(len(symbols), bool)
            keep[merged + 1] = False
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            # only the pairs that a merged symbol takes part in have changed
            at = merged - np.arange(len(merged))
            self._look_up(rank, symbols, owner, np.union1d(at, at[at > 0] - 1))
        all_symbols = np.concatenate(done_symbols) if done_symbols else symbols
        all_owner = np.concatenate(done_owner) if done_owner else owner
        order = np.argsort(all_owner, kind="stable")
        counts = np.bincount(all_owner, minlength=len(raw))
        return all_symbols[order].astype(np.int32), counts

    def _look_up(self, rank: np.ndarray, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> None:
        """Set the ranks of the pairs that start at the places ``at``."""
        rank[at] = NO_RANK
        at = at[at + 1 < len(symbols)]
        at = at[owner[at] == owner[at + 1]]
        key = symbols[at] * self.base + symbols[at + 1]
        place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        rank[at] = np.where(self.keys[place] == key, self.rank_of[place], NO_RANK)

    @staticmethod
    def _not_overlapping(hit: np.ndarray) -> np.ndarray:
        """In a run of adjacent hits (a repeated symbol) take the first, third, ... only."""
        at = np.flatnonzero(hit)
        if len(at) < 2 or not (np.diff(at) == 1).any():
            return hit
        new_run = np.append(True, np.diff(at) != 1)
        run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
        hit = hit.copy()
        hit[at[(np.arange(len(at)) - run_start) % 2 == 1]] = False
        return hit

    def _leftmost_only(self, hit: np.ndarray, rank: np.ndarray, owner: np.ndarray) -> None:
        at = np.flatnonzero(hit)
        at = at[self.one_by_one[rank[at]]]
        if len(at) > 1:
            hit[at[np.append(False, owner[at[1:]] == owner[at[:-1]])]] = False


class _Encoder:
    """Words of texts to ids with a bounded memory of encoded words."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.empty(0, np.int32)
        self.size = np.empty(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        special = [w for w in new if w.startswith("\0\0") and w[2:] in self.bpe.special]
        plain = [w for w in new if not (w.startswith("\0\0") and w[2:] in self.bpe.special)]
        ids, size = self.bpe.encode_words(plain)
        for w in [*plain, *special]:
            self.number[w] = len(self.number)
        self.ids = np.concatenate([self.ids, ids, np.array([self.bpe.special[w[2:]] for w in special], np.int32)])
        self.size = np.concatenate([self.size, size, np.ones(len(special), np.int64)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets of the texts)."""
        split = [self.bpe.pieces(t) if t else [] for t in texts]
        if len(self.number) > CACHE_WORDS or len(self.ids) > 8 * CACHE_WORDS:
            self._forget()
        known = self.number
        new = [w for w in set(chain.from_iterable(split)) if w not in known]
        if new:
            self._learn(new)
        words = np.fromiter(map(len, split), np.int64, len(split))
        used = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(words.sum()))
        size = self.size[used]
        flat = self.ids[spread((np.cumsum(self.size) - self.size)[used], size)]
        ends = np.append(0, np.cumsum(size))[np.cumsum(words)]
        return flat, np.append(0, ends)


def load(spark: SparkSession, path: str | None = None):
    """The vocabulary file's text as a Spark broadcast (a vocabulary's size, not the data's)."""
    with open(path or default_path(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoding(spec, text_col: str, ids_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        enc = _Encoder(Bpe(spec.value))
        for whole in batches:
            for b in slices(whole, text_col, SLICE):
                flat, offsets = enc.encode(b[text_col].to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, ids_col])

    return run


def _decoding(spec, ids_col: str, out_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        tokens = np.array([*Bpe(spec.value).tokens, None], object)
        for whole in batches:
            for b in slices(whole, ids_col, SLICE):
                col = b[ids_col]
                size = pc.list_value_length(col).fill_null(0).to_numpy(zero_copy_only=False)
                ids = col.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                ids = np.where((ids < 0) | (ids >= len(tokens) - 1), len(tokens) - 1, ids)
                names, ends, strange = tokens[ids], np.cumsum(size), (ids == len(tokens) - 1).any()
                texts = []
                for start, end in zip((ends - size).tolist(), ends.tolist(), strict=True):
                    part = names[start:end].tolist()
                    texts.append(" ".join([x for x in part if x is not None] if strange else part))
                out = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns, out], [*b.schema.names, out_col])

    return run


def encode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Add ``ids_col`` (array<int>): the ids of every whole text, no special tokens added.

    Null and empty texts get an empty array; the strings of special tokens in a text give their
    ids.  Other columns pass through; one named ``ids_col`` is replaced.
    """
    spec = load(df.sparkSession, path)
    df = df.drop(ids_col) if ids_col in df.columns else df
    fields = [*df.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]
    return bounded_batches(df).mapInArrow(gives_back(_encoding(spec, text_col, ids_col)), T.StructType(fields))


def decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", path: str | None = None) -> DataFrame:
    """Add ``out_col``: the tokens of the ids joined by single spaces (special tokens included).

    The vocabulary has no decoder of its own, so end-of-word marks stay.  Empty or null ids give
    the empty text; an id outside the vocabulary gives no token.
    """
    spec = load(df.sparkSession, path)
    df = df.drop(out_col) if out_col in df.columns else df
    fields = [*df.schema.fields, T.StructField(out_col, T.StringType())]
    return bounded_batches(df).mapInArrow(gives_back(_decoding(spec, ids_col, out_col)), T.StructType(fields))


def encode_decode(df: DataFrame, text_col: str = "text", ids_col: str = "ids", out_col: str = "decoded",
                  path: str | None = None) -> DataFrame:
    """``decode`` of ``encode`` in one pass, so a task has one Python worker and not one for each."""
    spec = load(df.sparkSession, path)
    df = df.drop(*[c for c in (ids_col, out_col) if c in df.columns])
    there, back = _encoding(spec, text_col, ids_col), _decoding(spec, ids_col, out_col)
    fields = [*df.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType())), T.StructField(out_col, T.StringType())]
    return bounded_batches(df).mapInArrow(gives_back(lambda batches: back(there(batches))), T.StructType(fields))
