"""Periodic runs of words: recursive frequency splitting, then a scan of lags.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at least
``max(MIN_WORDS, 2 q)`` words that no neighbouring word extends.  Every word of a run is found in it twice
at least, so a word met only once in a segment belongs to no run of that segment: such words split it.
The pieces are smaller, their words rarer, and the splitting goes on until no segment changes; segments of
fewer than ``MIN_WORDS`` words go.

What is left is scanned for lags.  Lags below 8 are compared word by word.  A longer lag q with
``2^j <= q < 2^(j+1)`` can only be a run's period where 2^j consecutive words come again q words later, so
of these only the positions whose next 2^j words recur at that distance are compared; equal stretches of
2^j words get equal numbers by doubling.  Neighbouring positions of one lag form the run.  What lies inside
a known run of smaller period has that period and is passed over, which also keeps the work near n log n on
texts that repeat throughout.

Tasks hold one Arrow batch, all of whose documents are worked on together as one flat array; nothing is
shuffled, and a document is never cut.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, spread

MIN_WORDS = 12
RESULT = ("n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
          "collapsed_sha256 string")
SLICE_CHARS = 1 << 20


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False,
                  keep_text: bool = False) -> DataFrame:
    """Per row of ``docs``: its id, the runs of its whole text in numbers and digests, see ``RESULT``.

    Words are ``[^\\x20\\x09-\\x0D]+``.  ``start``, ``length``, ``period`` and ``exponent_milli`` are those of
    the longest run (ties: smallest start, then period), null without a run.  ``runs_sha256`` digests all runs
    as lines ``start,length,period``; ``collapsed_sha256`` the words left when every run keeps only its first
    period, joined by one space - ``keep_text`` returns that text as ``collapsed`` and the runs as ``runs``.
    ``plant`` first repeats part of one document in ten by id, as a test of known repeats.
    Null and empty texts have no words and no run; rows without id are not planted.  Rows are judged one by
    one: repeated rows give repeated results, other columns are not read, an empty table gives no rows.
    """
    more = ", runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string" if keep_text else ""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", SLICE_CHARS):
                yield judge(piece, plant, keep_text)

    return bounded_batches(slim).mapInArrow(work, f"`{id_col}` {kind}, {RESULT}{more}")


def judge(batch: pa.RecordBatch, plant: bool, keep_text: bool) -> pa.RecordBatch:
    """One row for every document of a batch."""
    ids = batch.column(0)
    lists = [t.split() for t in pc.cast(batch.column(1), pa.binary()).to_pylist()]   # bytes split at ASCII white space
    counts = np.array([len(w) for w in lists], np.int64)
    words = pa.array([w for ws in lists for w in ws], pa.large_binary())
    del lists
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(counts) - counts
    if plant:
        source = planted(ids.to_pylist(), counts, first)
        codes, words = codes[source], words.take(pa.array(source))
    doc = np.repeat(np.arange(len(counts)), counts)
    start, length, period = find_runs(codes, doc)

    drop = np.zeros(len(codes) + 1, np.int64)
    np.add.at(drop, start + period, 1)
    np.add.at(drop, start + length, -1)
    kept = np.flatnonzero(np.cumsum(drop)[:-1] == 0)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(doc[kept], minlength=len(counts)))]).astype(np.int64)
    texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds), words.take(pa.array(kept))),
                           pa.scalar(b" ", pa.large_binary())).to_pylist()

    of = doc[start] if len(start) else np.zeros(0, np.int64)
    start = start - first[of]
    order = np.lexsort((period, start, of))
    of, start, length, period = of[order], start[order], length[order], period[order]
    n_runs = np.bincount(of, minlength=len(counts))
    best = np.lexsort((period, start, -length, of))
    top = best[np.concatenate([[True], of[best][1:] != of[best][:-1]])] if len(best) else best
    lines = [f"{s},{m},{q}\n" for s, m, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)]
    ends = np.cumsum(n_runs)
    listed = ["".join(lines[e - k:e]) for e, k in zip(ends.tolist(), n_runs.tolist(), strict=True)]

    def of_top(values: np.ndarray) -> pa.Array:
        out, there = np.zeros(len(counts), np.int64), np.zeros(len(counts), bool)
        out[of[top]], there[of[top]] = values[top], True
        return pa.array(out, mask=~there)

    out = [ids, pa.array(n_runs), of_top(start), of_top(length), of_top(period),
           of_top(1000 * length // np.maximum(period, 1)),
           pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed]),
           pa.array([hashlib.sha256(x).hexdigest() for x in texts])]
    names = [batch.schema.names[0], "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    if keep_text:
        each = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        out += [pa.ListArray.from_arrays(pa.array(offsets), each), pa.array([x.decode() for x in texts])]
        names += ["runs", "collapsed"]
    return pa.record_batch(out, names)


def planted(ids: list, counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which word stands at every place once one document in ten repeats a stretch of its own.

    h = crc32(decimal id), g = h // 10; where h % 10 = 0, word i >= a becomes word a + (i - a) % p, with
    a = g % n and p = 1 + (n - a) // (3 + g % 8).
    """
    source = np.arange(int(counts.sum()))
    for i, n, f in zip(ids, counts.tolist(), first.tolist(), strict=True):
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            source[f + a:f + n] = f + a + np.arange(n - a) % p
    return source


def split_by_frequency(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that are left by recursive splitting, ascending, and the number of their segment.

    A place goes if its word is met only once in its segment, or if its segment has fewer than
    ``MIN_WORDS`` places; what a lost place parted are segments of their own.  Segments that lost
    nothing in a round are settled and not looked at again.
    """
    place, segment = np.arange(len(codes)), doc
    done_place, done_segment, label = [], [], int(doc[-1]) + 1 if len(doc) else 0
    while len(place):
        # a segment is a stretch of neighbouring places with one number
        cut = np.ones(len(place), bool)
        cut[1:] = (np.diff(place) != 1) | (np.diff(segment) != 0)
        piece = np.cumsum(cut) - 1
        size = np.bincount(piece)
        by = np.lexsort((codes[place], piece))
        p, c = piece[by], codes[place][by]
        same = (p[1:] == p[:-1]) & (c[1:] == c[:-1])
        again = np.zeros(len(by), bool)
        again[1:] |= same
        again[:-1] |= same
        good = np.zeros(len(by), bool)
        good[by] = again
        good &= size[piece] >= MIN_WORDS
        lost = np.bincount(piece, weights=~good, minlength=len(size)) > 0
        stable = ~lost[piece]
        done_place.append(place[stable])
        done_segment.append(piece[stable] + label)
        label += len(size)
        go = good & ~stable
        place, segment = place[go], piece[go]
    if not done_place:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, segment = np.concatenate(done_place), np.concatenate(done_segment)
    by = np.argsort(place, kind="stable")
    return place[by], segment[by]


class _Known:
    """Runs found so far, for the question which stretches one of them covers."""

    def __init__(self) -> None:
        self.start = self.stop = self.period = np.zeros(0, np.int64)
        self.reach = np.zeros(0, np.int64)

    def add(self, start: np.ndarray, stop: np.ndarray, period: np.ndarray) -> None:
        self.start, self.stop, self.period = (np.concatenate(x) for x in ((self.start, start), (self.stop, stop), (self.period, period)))
        by = np.argsort(self.start, kind="stable")
        self.start, self.stop, self.period = self.start[by], self.stop[by], self.period[by]
        self.reach = np.maximum.accumulate(self.stop)

    def reach_of(self, at: np.ndarray) -> np.ndarray:
        """The furthest end of a run that starts at or before each place (0: none)."""
        i = np.searchsorted(self.start, at, "right")
        return np.where(i > 0, self.reach[np.maximum(i - 1, 0)], 0) if len(self.start) else np.zeros(len(at), np.int64)


def find_runs(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs; ``codes`` are words, ``doc`` (ascending) never shares a run."""
    place, segment = split_by_frequency(codes, doc)
    known = _Known()
    if not len(place):
        return known.start, known.stop, known.period
    # neighbours of one segment stay neighbours: work on the places left, in their own numbering
    word = np.unique(codes[place], return_inverse=True)[1].astype(np.int64)
    n = len(place)
    last = np.flatnonzero(np.append(segment[1:] != segment[:-1], True))
    left = np.repeat(last, np.diff(np.concatenate([[-1], last]))) - np.arange(n) + 1     # words to the segment's end

    def accept(at: np.ndarray, matches: np.ndarray, q: np.ndarray) -> None:
        """Stretches of words equal to those q later: runs unless too short or of a smaller, known period."""
        size = matches + q
        ok = size >= np.maximum(MIN_WORDS, 2 * q)
        at, size, q = at[ok], size[ok], q[ok]
        ok = known.reach_of(at) < at + size
        if ok.any():
            known.add(at[ok], (at + size)[ok], q[ok])

    for q in range(1, 8):
        if n <= q:
            break
        equal = np.zeros(n + 2, bool)
        equal[1:n - q + 1] = (word[:-q] == word[q:]) & (left[:-q] > q)
        edge = np.flatnonzero(equal[1:] != equal[:-1])
        accept(edge[::2], edge[1::2] - edge[::2], np.full(len(edge) // 2, q))

    # numbers of stretches: 1, 2, 4, 8, ... words; a place without that many words left has none (-1)
    stretch, width = word, 1
    here = np.arange(n)
    while True:
        here = here[left[here] >= 2 * width]
        here = here[stretch[here + width] >= 0]
        if not len(here):
            break
        pair = stretch[here] * np.int64(n + 1) + stretch[here + width]
        number = np.full(n, -1, np.int64)
        number[here] = np.unique(pair, return_inverse=True)[1]
        stretch, width = number, 2 * width
        if width < 8:
            continue
        # a run of this class has 2 * width words; segments without that many are done
        by = here[np.lexsort((here, stretch[here]))]
        key = stretch[by] * np.int64(n + 1) + by
        # partners of a place: width .. 2 * width - 1 later, and not inside a known run that holds both stretches
        near = np.maximum(by + width, known.reach_of(by) - width + 1)
        lo = np.searchsorted(key, stretch[by] * np.int64(n + 1) + np.minimum(near, n))
        hi = np.searchsorted(key, stretch[by] * np.int64(n + 1) + np.minimum(by + 2 * width, n))
        many = np.maximum(hi - lo, 0)
        a, b = np.repeat(by, many), by[spread(lo, many)]
        ok = segment[a] == segment[b]
        a, q = a[ok], (b - a)[ok]
        by = np.lexsort((a, q))
        a, q = a[by], q[by]
        if len(a):
            cut = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (a[1:] != a[:-1] + 1)]))
            count = np.diff(np.append(cut, len(a)))
            accept(a[cut], count + width - 1, q[cut])
        here = _repeated(here, stretch)
    by = np.lexsort((known.period, known.start))
    return place[known.start[by]], (known.stop - known.start)[by], known.period[by]


def _repeated(here: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    """Places whose stretch is found at another place too, as every longer one that repeats must be."""
    _, back, count = np.unique(stretch[here], return_inverse=True, return_counts=True)
    return here[count[back] > 1]
