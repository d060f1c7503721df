"""Near-duplicate documents: MinHash banding, verification, components by alternating stars.

1. Every whole text becomes its set of word shingles and a signature of ``N_HASHES`` universal
   hash minima.  Rows with the same set form a class, represented by its smallest id.
2. Class representatives that share a band meet in a bucket.  Each member is paired with the
   bucket's smallest member (a star: one pair per member and bucket, never all pairs).
3. Candidate pairs whose signatures agree are confirmed on the full shingle sets, built again
   from the whole texts.
4. Components of the confirmed links come from alternating large-star and small-star rounds.
5. A star can miss a link between two members that are not like the smallest one.  So members of
   buckets that still hold several components are compared across components, by signature and
   by an upper bound of the similarity from 16-bit shingle digests (two sets share at most as
   many shingles as digests).  Pairs that pass are confirmed; this repeats until no pair is left.

Bands of 4 of 128 minima miss a pair of similarity 0.8 with probability 5e-8.  Signatures must
agree to six standard deviations below the threshold.  Buckets, classes and stars are grouped by
partial aggregation and skew-split joins; large buckets are compared in tiles, so no group has
to fit one task, and only likely links leave a tile.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import bounded_batches, contiguous_groups, gives_back, slices, tasks

N_HASHES, BAND_ROWS = 128, 4
SEED = 20240229
LOW_BITS = 31  # the bits of a bucket that hold the number of its band
LEFT_TILE, RIGHT_TILE = 2048, 16384
FIRST_PARTNERS = 16  # likely links a member may send per component and round; grows while any are left out
CACHE_WORDS = 150_000
SLICE_CHARS = 1 << 20


def text_words(text: str | None) -> list[bytes]:
    """Words of a whole text with A-Z lower-cased (bytes.split knows exactly the six separators)."""
    return text.encode("utf-8").lower().split() if text else []


def shingles(words: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    """The distinct shingles; fewer words than ``width`` make one shingle of all of them."""
    if not words:
        return set()
    if len(words) < width:
        return {tuple(words)}
    return set(zip(*(words[i:] for i in range(width)), strict=False))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _shingle_hashes(words: list[bytes], width: int, known: _WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    short = n < width
    with np.errstate(over="ignore"):
        acc = np.full(1 if short else n - width + 1, 0x9E3779B97F4A7C15 + (n if short else 0), np.uint64)
        for i in range(n if short else width):
            acc = (acc ^ (h[i:i + 1] if short else h[i:i + len(acc)])) * np.uint64(0xFF51AFD7ED558CCD)
            acc ^= acc >> np.uint64(32)
    return np.unique(acc)


def _universal() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a = rng.integers(0, 1 << 63, N_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, N_HASHES, dtype=np.uint64)


def _minima(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of N_HASHES multiply-shift hashes over a set of any size, in bounded pieces."""
    best = np.full(N_HASHES, np.iinfo(np.uint32).max, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(x), 8192):
            y = a[:, None] * x[None, k:k + 8192]
            y += b[:, None]
            best = np.minimum(best, (y.min(axis=1) >> np.uint64(32)).astype(np.uint32))
    return best


def signatures(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Per row: ``id``, ``n`` (set size), ``key`` (digest of the set, null if empty), ``sig`` (16 bits
    of each minimum) and ``bag`` (16 bits of each shingle's hash)."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _universal()
        known = _WordHash()
        for whole in batches:
            for part in slices(whole, "text", SLICE_CHARS):
                n, key, sig, bag = [], [], [], []
                for text in part["text"].to_pylist():
                    if len(known) > CACHE_WORDS:
                        known = _WordHash()
                    x = _shingle_hashes(text_words(text), width, known)
                    n.append(len(x))
                    key.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
                    sig.append(_minima(x, a, b).astype(np.uint16).tobytes() if len(x) else None)
                    bag.append((x >> np.uint64(20)).astype(np.uint16).tobytes() if len(x) else None)
                yield pa.RecordBatch.from_arrays(
                    [part["id"], pa.array(n, pa.int64()), *(pa.array(c, pa.binary()) for c in (key, sig, bag))],
                    ["id", "n", "key", "sig", "bag"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return bounded_batches(rows).mapInArrow(run, "id long, n long, key binary, sig binary, bag binary")


def band_rows(sigs: DataFrame) -> DataFrame:
    """``bucket`` (hash of a band's minima, the band's number in its low bits) and ``id``."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = N_HASHES // BAND_ROWS
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b["sig"].to_pylist()), np.uint16).reshape(b.num_rows, bands, BAND_ROWS).astype(np.uint64)
            acc = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x1E3779B97F4A7C15), (b.num_rows, 1))
            with np.errstate(over="ignore"):
                for r in range(BAND_ROWS):
                    acc = (acc ^ sig[:, :, r]) * np.uint64(0xFF51AFD7ED558CCD)
                    acc ^= acc >> np.uint64(29)
            acc = (acc & ~np.uint64(LOW_BITS)) | np.arange(bands, dtype=np.uint64)
            ids = np.repeat(b["id"].to_numpy(zero_copy_only=False), bands)
            yield pa.RecordBatch.from_arrays([pa.array(acc.ravel().view(np.int64)), pa.array(ids)], ["bucket", "id"])

    return sigs.select("id", "sig").mapInArrow(run, "bucket long, id long")


def least_equal(percent: int) -> int:
    """Fewest equal minima of a pair of that similarity, six standard deviations below the mean."""
    share = percent / 100
    return max(0, int(N_HASHES * share - 6 * (N_HASHES * share * (1 - share)) ** 0.5))


def agreeing(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose signatures have enough equal minima."""
    least = least_equal(percent)
    both = (pairs.join(sigs.select(F.col("id").alias("u"), F.col("sig").alias("a")), "u")
            .join(sigs.select(F.col("id").alias("v"), F.col("sig").alias("b")), "v"))

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b[c].to_pylist()), np.uint16).reshape(-1, N_HASHES) for c in ("a", "b"))
                yield b.select(["u", "v"]).filter(pa.array((x == y).sum(axis=1) >= least))

    return both.select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _is_stars(edges: DataFrame) -> bool:
    """Whether every u has one edge only and is no v of another edge."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    inner = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return inner.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) for every node of the undirected edges u, v.

    Large-star joins every larger neighbour to the smallest one, small-star every smaller one;
    both are a minimum by partial aggregation and a join.  Each round is written out; the rounds
    end when the edges are stars around the roots.
    """
    u, v = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = cut_lineage(edges.select(u, v).where("u <> v").distinct())
    while not _is_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = cut_lineage(small)
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def packed_texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and compressed whole text of the rows whose id is wanted, written out."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for b in slices(whole, "text", SLICE_CHARS):
                body = [z.compress(t.encode("utf-8")) for t in b["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([b["id"], pa.array(body, pa.binary())], ["id", "body"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return cut_lineage(rows.mapInArrow(run, "id long, body binary").join(wanted, "id"))


def confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (u, v) with 100 * intersection >= ``percent`` * union of their full sets."""
    # an id that stands on rows with different texts is tried with each of them
    left = texts.select(F.col("id").alias("u"), F.col("body").alias("a"))
    right = texts.select(F.col("id").alias("v"), F.col("body").alias("b"))
    full = pairs.join(left, "u").join(right, "v")

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, known = zstandard.ZstdDecompressor(), OrderedDict()

        def of(node: int, body: bytes) -> set:
            k = (node, len(body), body[-16:])
            if k not in known:
                known[k] = shingles(unpack.decompress(body, max_output_size=1 << 31).lower().split(), width)
                if len(known) > 32:
                    known.popitem(last=False)
            known.move_to_end(k)
            return known[k]

        for whole in batches:
            for b in slices(whole, "a", SLICE_CHARS):
                keep = []
                for u, v, x, y in zip(*(b[c].to_pylist() for c in ("u", "v", "a", "b")), strict=True):
                    p, q = of(v, y), of(u, x)
                    small, large = sorted((len(p), len(q)))
                    both = len(p & q) if 100 * small >= percent * large else 0
                    keep.append(bool(both) and 100 * both >= percent * (len(p) + len(q) - both))
                yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return full.mapInArrow(run, "u long, v long").distinct()


def likely_pairs(members: DataFrame, sigs: DataFrame, partners: int, percent: int) -> DataFrame:
    """Likely links between members of a bucket in different components.

    ``members``: bucket, id, root.  Every member outside its bucket's largest component (by
    count, ties to the smaller root) is compared with all members of other components, each pair
    in the first of the bands that both share.  The
    ``partners`` best of each other component are returned as bucket, u, v with ``more`` (whether
    that left likely ones out).
    """
    least = least_equal(percent)
    sizes = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    per = sizes.groupBy("bucket").agg(F.sum("c").alias("all"), F.max(F.struct("c", (-F.col("root")).alias("r"))).alias("top"))
    per = per.select("bucket", "all", F.col("top.c").alias("c"), (-F.col("top.r")).alias("main"))
    rows = members.join(per, "bucket").join(sigs.select("id", "sig", "bag"), "id")
    n_right = F.ceil(F.col("all") / RIGHT_TILE).cast("int")
    n_left = F.ceil((F.col("all") - F.col("c")) / LEFT_TILE).cast("int")
    spread = F.xxhash64("id")
    cols = ["bucket", "id", "root", "sig", "bag"]
    lefts = rows.where("root <> main").select(
        *cols, F.lit(0).alias("side"), F.pmod(spread, n_left).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), n_right - 1)).alias("j"))
    rights = rows.select(
        *cols, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), n_left - 1)).alias("i"),
        F.pmod(spread, n_right).cast("int").alias("j"))
    keys = ["bucket", "i", "j"]
    tiles = lefts.unionByName(rights).repartition(tasks(members), *keys).sortWithinPartitions(*keys, "side", "id")

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << 16, bool)
        for t in contiguous_groups(batches, keys):
            side = t["side"].to_numpy()
            ids, roots = t["id"].to_numpy(), t["root"].to_numpy()
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint16).reshape(-1, N_HASHES)
            bags = [np.frombuffer(x, np.uint16) for x in t["bag"].to_pylist()]
            size = np.array([len(x) for x in bags])
            right = np.flatnonzero(side == 1)
            band = t["bucket"][0].as_py() & LOW_BITS
            out: list[tuple[int, int, bool]] = []
            for i in np.flatnonzero(side == 0):
                near = right[(roots[right] != roots[i]) & (100 * size[right] >= percent * size[i]) & (percent * size[right] <= 100 * size[i])]
                same = sig[near] == sig[i]
                bands = same[:, : (band + 1) * BAND_ROWS].reshape(len(near), band + 1, BAND_ROWS).all(axis=2)
                near = near[(same.sum(axis=1) >= least) & (bands.argmax(axis=1) == band) & bands[:, band]]
                if not len(near):
                    continue
                table[bags[i]] = True
                begin = np.cumsum(size[near]) - size[near]
                shared = np.add.reduceat(table[np.concatenate([bags[x] for x in near])].astype(np.int64), begin)
                table[bags[i]] = False
                likely = 100 * shared >= percent * (size[near] + size[i] - shared)
                near, shared = near[likely], shared[likely] / size[near][likely]
                best = np.lexsort((ids[near], -shared, roots[near]))
                r = roots[near[best]]
                first = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.empty(0, np.int64)
                place = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
                more = bool((place >= partners).any())
                out += [(max(int(ids[i]), int(ids[x])), min(int(ids[i]), int(ids[x])), more) for x in near[best[place < partners]]]
            if out:
                us, vs, ms = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([t["bucket"][0].as_py()] * len(out), pa.int64()), pa.array(us, pa.int64()),
                                                  pa.array(vs, pa.int64()), pa.array(ms)], ["bucket", "u", "v", "more"])

    return tiles.mapInArrow(run, "bucket long, u long, v long, more boolean")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                    percent: int = 80) -> DataFrame:
    """One row per input row: the id, ``n_shingles``, ``component_id`` and ``kept``.

    Null and blank texts have an empty set and are linked with nothing.  Repeated rows share
    their set's class; rows that share an id count as one document, so their links join.  Rows
    without an id take the component of rows with their very set, and are kept (component null)
    if there is none.  An empty table gives an empty result.
    """
    sigs = cut_lineage(signatures(docs, id_col, text_col, width))
    classes = sigs.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"))
    members = cut_lineage(sigs.select("id", "n", "key").join(classes, "key", "left").select("id", "n", "rep"))
    reps = members.where("id = rep").select("id").distinct()
    full = sigs.where("key is not null").select("id", "sig", "bag")
    bands = cut_lineage(band_rows(full.select("id", "sig").join(reps, "id")))
    buckets = bands.groupBy("bucket").agg(F.min("id").alias("v"), F.count(F.lit(1)).alias("size")).where("size > 1")
    hits = cut_lineage(bands.join(buckets, "bucket"))
    texts = packed_texts(docs, hits.select("id").distinct(), id_col, text_col)
    close = cut_lineage(full.join(hits.select("id").distinct(), "id"))  # signatures of the same rows

    tested = cut_lineage(hits.where("id <> v").select(F.col("id").alias("u"), "v").distinct())
    same_id = (members.where("rep is not null and id is not null").groupBy("id")
               .agg(F.max("rep").alias("u"), F.min("rep").alias("v")).where("u <> v").select("u", "v"))
    links = cut_lineage(confirm(agreeing(tested, close, percent), texts, width, percent).unionByName(same_id))
    roots = cut_lineage(connected_components(links))

    partners, crowded = FIRST_PARTNERS, hits.where("size > 2").select("bucket", "id")
    while True:
        placed = cut_lineage(crowded.join(roots.withColumnRenamed("node", "id"), "id", "left")
                             .select("bucket", "id", F.coalesce("root", "id").alias("root")))
        mixed = placed.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("bucket")
        found = cut_lineage(likely_pairs(placed.join(mixed, "bucket"), close, partners, percent))
        fresh = cut_lineage(found.select("u", "v").distinct().join(tested, ["u", "v"], "left_anti"))
        if not fresh.isEmpty():
            confirmed = cut_lineage(confirm(fresh, texts, width, percent))
            tested = tested.unionByName(fresh)
            if not confirmed.isEmpty():
                links = links.unionByName(confirmed)
                roots = cut_lineage(connected_components(links))
        # a bucket that left no likely pair out is settled: all its pairs are refuted or tested
        open_ = found.where("more").select("bucket").distinct()
        if open_.isEmpty():
            break
        crowded, partners = placed.join(open_, "bucket").select("bucket", "id"), 16 * partners

    component = roots.select(F.col("node").alias("rep"), "root")
    out = members.join(component, "rep", "left")
    component_id = F.when(F.col("rep").isNull(), F.col("id")).otherwise(F.coalesce("root", "rep"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component_id.alias("component_id"),
                      F.col("id").eqNullSafe(component_id).alias("kept"))
