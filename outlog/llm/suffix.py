"""Suffix-array dedup: every byte that an earlier 100-byte string already covers is removed.

A start p of a text is a repeat if its next ``width`` bytes also start earlier (smaller id, or
the same text further left).  In suffix order the starts with equal next ``width`` bytes are
neighbours; with ties kept in text order the previous smaller position of a start is its
predecessor in the run (the next smaller position shares no more), so the longest previous
factor reaches ``width`` exactly for all but the first start of a run.  The first copy stays.

The suffix array is sparse and split over tasks.  The smallest hash among the 32-byte pieces of
a start's window, its anchor, depends on the window's bytes alone, so equal windows have equal
anchors and meet in one task.  An anchor owns a run of neighbouring starts; the bytes of their
windows are its context.

1. texts are held in blocks; a block sends one row per distinct (anchor, context): hashes and
   the first position.  Its other occurrences in the block are repeats of that one;
2. rows meet by anchor: a context that occurs earlier in another block is a repeat as a whole;
   an anchor with a single context has no other repeats;
3. where an anchor has several contexts (copies that begin or end near it), each context's first
   occurrence sends its bytes.  Windows of very frequent anchors are sent one by one to the task
   of their own bytes, after equal ones in the block are combined: no task holds a common line;
4. tasks rank the windows in suffix order and mark repeats by previous smaller positions;
5. blocks join their covered byte ranges, which are merged and cut out.

Blocks are a table bucketed by block, so the texts themselves are never shuffled.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, scratch_path
from .common import contiguous_groups, gives_back, slices, spread, tasks, whole_runs

WIDTH = 100
PIECE = 32
HOT = 4096  # an anchor with more contexts sends its windows one by one
LAST = (1 << 63) - 1  # order of rows without an id: after all others
BLOCK_BYTES = 8 << 20
SEGMENT = 512 << 10  # bytes worked on at once; longer texts are cut with overlap
WINDOWS_AT_ONCE = 1 << 20
RANGE = "block long, row int, begin long, finish long"


def words_at(flat: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number (positions to len - 8)."""
    return np.ndarray((max(0, len(flat) - 7),), "<u8", flat, strides=(1,))


def piece_hashes(flat: np.ndarray) -> np.ndarray:
    """Hash of the PIECE bytes from each position on."""
    n = len(flat) - PIECE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    eight = words_at(flat)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, PIECE, 8):
            h ^= eight[k:k + n]
            h *= np.uint64(0x9FB21C651E98DF25)
            h ^= h >> np.uint64(32)
    return h


def anchors(flat: np.ndarray, ends: np.ndarray, width: int = WIDTH):
    """Anchors of the windows of texts laid one after the other (``ends``: their end positions).

    Returns (hash, anchor position, first and last window start it owns), in text order; each
    window start whose window lies inside one text belongs to exactly one anchor.
    """
    h = piece_hashes(flat)
    span = width - PIECE + 1
    if len(h) < span:
        z = np.empty(0, np.int64)
        return np.empty(0, np.uint64), z, z, z
    low = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while step * 2 <= span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if span > step:
        low = np.minimum(low[: len(low) - (span - step)], low[span - step:])
    at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)  # anchor of window start p
    starts = np.append(0, ends[:-1])
    inside = np.zeros(len(flat) + 1, np.int64)
    long = ends - starts >= width
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - width + 1, -1)
    p = np.flatnonzero(np.cumsum(inside)[: len(at)] > 0)
    if not len(p):
        z = np.empty(0, np.int64)
        return np.empty(0, np.uint64), z, z, z
    a = at[p]
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)))
    last = np.append(new[1:], len(p)) - 1
    return h[a[new]], a[new], p[new], p[last]


_BASE = 0x9E3779B97F4A7C15


def context_hashes(flat: np.ndarray, begin: np.ndarray, finish: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range (of at least eight bytes), from prefix sums."""
    with np.errstate(over="ignore"):
        g = words_at(flat) * np.uint64(0xD6E8FEB86659FD93)
        g ^= g >> np.uint64(32)
        g *= np.uint64(0xCA9B0A7EBA1DA115)
        power = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(g), _BASE, np.uint64)))
        inverse = np.uint64(pow(_BASE, -1, 1 << 64))
        back = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(g), inverse, np.uint64)))
        total = np.append(np.uint64(0), np.cumsum(g * power[:-1], dtype=np.uint64))
        out = (total[finish - 7] - total[begin]) * back[begin]
        out ^= (finish - begin).astype(np.uint64)
        out *= np.uint64(0x9FB21C651E98DF25)
        return out ^ (out >> np.uint64(31))


def block_anchors(texts: list[bytes], width: int = WIDTH):
    """Anchors of the texts: arrays (row, hash, context hash, first start, number of starts)."""
    parts = []
    rows: list[int] = []
    cuts: list[int] = []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal rows, cuts, held, size
        if held:
            flat = np.frombuffer(b"".join(held), np.uint8)
            ends = np.cumsum([len(b) for b in held])
            h, _, lo, hi = anchors(flat, ends, width)
            if len(h):
                c = context_hashes(flat, lo, hi + width)
                seg = np.searchsorted(ends, lo, side="right")
                shift = np.array(cuts)[seg] - np.append(0, ends)[seg]
                parts.append((np.array(rows)[seg], h.view(np.int64), c.view(np.int64), lo + shift, hi - lo + 1))
        rows, cuts, held, size = [], [], [], 0

    for row, raw in enumerate(texts):
        for cut in range(0, max(1, len(raw) - width + 1), SEGMENT):
            piece = raw[cut:cut + SEGMENT + width - 1]
            if len(piece) < width:
                continue
            if size + len(piece) > SEGMENT + width:
                flush()
            rows.append(row)
            cuts.append(cut)
            held.append(piece)
            size += len(piece)
    flush()
    if not parts:
        z = np.empty(0, np.int64)
        return z, z, z, z, z
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def suffix_repeats(flat: np.ndarray, starts: np.ndarray, ids: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """Which of the windows flat[s : s + width] have an equal window at a smaller (id, offset).

    Windows are put in suffix order by their bytes, eight at a time; ties are refined until they
    differ or ``width`` bytes are equal.  Within a run of equal windows, in the order of (id,
    offset), the previous smaller position of all but the first is their predecessor.
    """
    n = len(starts)
    if n < 2:
        return np.zeros(n, bool)
    eight = words_at(flat)
    order = np.arange(n)
    run = np.zeros(n, np.int64)  # run number of each place of the order; runs refine step by step
    live = np.arange(n)  # places in runs of two and more
    for k in [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]:
        if not len(live):
            break
        w = eight[starts[order[live]] + k].byteswap()
        by = np.lexsort((w, run[live]))
        order[live] = order[live][by]
        r, w = run[live], w[by]
        new = np.append(True, (r[1:] != r[:-1]) | (w[1:] != w[:-1]))
        first = np.flatnonzero(new)
        run[live] = live[np.repeat(first, np.diff(np.append(first, len(live))))]
        size = np.repeat(np.diff(np.append(first, len(live))), np.diff(np.append(first, len(live))))
        live = live[size > 1]
    out = np.zeros(n, bool)
    if len(live):  # the runs left share all their bytes
        at = order[live]
        by = np.lexsort((offsets[at], ids[at], run[live]))
        at, r = at[by], run[live]
        start = np.append(True, r[1:] != r[:-1])
        lead = at[np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))]
        out[at] = (ids[at] != ids[lead]) | (offsets[at] != offsets[lead])
    return out


def _merge(row: np.ndarray, begin: np.ndarray, finish: np.ndarray):
    """Union of byte ranges per row, as sorted disjoint (not touching) ranges."""
    if not len(row):
        return row, begin, finish
    order = np.lexsort((begin, row))
    row, begin, finish = row[order], begin[order], finish[order]
    big = np.int64(1) << 40  # rows apart by more than any text's length
    reach = np.maximum.accumulate(finish + row * big)
    new = np.append(True, begin[1:] + row[1:] * big > reach[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(row)) - 1
    return row[at], begin[at], reach[last] - row[at] * big


def hold(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The texts in blocks, as a table bucketed by block: block, row, id, body, extra (the other columns)."""
    spark = df.sparkSession
    rest = [c for c in df.columns if c != text_col]
    rows = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.col(text_col).alias("text"),
                     F.struct(*rest).alias("extra"))

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        block, row, held = TaskContext.get().partitionId() << 24, 0, 0
        for whole in batches:
            for b in slices(whole, "text"):
                blocks, places, body = [], [], []
                for t in b["text"].to_pylist():
                    raw = (t or "").encode("utf-8")
                    if held and held + len(raw) > BLOCK_BYTES:
                        block, row, held = block + 1, 0, 0
                    held += len(raw)
                    blocks.append(block)
                    places.append(row)
                    row += 1
                    body.append(z.compress(raw))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(blocks, pa.int64()), pa.array(places, pa.int32()), b["id"], pa.array(body, pa.binary()), b["extra"]],
                    ["block", "row", "id", "body", "extra"])

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("row", T.IntegerType()), T.StructField("id", T.LongType()),
                           T.StructField("body", T.BinaryType()), rows.schema["extra"]])
    name = f"outlog_blocks_{uuid.uuid4().hex[:12]}"
    # a task writes whole blocks, so bucketing needs no exchange and makes about one file a block
    (rows.mapInArrow(run, schema).write.bucketBy(tasks(df), "block").sortBy("block")
     .option("path", scratch_path(spark, "blocks")).saveAsTable(name))
    held = spark.table(name)
    spark.sql(f"DROP TABLE {name}")     # the catalog's entry; the files stay where the scratch tables are
    return held


def _texts(t: pa.Table) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(b, max_output_size=1 << 31) if b else b"" for b in t["body"].to_pylist()]


def _firsts(h, c, ids, lo) -> tuple[np.ndarray, np.ndarray]:
    """(order by hash, context and position, start flags of the distinct (hash, context))."""
    order = np.lexsort((lo, ids, c, h))
    return order, np.append(True, (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])) if len(order) else np.empty(0, bool)


def block_contexts(held: DataFrame, width: int) -> DataFrame:
    """block, h, c, id, at: the first occurrence of every distinct (anchor, context) of a block."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in contiguous_groups(batches, ["block"]):
            row, h, c, lo, _ = block_anchors(_texts(t), width)
            ids = t["id"].to_numpy()[row] if len(row) else row
            order, new = _firsts(h, c, ids, lo)
            at = order[new]
            for k in range(0, len(at), 100_000):
                a = at[k:k + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(a), t["block"][0].as_py())), pa.array(h[a]), pa.array(c[a]), pa.array(ids[a]), pa.array(lo[a])],
                    ["block", "h", "c", "id", "at"])

    return held.select("block", "id", "body").mapInArrow(run, "block long, h long, c long, id long, at long")


def judge_contexts(found: DataFrame) -> DataFrame:
    """block, h, c, id, at, later, hot: contexts that occur earlier in another block (``later``), and
    the first occurrences of contexts whose anchor has other contexts too.

    ``hot`` marks anchors with more than HOT such contexts.  One exchange by anchor; the windows
    spill, so an anchor's rows need not fit in memory.
    """
    by_context, by_anchor = W.partitionBy("h", "c"), W.partitionBy("h")
    place = F.struct("id", "at")
    judged = (found.withColumn("later", place > F.min(place).over(by_context))
              .withColumn("several", F.min("c").over(by_anchor) != F.max("c").over(by_anchor))
              .where(F.col("later") | F.col("several")).drop("several"))
    judged = cut_lineage(judged)
    hot = (judged.where(~F.col("later")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT)
           .select("h", F.lit(True).alias("hot")))
    return judged.join(hot, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))


def open_windows(held: DataFrame, judged: DataFrame, width: int) -> DataFrame:
    """Covered ranges that are already certain (``ctx`` null), and the contexts to compare.

    A context row has key (its anchor, or the hash of its one window if the anchor is hot), id,
    begin (its first start) and its bytes; its starts are the positions that leave ``width`` bytes.
    """
    schema = "block long, row int, begin long, finish long, key long, id long, ctx binary"

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        raw = _texts(texts)
        block = texts["block"][0].as_py() if texts.num_rows else 0
        row, h, c, lo, n = block_anchors(raw, width)
        ids = texts["id"].to_numpy()[row] if len(row) else row
        order, new = _firsts(h, c, ids, lo)
        number = np.cumsum(new) - 1  # of the distinct (anchor, context), in order
        lead = order[new]
        same = (ids[order] == ids[lead][number]) & (lo[order] == lo[lead][number]) if len(order) else new
        # judged rows are a subset of the block's distinct (anchor, context)
        later, several, hot = (np.zeros(len(lead), bool) for _ in range(3))
        if known.num_rows:
            kh, kc = known["h"].to_numpy(), known["c"].to_numpy()
            pair = np.empty(len(lead) + len(kh), "i8,i8")
            pair["f0"], pair["f1"] = np.append(h[lead], kh), np.append(c[lead], kc)
            _, inverse = np.unique(pair, return_inverse=True)
            place = np.full(len(pair), -1)
            place[inverse[: len(lead)]] = np.arange(len(lead))
            at = place[inverse[len(lead):]]
            is_later = known["later"].to_numpy(zero_copy_only=False)
            later[at] = is_later
            several[at] = ~is_later
            hot[at] = known["hot"].to_numpy(zero_copy_only=False)
        sure = order[~same | later[number]] if len(order) else order
        r, a, z = _merge(row[sure], lo[sure], lo[sure] + n[sure] + width - 1)
        out = [pa.table({"block": np.full(len(r), block, np.int64), "row": pa.array(r, pa.int32()), "begin": a, "finish": z,
                         "key": pa.nulls(len(r), pa.int64()), "id": pa.nulls(len(r), pa.int64()), "ctx": pa.nulls(len(r), pa.binary())})]
        send = same & several[number] if len(order) else same
        plain, single = order[send & ~hot[number]], order[send & hot[number]]
        # hot anchors: every window by itself, the first of equal windows of the block only
        start = spread(lo[single], n[single])
        owner = np.repeat(single, n[single])
        body = [raw[row[o]][s:s + width] for o, s in zip(owner.tolist(), start.tolist(), strict=True)]
        best: dict[bytes, tuple[int, int]] = {}
        for o, s, b in zip(owner.tolist(), start.tolist(), body, strict=True):
            best[b] = min(best.get(b, (LAST, LAST)), (int(ids[o]), s))
        first = np.array([(int(ids[o]), s) == best[b] for o, s, b in zip(owner.tolist(), start.tolist(), body, strict=True)], bool)
        r, a, z = _merge(row[owner[~first]], start[~first], start[~first] + width)
        out.append(pa.table({"block": np.full(len(r), block, np.int64), "row": pa.array(r, pa.int32()), "begin": a, "finish": z,
                             "key": pa.nulls(len(r), pa.int64()), "id": pa.nulls(len(r), pa.int64()), "ctx": pa.nulls(len(r), pa.binary())}))
        rows = np.append(row[plain], row[owner[first]])
        begin = np.append(lo[plain], start[first])
        count = np.append(n[plain], np.ones(int(first.sum()), np.int64))
        ctx = [raw[i][b:b + k + width - 1] for i, b, k in zip(rows.tolist(), begin.tolist(), count.tolist(), strict=True)]
        key = np.append(h[plain], np.array([xxhash.xxh64_intdigest(b, seed=1) for b, f in zip(body, first, strict=True) if f], np.uint64).view(np.int64))
        out.append(pa.table({"block": np.full(len(rows), block, np.int64), "row": pa.array(rows, pa.int32()), "begin": begin,
                             "finish": begin + count + width - 1, "key": pa.array(key, pa.int64()), "id": np.append(ids[plain], ids[owner[first]]),
                             "ctx": pa.array(ctx, pa.binary())}))
        return pa.concat_tables([t.cast(out[0].schema) for t in out])

    both = held.select("block", "id", "row", "body").groupBy("block").cogroup(judged.groupBy("block"))
    return cut_lineage(both.applyInArrow(run, schema))


def compared(opened: DataFrame, width: int) -> DataFrame:
    """Covered ranges found by comparing the contexts of each key in suffix order."""

    def ranges(tables: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(tables)
        key, ids, begin = t["key"].to_numpy(), t["id"].to_numpy(), t["begin"].to_numpy()
        block, row = t["block"].to_numpy(), t["row"].to_numpy()
        body = t["ctx"].to_pylist()
        length = np.array([len(b) for b in body], np.int64)
        flat = np.frombuffer(b"".join(body) + bytes(8), np.uint8)
        count = length - width + 1
        base = np.cumsum(length) - length
        start = spread(base, count)
        owner = np.repeat(np.arange(len(key)), count)
        offset = begin[owner] + start - base[owner]
        hit = suffix_repeats(flat, start, ids[owner], offset, width)
        o, off = owner[hit], offset[hit]
        place, number = np.unique(np.stack([block[o], row[o].astype(np.int64)], axis=1), axis=0, return_inverse=True)
        r, a, z = _merge(number.ravel(), off, off + width)
        return pa.RecordBatch.from_arrays([pa.array(place[r, 0] if len(r) else r), pa.array((place[r, 1] if len(r) else r).astype(np.int32)), pa.array(a), pa.array(z)],
                                          ["block", "row", "begin", "finish"])

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for t in whole_runs(batches, "key"):
            held.append(t)
            size += t.num_rows * 64
            if size > WINDOWS_AT_ONCE:
                yield ranges(held)
                held, size = [], 0
        if held:
            yield ranges(held)

    rows = opened.where("ctx is not null").select("key", "id", "block", "row", "begin", "ctx")
    return rows.repartition(tasks(opened), "key").sortWithinPartitions("key").mapInArrow(run, RANGE)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                   keep_text: bool = True) -> DataFrame:
    """The rows of ``df`` with n_bytes, n_removed, n_spans, kept_sha256 and spans (array of
    begin, finish: the removed byte ranges); with ``keep_text`` the text column holds what is
    left (a character cut in two is dropped whole), without it the column is left out.

    Null and empty texts have no bytes.  Texts shorter than ``width`` bytes lose nothing.  Rows
    that share an id count as one document and equal positions in them are not earlier, so exact
    repeats of a row fare alike; rows without an id count as one document after all others.
    Columns with the names of the results are replaced.  An empty table gives no rows.
    """
    made = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    df = df.drop(*[x for x in made if x in df.columns])
    held = hold(df, id_col, text_col)
    opened = open_windows(held, judge_contexts(block_contexts(held, width)), width)
    covered = opened.where("ctx is null").select("block", "row", "begin", "finish").unionByName(compared(opened, width))
    rest = held.schema["extra"].dataType
    span = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("finish", T.LongType())]))
    fields = [T.StructField("extra", rest), *([T.StructField(text_col, T.StringType())] if keep_text else []),
              T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
              T.StructField("kept_sha256", T.StringType()), T.StructField("spans", span)]

    def run(texts: pa.Table, cuts: pa.Table) -> pa.Table:
        r, a, z = _merge(cuts["row"].to_numpy().astype(np.int64), cuts["begin"].to_numpy(), cuts["finish"].to_numpy())
        rows = texts["row"].to_numpy()
        lo, hi = np.searchsorted(r, rows, side="left"), np.searchsorted(r, rows, side="right")
        text, n, removed, spans, digest, kept = [], [], [], [], [], []
        for i, raw in enumerate(_texts(texts)):
            own = [(int(x), int(y)) for x, y in zip(a[lo[i]:hi[i]], z[lo[i]:hi[i]], strict=True)]
            at, parts = 0, []
            for x, y in own:
                parts.append(raw[at:x])
                at = y
            left = b"".join([*parts, raw[at:]]) if own else raw
            n.append(len(raw))
            removed.append(len(raw) - len(left))
            spans.append([{"begin": x, "finish": y} for x, y in own])
            digest.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        if keep_text:
            text = [k.decode("utf-8", errors="ignore") for k in kept]
        cols = {"extra": texts["extra"], **({text_col: pa.array(text, pa.string())} if keep_text else {}),
                "n_bytes": pa.array(n, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                "n_spans": pa.array([len(x) for x in spans], pa.int64()), "kept_sha256": pa.array(digest, pa.string()),
                "spans": pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("finish", pa.int64())])))}
        return pa.table(cols)

    out = held.groupBy("block").cogroup(covered.groupBy("block")).applyInArrow(run, T.StructType(fields))
    names = [F.col(text_col) if c == text_col else F.col("extra")[c].alias(c) for c in df.columns if keep_text or c != text_col]
    return out.select(*names, *made)
