"""The prefix trie of conversations: which beginnings are shared, by how many, and what sharing them saves.

A turn becomes a 16-byte digest of role and text.  A conversation's digests are cut into blocks of turns
(the first 32, then 64, 128, ... up to 4,096 wide), so no conversation is ever one row, and a block after
the first is looked at only for conversations that share everything before it with another one: what a
conversation has beyond its last shared block is a chain of its own and is written straight from its turns.

Within a block the rows are dealt into range shards by (group of equal beginnings, digests, conversation);
a shard lies in one task as a matrix of turn ids padded with 0.  ``numpy.lexsort`` orders its rows; the
masks "differs from the row above" of the columns, accumulated by OR, mark where the nodes of every depth
start, and ``reduceat`` over those starts gives the numbers of all nodes, deepest first.  Nodes on the
paths of a shard's first and last row may go on in the neighbouring shards: these few leave as parts,
are added up by digest, and hand their own share to the nodes above them on the same path.

Blocks are worked off from the last to the first, each handing the sums of its groups to the conversation
that stands for the group in the block before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.prefix import ordered_position
from ..session import broadcast_if_small, cut_lineage
from .common import join_groups, tasks

FIRST, WIDEST = 32, 4096      # turns of the first block and of the widest
SHARD_CELLS = 1 << 20         # padded turns of a shard
ROOT = bytes(16)
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string")
PART = "kind int, key binary, parent_key binary, above array<binary>, chars long, " + NODE


def positions(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, digest, chars`` of every turn, numbered from 1 in each conversation.

    Turns are ordered by ``turn``, null first, ties by the digest of role and text (repeated rows are turns
    of their own, next to each other).  Null role or text counts as empty; rows without ``conv_id`` belong
    to no conversation and are left out; other columns are not read.  A conversation may hold any share of
    the rows: positions are counted in range blocks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.length(text).cast("long").alias("chars"))
    return ordered_position(cut_lineage(turns), ["turn", "digest"], ["conv_id"], "pos") \
        .select("conv_id", F.col("pos").cast("long").alias("pos"), "digest", "chars")


def on_shared_heads(turns: DataFrame, every: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on the head of every ``every``-th one: turns and (conv_id, total).

    Conversation c takes the first h turns of conversation c - c % every (none if that is absent), then its
    own after its first h; h = crc32(decimal c) % (longest + 1).  Conversations left without turns stay.
    """
    turns = cut_lineage(turns)
    of = lambda c: F.crc32(F.col(c).cast("string")) % (longest + 1)
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") <= longest)) \
        .groupBy(F.col("conv_id").alias("base")) \
        .agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("head"))
    convs = turns.groupBy("conv_id").agg(F.max("pos").alias("own")) \
        .withColumns({"base": F.col("conv_id") - F.col("conv_id") % every, "h": of("conv_id")})
    convs = cut_lineage(convs.join(heads, "base", "left").select(
        "conv_id", "own", "h", F.slice("head", F.lit(1), F.col("h").cast("int")).alias("head"))
        .withColumn("taken", F.when(F.col("head").isNull(), 0).otherwise(F.size("head")).cast("long"))
        .withColumn("total", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    shift = convs.select("conv_id", "own", "taken")
    own = join_groups(turns.where(F.col("pos") > of("conv_id")), shift, ["conv_id"], "own", turns.count())
    own = own.select("conv_id", (F.col("pos") - of("conv_id") + F.col("taken")).alias("pos"), "digest", "chars")
    borrowed = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.digest", "t.chars")
    return own.unionByName(borrowed), convs.select("conv_id", "total")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: turns and (conv_id, total)."""
    turns = cut_lineage(turns)
    return turns, turns.groupBy("conv_id").agg(F.max("pos").alias("total"))


# ---- blocks -----------------------------------------------------------------------------------------

def _bounds(first: int, widest: int) -> Iterator[tuple[int, int]]:
    """(turns before the block, its width) of block 0, 1, ..."""
    before, width = 0, first
    while True:
        yield before, width
        before, width = before + width, min(2 * width, widest)


def _block(pos: Column, first: int, widest: int) -> Column:
    """Number of the block that holds position ``pos``: doubling widths, then equal ones."""
    doublings = (widest // first).bit_length() - 1
    wide_from = first * (2 ** doublings - 1)
    p = pos - 1
    return F.when(p < wide_from, F.length(F.bin(F.floor(p / first) + 1)) - 1) \
        .otherwise(doublings + F.floor((p - wide_from) / widest)).cast("long")


def _rows(turns: DataFrame) -> DataFrame:
    """One row per conversation of a block: its digests as one binary, and the lengths of its texts."""
    t = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("t"))
    return t.select("conv_id", F.unhex(F.array_join("t.digest", "")).alias("ids"), F.col("t.chars").alias("chars"))


def prefix_trie(conversations: tuple[DataFrame, DataFrame], first: int = FIRST, widest: int = WIDEST,
                shard_cells: int = SHARD_CELLS) -> DataFrame:
    """The nodes of the trie of ``(turns, totals)``; see the module for the way, ``NODE`` for the columns.

    A node is a distinct sequence of first turns; the root has depth 0.  ``conv_id`` is the smallest member,
    ``n_convs`` counts the conversations that start with the node, ``saved_tokens`` sums over its subtree
    (members - 1) times the code points of the node's last text, ``ends_sha256`` digests the conversations
    that are this node and nothing more.  Equal conversations are members of the same nodes; one without
    turns is the root.  Without conversations there are no nodes.
    """
    if widest < first or widest % first or (widest // first) & (widest // first - 1):
        raise ValueError("widest must be first times a power of two")
    turns, totals = conversations
    turns = cut_lineage(turns.withColumn("block", _block(F.col("pos"), first, widest)))
    totals = cut_lineage(totals)
    spark = turns.sparkSession
    zero = F.unhex(F.lit(ROOT.hex()))

    # forward: the rows of every block, and who leaves as a chain of its own
    blocks: list[tuple[int, DataFrame, DataFrame]] = []        # depth before, rows, groups going on
    chains = None
    alive = totals.select("conv_id", "total", zero.alias("g"))
    for number, (before, width) in enumerate(_bounds(first, widest)):
        here = turns.where(F.col("block") == number)
        if number:
            here = here.join(alive.select("conv_id"), "conv_id", "left_semi")
        rows = cut_lineage(alive.join(_rows(here), "conv_id", "left")
                           .withColumn("ids", F.coalesce("ids", F.unhex(F.lit("")))))
        key = F.unhex(F.md5(F.concat("g", "ids")))
        on = cut_lineage(rows.where(F.col("total") > before + width).select("conv_id", "total", key.alias("g")))
        groups = cut_lineage(on.groupBy("g").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")))
        blocks.append((before, rows, groups.where(F.col("n") > 1).select("g", "conv_id")))
        single = groups.where(F.col("n") == 1).select("g", "conv_id").join(on.select("conv_id", "total"), "conv_id") \
            .withColumn("from", F.lit(before + width).cast("long"))
        chains = single if chains is None else chains.unionByName(single)
        shared = groups.where(F.col("n") > 1)
        if shared.isEmpty():
            break
        alive = join_groups(on, cut_lineage(shared.select("g", "n")), ["g"], "n", on.count()) \
            .where(F.col("n").isNotNull()).select("conv_id", "total", "g")
    chains = cut_lineage(chains)

    # backward: sums of a block's groups go to the conversations that stand for them one block earlier
    below = chains.select("conv_id", "from", F.lit(1).alias("kids"), F.lit(1).alias("leaves"), F.lit(0).alias("saved"))
    nodes, later = [], None
    for before, rows, groups in reversed(blocks):
        wide = rows.agg(F.count("*"), F.max(F.length("ids") / 16)).first()
        shards = max(1, -(-int(wide[0] * max(8, wide[1] or 0)) // shard_cells))
        deep = below.where(F.col("from") > before).drop("from")
        if later is not None:
            deep = deep.unionByName(later.join(groups, "g").select("conv_id", "kids", "leaves", "saved"))
        deep = deep.groupBy("conv_id").agg(*[F.sum(c).cast("long").alias(c) for c in ("kids", "leaves", "saved")])
        below = below.where(F.col("from") <= before)
        done = _block_nodes(rows.join(deep, "conv_id", "left"), before, shards)
        later = done.where((F.col("depth") == before) & F.lit(before > 0)) \
            .select(F.col("key").alias("g"), F.col("n_children").alias("kids"), F.col("n_leaves").alias("leaves"),
                    F.col("saved_tokens").alias("saved"))
        nodes.append(done.where((F.col("depth") > before) | F.lit(before == 0)))

    own = join_groups(turns, chains.select("conv_id", F.col("g").alias("top"), "from", "total"),
                      ["conv_id"], "total", turns.count()).where(F.col("pos") > F.col("from"))
    end = F.col("pos") == F.col("total")
    chain_nodes = own.select(
        F.lit(None).cast("binary").alias("key"),
        F.when(F.col("pos") == F.col("from") + 1, F.col("top")).alias("parent_key"),
        "conv_id", F.col("pos").alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        F.when(end, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(end, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NOTHING)).alias("ends_sha256"))
    every = chain_nodes
    for n in nodes:
        every = every.unionByName(n)
    every = cut_lineage(every)
    # nodes below another shard's or block's node: the parent's smallest member, by digest
    keyed = cut_lineage(every.where(F.col("key").isNotNull()).select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above")))
    open_ = every.where(F.col("parent_key").isNotNull()).join(broadcast_if_small(keyed, row_bytes=64), "parent_key", "left")
    cols = [c.strip().split(" ")[0] for c in NODE.split(",")]
    return every.where(F.col("parent_key").isNull()).select(*cols).unionByName(
        open_.withColumn("parent_conv_id", F.col("above")).select(*cols))


# ---- one block ----------------------------------------------------------------------------------------

def _block_nodes(rows: DataFrame, before: int, shards: int) -> DataFrame:
    """Nodes of a block: depth ``before`` (the roots of its groups) to its last turn, with ``key`` where others refer to them."""
    dealt = rows.select("g", "ids", "chars", "conv_id", "total", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("kids", "leaves", "saved")]) \
        .repartitionByRange(shards, "g", "ids", "conv_id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from shard_nodes(pa.Table.from_batches(held), before)

    parts = cut_lineage(dealt.mapInArrow(work, PART))
    cols = ["key", "parent_key"] + [c.strip().split(" ")[0] for c in NODE.split(",")]
    inner = parts.where(F.col("kind") == 0).select(*cols)

    # boundary nodes: add the parts, count boundary children, hand own shares up the path
    edge = cut_lineage(parts.where(F.col("kind") == 1).groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("above").alias("above"), F.max("chars").alias("chars"),
        F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
    children = edge.where(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    edge = cut_lineage(edge.join(children, "key", "left")
                       .withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0))).drop("more"))
    own = edge.select(F.explode(F.concat("above", F.array("key"))).alias("key"),
                      ((F.col("n_convs") - 1) * F.col("chars")).alias("own_saved"),
                      (F.col("n_children") == 0).cast("long").alias("own_leaf"))
    own = own.groupBy("key").agg(F.sum("own_saved").alias("own_saved"), F.sum("own_leaf").alias("own_leaf"))
    ends = _digests(parts.where(F.col("kind") == 2).select("key", "conv_id"))
    edge = edge.join(own, "key").join(ends, "key", "left").select(
        "key", F.when(F.col("depth") > before, F.col("parent_key")).alias("parent_key"), "conv_id", "depth",
        F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("n_leaves") + F.col("own_leaf")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("own_saved")).alias("saved_tokens"),
        F.coalesce("digest", F.lit(NOTHING)).alias("ends_sha256"))
    return cut_lineage(inner.unionByName(edge))


def _digests(members: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ascending ids of every key: one stream of sorted rows, nothing collected."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        done: tuple[list, list] = ([], [])
        for b in batches:
            for k, c in zip(b["key"].to_pylist(), b["conv_id"].to_pylist(), strict=True):
                if k != key:
                    if key is not None:
                        done[0].append(key)
                        done[1].append(sha.hexdigest())
                    key, sha = k, hashlib.sha256(str(c).encode())
                else:
                    sha.update(f",{c}".encode())
        if key is not None:
            done[0].append(key)
            done[1].append(sha.hexdigest())
            yield pa.record_batch([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], ["key", "digest"])

    sorted_ = members.repartition(tasks(members), "key").sortWithinPartitions("key", "conv_id")
    return sorted_.mapInArrow(work, "key binary, digest string")


def _codes(column: pa.Array) -> np.ndarray:
    """Rank of every value of a binary column among its distinct values, from 1."""
    d = column.dictionary_encode()
    order = pc.array_sort_indices(d.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    return rank[d.indices.to_numpy(zero_copy_only=False)]


def shard_nodes(t: pa.Table, before: int) -> Iterator[pa.RecordBatch]:
    """Nodes, boundary parts and boundary ends of one shard."""
    t = t.combine_chunks()
    n = t.num_rows
    ids = t["ids"].combine_chunks().cast(pa.large_binary())
    off = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset:ids.offset + n + 1]
    length = (off[1:] - off[:-1]) // 16
    flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), int(length.sum()), [None, ids.buffers()[2].slice(int(off[0]))]) \
        if length.sum() else pa.array([], pa.binary(16))
    width = int(length.max())
    at = np.repeat(np.arange(n), length), np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    turn = np.zeros((n, width), np.int64)      # 0 pads: shorter rows come first, as in the range order
    text = np.zeros((n, width), np.int64)
    if width:
        turn[at] = _codes(flat.cast(pa.binary()))
        text[at] = t["chars"].combine_chunks().flatten().to_numpy()
    group = _codes(t["g"].combine_chunks().cast(pa.binary()))
    conv, total = t["conv_id"].to_numpy(), t["total"].to_numpy()
    order = np.lexsort((conv, *(turn[:, d] for d in range(width - 1, -1, -1)), group))
    turn, text, group, conv, length = turn[order], text[order], group[order], conv[order], length[order]
    over = total[order] == before + length     # the others go on in the next block
    kids, leaves, saved = (t[c].to_numpy()[order].copy() for c in ("kids", "leaves", "saved"))

    def key_at(row: int, d: int) -> bytes:
        """Digest of the node of depth d on a row's path; the group's own at 0."""
        g, b = t["g"][int(order[row])].as_py(), ids[int(order[row])].as_py()
        return hashlib.md5(g + b[:16 * d]).digest() if d else g

    first_path, last_path = ([key_at(r, d) for d in range(length[r] + 1)] for r in (0, n - 1))

    def ended(d: int, a: int, b: int) -> np.ndarray:
        """Conversations of the rows a to b that have d turns of the block and no more, ascending."""
        return conv[a:b][over[a:b] & (length[a:b] == d)]

    # forward: where the nodes of every depth start
    new = np.ones(n, bool)
    new[1:] = group[1:] != group[:-1]
    starts = [np.flatnonzero(new)]
    for d in range(width):
        new[1:] |= turn[1:, d] != turn[:-1, d]
        starts.append(np.flatnonzero(new))

    # backward: numbers of the nodes, deepest first; boundary nodes leave their own share out
    child = np.zeros(n, np.int64)              # 1 where an inner node of the next depth starts
    conv_of: dict[int, np.ndarray] = {}
    held: list[tuple] = []                     # per depth, until the parents' smallest members are known
    for d in range(width, -1, -1):
        s = starts[d]
        stop = np.append(s[1:], n)
        real = length[s] >= d
        edge = real & ((s == 0) | (stop == n))
        members = stop - s
        inner_kids = np.add.reduceat(child, s)
        ends = over & (length == d)
        deep = np.add.reduceat(np.where(length == d, kids, 0), s)
        n_children = inner_kids + deep
        inner = real & ~edge
        leaves[s[inner & (n_children == 0)]] += 1
        chars = text[s, d - 1] if d else np.zeros(len(s), np.int64)
        saved[s[inner]] += ((members - 1) * chars)[inner]
        smallest = np.minimum.reduceat(conv, s)
        conv_of[d] = smallest
        n_leaves, n_saved = np.add.reduceat(leaves, s), np.add.reduceat(saved, s)
        n_ends = np.add.reduceat(ends.astype(np.int64), s)
        child = np.zeros(n, np.int64)
        child[s[inner]] = 1
        held.append((d, s, stop, inner, edge, members, n_children, deep, n_leaves, n_saved, n_ends, chars))

    for d, s, stop, inner, edge, members, n_children, deep, n_leaves, n_saved, n_ends, chars in held:
        up = np.searchsorted(starts[d - 1], s, "right") - 1 if d else None
        # inner nodes
        i = np.flatnonzero(inner)
        if len(i):
            digests = [NOTHING] * len(i)
            for j in np.flatnonzero(n_ends[i]):
                digests[j] = hashlib.sha256(",".join(map(str, ended(d, s[i[j]], stop[i[j]]).tolist())).encode()).hexdigest()
            keys: list = [None] * len(i)
            for j in (range(len(i)) if d == 0 else np.flatnonzero(deep[i])):
                keys[j] = key_at(int(s[i[j]]), d)
            parent_keys: list = [None] * len(i)
            parent = pa.nulls(len(i), pa.int64())
            if d:
                parent = pa.array(conv_of[d - 1][up[i]])
                above = up[i]
                if d == 1 and before:
                    parent_keys = [key_at(int(r), 0) for r in s[i]]
                else:
                    stop_up = np.append(starts[d - 1][1:], n)
                    for j in np.flatnonzero((starts[d - 1][above] == 0) | (stop_up[above] == n)):
                        parent_keys[j] = (first_path if starts[d - 1][above[j]] == 0 else last_path)[d - 1]
            yield _batch(0, keys, parent_keys, pa.nulls(len(i), pa.list_(pa.binary())), pa.nulls(len(i), pa.int64()), conv_of[d][i],
                         before + d, parent, members[i], n_children[i], n_leaves[i], n_saved[i], digests)
        # boundary parts and their ends
        e = np.flatnonzero(edge)
        if len(e):
            paths = [first_path if s[k] == 0 else last_path for k in e]
            yield _batch(1, [p[d] for p in paths], [p[d - 1] if d else None for p in paths],
                         pa.array([p[:d] for p in paths], pa.list_(pa.binary())), chars[e], conv_of[d][e],
                         before + d, pa.nulls(len(e), pa.int64()), members[e], n_children[e], n_leaves[e], n_saved[e], [None] * len(e))
            for k, p in zip(e, paths, strict=True):
                if n_ends[k]:
                    m = int(n_ends[k])
                    ids_of = ended(d, s[k], stop[k])
                    zero = np.zeros(m, np.int64)
                    yield _batch(2, [p[d]] * m, [None] * m, pa.nulls(m, pa.list_(pa.binary())), zero, ids_of, before + d,
                                 pa.nulls(m, pa.int64()), zero, zero, zero, zero, [None] * m)


def _batch(kind: int, key, parent_key, above, chars, conv, depth: int, parent, n, kids, leaves, saved, ends) -> pa.RecordBatch:
    size = len(key)
    return pa.record_batch([
        pa.array(np.full(size, kind, np.int32)), pa.array(key, pa.binary()), pa.array(parent_key, pa.binary()), above,
        chars if isinstance(chars, pa.Array) else pa.array(chars), pa.array(conv), pa.array(np.full(size, depth, np.int64)), parent,
        pa.array(n), pa.array(kids), pa.array(leaves), pa.array(saved), pa.array(ends, pa.string())],
        ["kind", "key", "parent_key", "above", "chars", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
         "n_leaves", "saved_tokens", "ends_sha256"])
