"""Conversation prefix trie as tables of nodes under minimal perfect hashes.

A prefix of d turns has a digest that is chained from that of d - 1 turns. Conversations are dealt to tasks by their id
and taken in shards of a bounded number of turns, so a first turn that a third of them share is spread over all shards.
A shard's distinct digests get slots without gaps; a lookup compares the whole digest with the one in the slot. Counts
are scattered into flat arrays by slot and summed up through the parents' slots, from the deepest nodes to the root.

Two passes suffice. The first gives every node's members and smallest member, added up over shards. Each node then belongs
to one conversation, its smallest member, whose later prefixes belong to it as well; so in the second pass what a node
adds to its ancestors (a leaf, a child, saved bytes) is scattered once, in its owner's shard, and added up again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MIX2, mix, prepare, release, stored

#: Turns in a shard, unless one conversation has more; bytes of joined ids in a row.
SHARD_ROWS, CHUNK_BYTES = 1 << 18, 1 << 16
ROOT = bytes(24)


def ordered_turns(df: DataFrame) -> DataFrame:
    """(conv_id, pos, t, n_bytes): every turn's place from 1, the digest of its role and text, its text's UTF-8 bytes.

    Turns come by their number, null first; of equal numbers by digest, so rows that repeat a turn are turns of their
    own. Null roles and texts are empty. Rows without conv_id are left out. The texts themselves are not shuffled.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    some = df.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", t.alias("t"), F.octet_length(text).cast("long").alias("n_bytes"))
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "t")
    return some.select("conv_id", F.row_number().over(w).cast("long").alias("pos"), "t", "n_bytes")


def with_shared_heads(turns: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Conversations that begin with another's first turns, in the form that prefix_trie takes.

    The first h turns of conversation c are those of c - c % every (fewer where it has fewer, none where it is absent),
    with h = unsigned crc32 of c as decimal text, modulo `most`; then c's own turns after its first h follow.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % most
    ids = turns.where("pos = 1").select("conv_id")
    source = F.col("conv_id") - F.col("conv_id") % every
    heads = turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most)).select(F.col("conv_id").alias("source"), "pos", "t", "n_bytes")
    moved = ids.where(F.col("conv_id") % every != 0).select("conv_id", source.alias("source"), h.alias("h"))
    taken = moved.join(heads, "source").where("pos <= h").select("conv_id", "pos", "t", "n_bytes")
    own = turns.where((F.col("conv_id") % every == 0) | (F.col("pos") > h))
    return marked(ids).unionByName(taken).unionByName(own)


def marked(ids: DataFrame) -> DataFrame:
    """A row at place 0 for each conversation, so that those without turns count as well."""
    return ids.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("t"), F.lit(0).cast("long").alias("n_bytes"))


class Slots:
    """Minimal perfect hash of distinct digests, rows of three 64-bit numbers, that tells strangers by comparing them.

    Level by level a digest that is alone at its bit keeps it and the others go on; a digest's slot is its bit's rank.
    """

    def __init__(self, keys: np.ndarray):
        self.levels, rest, base = [], keys, 0
        while len(rest):
            seed, m = len(self.levels), max(1, int(1.5 * len(rest)))
            at = self._hash(rest, seed, m)
            alone = np.bincount(at, minlength=m) == 1
            self.levels.append((m, alone, base + np.cumsum(alone) - 1))
            base += int(alone.sum())
            rest = rest[~alone[at]]
        self.keys = np.zeros((base, 3), np.uint64)
        self.keys[self._find(keys)] = keys

    @staticmethod
    def _hash(keys: np.ndarray, seed: int, m: int) -> np.ndarray:
        salt = np.uint64((seed + 1) * int(MIX2) & (1 << 64) - 1)
        return (mix(keys[:, 0] ^ mix(keys[:, 1] + salt)) % np.uint64(m)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for seed, (m, alone, rank) in enumerate(self.levels):
            at = self._hash(keys[rest], seed, m)
            hit = alone[at]
            out[rest[hit]] = rank[at[hit]]
            rest = rest[~hit]
        return out

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Slots of digests, -1 for any that isn't among them."""
        found = self._find(keys)
        if not len(self.keys):
            return found
        return np.where((found >= 0) & (self.keys[found] == keys).all(axis=1), found, -1)


class Shard:
    """Nodes of some whole conversations: rows of conv, t and n_bytes, each conversation's row of place 0 first."""

    def __init__(self, conv: np.ndarray, first: np.ndarray, t: list[bytes | None], n_bytes: np.ndarray):
        chain, now = [], ROOT
        for turn, begins in zip(t, first, strict=True):
            now = ROOT if begins else hashlib.blake2b(now + turn, digest_size=24).digest()
            chain.append(now)
        digests = np.frombuffer(b"".join(chain), np.uint64).reshape(-1, 3)
        begin = np.flatnonzero(first)
        self.conv, self.begin = conv, begin
        depth = np.arange(len(conv)) - np.repeat(begin, np.diff(np.append(begin, len(conv))))
        _, some = np.unique(digests.view([("a", np.uint64), ("b", np.uint64), ("c", np.uint64)]).ravel(), return_index=True)
        self.slots = Slots(digests[some])
        self.at = at = self.slots.of(digests)  # each row's node
        n = len(self.slots.keys)
        self.n, self.parent, self.depth, self.n_bytes = n, np.full(n, -1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        inner = np.flatnonzero(~first)
        self.depth[at], self.n_bytes[at] = depth, n_bytes
        self.parent[at[inner]] = at[inner - 1]
        if (at < 0).any() or (self.parent[at[inner]] != at[inner - 1]).any() or (self.n_bytes[at] != n_bytes).any():
            raise ValueError("two different prefixes have the same digest")
        self.ends = at[np.append(begin[1:], len(conv)) - 1]
        order = np.argsort(self.depth, kind="stable")[::-1]
        bounds = np.flatnonzero(np.diff(self.depth[order])) + 1
        self.levels = np.split(order, bounds)  # slots of one depth, deepest first

    def up(self, values: np.ndarray, into: np.ufunc = np.add) -> np.ndarray:
        """values of every node with those of all nodes below it."""
        for level in self.levels:
            inner = level[self.parent[level] >= 0]
            into.at(values, self.parent[inner], values[inner])
        return values

    def key(self, k: int) -> np.ndarray:
        return self.slots.keys[:, k].view(np.int64)


def shards(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Rows that come conversation by conversation, as tables of whole conversations, of about `least` rows each."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count < least:
            continue
        rows = pa.Table.from_batches(held)
        conv = rows.column("conv_id").to_numpy()
        cut = int(np.searchsorted(conv, conv[-1]))  # the last one may go on
        if cut:
            yield rows.slice(0, cut)
            held = rows.slice(cut).to_batches()
            count = len(conv) - cut
    if count:
        yield pa.Table.from_batches(held)


PARTS = "k0 long, k1 long, k2 long, p0 long, p1 long, depth long, n_bytes long, n_convs long, conv_id long, n_ends long, inner int"


def _members(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Each shard's nodes with members, smallest member, ends and whether they have children; then each conversation's end."""
    for rows in shards(batches, least):
        conv = rows.column("conv_id").to_numpy()
        s = Shard(conv, rows.column("pos").to_numpy() == 0, rows.column("t").to_pylist(), rows.column("n_bytes").to_numpy())
        ends, smallest, inner = np.bincount(s.ends, minlength=s.n), np.full(s.n, np.iinfo(np.int64).max), np.zeros(s.n, np.int32)
        own = conv[s.begin]
        np.minimum.at(smallest, s.ends, own)
        inner[s.parent[s.parent >= 0]] = 1
        p0, p1 = (pa.array(s.key(k)[s.parent], mask=s.parent < 0) for k in (0, 1))
        columns = [s.key(0), s.key(1), s.key(2), p0, p1, s.depth, s.n_bytes, s.up(ends.copy()), s.up(smallest, np.minimum), ends, inner]
        names = [x.split()[0] for x in PARTS.split(", ")]
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names)
        none = pa.nulls(len(own), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(s.key(0)[s.ends]), pa.array(s.key(1)[s.ends]), *[none] * 6, pa.array(own), none, pa.nulls(len(own), pa.int32())], names)


SUMS = "k0 long, k1 long, n_children long, n_leaves long, saved_tokens long"


def _sums(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """What the nodes of a shard's conversations add to themselves and their ancestors.

    After each conversation's rows come its own nodes: pos is their depth, n_bytes what they save, leaf whether they end it.
    """
    for rows in shards(batches, least):
        conv, own = rows.column("conv_id").to_numpy(), rows.column("leaf").to_numpy(zero_copy_only=False) >= 0
        owners = np.unique(conv[own])
        if not len(owners):
            continue
        path = ~own & (owners[np.minimum(np.searchsorted(owners, conv), len(owners) - 1)] == conv)
        walk = rows.filter(pa.array(path))
        s = Shard(walk.column("conv_id").to_numpy(), walk.column("pos").to_numpy() == 0, walk.column("t").to_pylist(), walk.column("n_bytes").to_numpy())
        mine = rows.filter(pa.array(own))
        at = s.at[s.begin[np.searchsorted(s.conv[s.begin], mine.column("conv_id").to_numpy())] + mine.column("pos").to_numpy()]
        leaves, saved, children = (np.zeros(s.n, np.int64) for _ in range(3))
        leaves[at], saved[at] = mine.column("leaf").to_numpy(), mine.column("n_bytes").to_numpy()
        above = s.parent[at]
        np.add.at(children, above[above >= 0], 1)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (s.key(0), s.key(1), children, s.up(leaves), s.up(saved))], ["k0", "k1", "n_children", "n_leaves", "saved_tokens"])


def _joined(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Ids in order of (node, id), comma-joined piece by piece: a node of very many ids gets some rows for each task."""
    node, first, held, size, out = None, 0, [], 0, []

    def flush() -> None:
        out.append((*node, first, ",".join(held).encode()))

    def made() -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["k0", "k1", "first", "ids"])
        out.clear()
        return rows

    for batch in batches:
        for k0, k1, conv in zip(*(batch.column(c).to_pylist() for c in ("k0", "k1", "conv_id")), strict=True):
            if (k0, k1) != node or size >= most:
                if held:
                    flush()
                node, first, held, size = (k0, k1), conv, [], 0
            held.append(str(conv))
            size += len(held[-1]) + 1
        if len(out) > 1000 or size and out:
            yield made()
    if held:
        flush()
    if out:
        yield made()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces in their order, one piece at a time."""
    node, running = None, None
    for batch in batches:
        out = []
        for k0, k1, ids in zip(*(batch.column(c).to_pylist() for c in ("k0", "k1", "ids")), strict=True):
            if (k0, k1) == node:
                running.update(b",")
            else:
                if node:
                    out.append((*node, running.hexdigest()))
                node, running = (k0, k1), hashlib.sha256()
            running.update(ids)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["k0", "k1", "ends"])
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, running.hexdigest())], ["k0", "k1", "ends"])


def prefix_trie(turns: DataFrame, shard_rows: int = SHARD_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row for each distinct prefix of the conversations: conv_id, depth, parent_conv_id and the counts below it.

    turns: (conv_id, pos, t, n_bytes) with a row of place 0 for each conversation; places may have gaps. conv_id is the
    smallest member, n_convs the members, n_children, n_leaves and saved_tokens (bytes of last texts, times members less
    one, over the subtree) follow, ends_sha256 is over the ids of members that end here. A conversation without turns is
    a member of the root alone; no conversations, no nodes. A conversation has to fit into one task's arrays (some 200
    bytes for a turn); nothing else does. shard_rows and chunk_bytes bound what a task holds and don't change the result.
    """
    spark = turns.sparkSession
    prepare(spark)
    turns = stored(turns, "op12-turns")
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    parts = stored(dealt.mapInArrow(partial(_members, least=shard_rows), PARTS), "op12-parts")
    nodes = parts.where("depth is not null").groupBy("k0", "k1").agg(
        F.min("k2").alias("low"), F.max("k2").alias("high"), F.min("p0").alias("p0"), F.min("p1").alias("p1"), F.min("depth").alias("depth"), F.min("n_bytes").alias("n_bytes"),
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_ends").alias("n_ends"), F.max("inner").alias("inner"),
    )
    nodes = stored(nodes, "op12-nodes")
    if not nodes.where("low <> high").isEmpty():
        raise ValueError("two different prefixes have the same digest")

    mine = nodes.select("conv_id", F.col("depth").alias("pos"), F.lit(None).cast("binary").alias("t"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("n_bytes"), (1 - F.col("inner")).alias("leaf"))
    both = turns.withColumn("leaf", F.lit(-1)).unionByName(mine).repartition("conv_id").sortWithinPartitions("conv_id", F.col("leaf") >= 0, "pos")
    sums = both.mapInArrow(partial(_sums, least=shard_rows), SUMS).groupBy("k0", "k1").agg(*(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")))
    ends = parts.where("depth is null").select("k0", "k1", "conv_id").repartitionByRange("k0", "k1", "conv_id").sortWithinPartitions("k0", "k1", "conv_id")
    ends = ends.mapInArrow(partial(_joined, most=chunk_bytes), "k0 long, k1 long, first long, ids binary").repartition("k0", "k1").sortWithinPartitions("k0", "k1", "first")
    ends = ends.mapInArrow(_digests, "k0 long, k1 long, ends string")

    # Children of the root know their parent; others meet theirs in a join whose large keys Spark can split.
    root = nodes.where("depth = 0").select(F.col("conv_id").alias("root"))
    first = nodes.where("depth < 2").join(F.broadcast(root)).withColumn("parent_conv_id", F.expr("case when depth = 1 then root end")).drop("root")
    above = nodes.where("depth > 0").select(F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv_id").alias("parent_conv_id"))
    every = first.unionByName(nodes.where("depth > 1").join(above, ["p0", "p1"]))
    out = every.join(sums, ["k0", "k1"], "left").join(ends, ["k0", "k1"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def conversation_trie(df: DataFrame, every: int = 5, most: int = 9, **limits: int) -> DataFrame:
    """prefix_trie, with its limits, of a table of turns (conv_id, turn, role, text) after with_shared_heads."""
    turns = stored(ordered_turns(df), "op12-ordered")
    out = prefix_trie(with_shared_heads(turns, every, most), **limits)
    release(turns)
    return out
