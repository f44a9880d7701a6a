"""Merkle manifest of a dataset: leaves by bitmap ranks, levels by keyed slot arrays, proofs from the root down.

Every task turns the doc_ids it reads into compressed bitmaps, one for each group and 4,096 ids; those of one range are
merged, and popcount directories answer how many ids come before any. Together with the totals of earlier ranges that is a
leaf's coordinate, so leaves are never sorted. Leaves then meet in blocks of 2^bits coordinates, each scattered into a slot
array that is reduced level by level to one node; blocks of blocks follow until one node is left. Proofs go the other way: a
block learns its own siblings up to the root and tells its members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, release, stored

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bits of a doc_id that tell its place in a bitmap, and that bitmap's values.
LOW, WIDTH = 12, 1 << 12
#: Rows that a task turns into bitmaps at once, leaves of a range that meet in one task, and rows of a result's batch.
HELD, MEET, BATCH = 1 << 18, 1 << 18, 1 << 13


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(c: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; null as a dash."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaves(df: DataFrame, every: int = 7) -> DataFrame:
    """(g, doc_id, hi, lo, leaf, bad): every row's digest, and that of a tampered row where unsigned crc32 of doc_id is divisible by `every`.

    g is the lang with a mark before it, so that null is a group of its own and comes first; hi and lo are the doc_id's
    upper bits and its last 12. A null doc_id is one value before all others.
    """
    c = {k: F.col(k) for k in COLUMNS}
    digest = lambda v: F.unhex(F.sha2(F.concat(*(encoded(v[k]) for k in COLUMNS)), 256))
    odd = (F.crc32(c["doc_id"].cast("string")) % every == 0) & c["n_chars"].isNotNull()
    i = c["doc_id"].cast("long")
    hi = F.coalesce(F.shiftright(i, LOW), F.lit(-(1 << 63 - LOW) - 1))
    lo = F.coalesce(i.bitwiseAND(WIDTH - 1), F.lit(0)).cast("int")
    group = F.coalesce(F.concat(F.lit("1"), c["lang"]), F.lit("0"))
    return df.select(group.alias("g"), i.alias("doc_id"), hi.alias("hi"), lo.alias("lo"), digest(c).alias("leaf"), F.when(odd, digest(c | {"n_chars": c["n_chars"].cast("decimal(20,0)") + 1})).alias("bad"))


class Bitmap:
    """Up to 4,096 values of 12 bits, with a directory of the bits before each word.

    Packed it is the array of values where that is shorter than the bits, else the 512 bytes of bits.
    """

    def __init__(self, values: np.ndarray):
        bits = np.zeros(WIDTH, np.uint8)
        bits[values] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.directory = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, value: np.ndarray) -> np.ndarray:
        """How many of the values are less."""
        word, bit = value >> 6, (value & 63).astype(np.uint64)
        return self.directory[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


def packed(values: np.ndarray) -> bytes:
    if len(values) < WIDTH // 16:
        return values.astype(np.uint16).tobytes()
    bits = np.zeros(WIDTH, np.uint8)
    bits[values] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if len(data) < WIDTH // 8:
        return np.frombuffer(data, np.uint16).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little"))


def repeats(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Values that come more than once, with how often more."""
    some = counts > 1
    return ((counts[some] - 1) << LOW | values[some]).astype(np.int64).tobytes()


def counted(data: bytes, more: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Values and their counts."""
    values = unpacked(data)
    counts, extra = np.ones(len(values), np.int64), np.frombuffer(more, np.int64)
    counts[np.searchsorted(values, extra & (WIDTH - 1))] += extra >> LOW
    return values, counts


def pieces(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows with equal keys; a key may come in several."""
    for batch in batches:
        each = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        cuts = [0, *(i for i in range(1, len(each)) if each[i] != each[i - 1]), len(each)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if a < z:
                yield each[a], batch.slice(a, z - a)


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.Table]]:
    """All rows of a key, whose number the caller bounds."""
    now, held = None, []
    for key, rows in pieces(batches, keys):
        if key != now and held:
            yield now, pa.Table.from_batches(held)
            held = []
        now = key
        held.append(rows)
    if held:
        yield now, pa.Table.from_batches(held)


def batched(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a useful size."""
    held, n = [], 0
    for batch in rows:
        held.append(batch)
        n += batch.num_rows
        if n >= BATCH:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task reads, HELD rows at a time, as bitmaps: g, hi, bits, more."""

    def made(rows: pa.Table) -> pa.RecordBatch:
        code = rows.column("g").combine_chunks().dictionary_encode()
        g, hi, lo = code.indices.to_numpy(), rows.column("hi").to_numpy(), rows.column("lo").to_numpy()
        order = np.lexsort((lo, hi, g))
        g, hi, lo = g[order], hi[order], lo[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (hi[1:] != hi[:-1])
        out = []
        for part in np.split(np.arange(len(g)), np.flatnonzero(new)[1:]):
            values, counts = np.unique(lo[part], return_counts=True)
            out.append((code.dictionary[int(g[part[0]])].as_py(), int(hi[part[0]]), packed(values), repeats(values, counts)))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["g", "hi", "bits", "more"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= HELD:
            yield made(pa.Table.from_batches(held))
            held, n = [], 0
    if n:
        yield made(pa.Table.from_batches(held))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps in order of (g, hi), merged, with their rows (n), those of repeated ids' further rows (extra) and the group's rows before in this task."""

    def summed(values: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
        v, back = np.unique(np.concatenate(values), return_inverse=True)
        return v, np.bincount(back, np.concatenate(counts), len(v)).astype(np.int64)

    def each() -> Iterator[pa.RecordBatch]:
        now, values, counts, before = None, [], [], 0

        def flush() -> tuple[int, pa.RecordBatch]:
            v, c = summed(values, counts)
            n = int(c.sum())
            row = (now[0], now[1], n, n - len(v), before, packed(v), repeats(v, c))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return n, pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], ["g", "hi", "n", "extra", "before", "bits", "more"])

        for key, rows in pieces(batches, ("g", "hi")):
            if key != now:
                if now:
                    n, out = flush()
                    yield out
                    before = before + n if key[0] == now[0] else 0
                now, values, counts = key, [], []
            for bits, more in zip(rows.column("bits").to_pylist(), rows.column("more").to_pylist(), strict=True):
                v, c = counted(bits, more)
                values.append(v)
                counts.append(c)
                if len(values) > 64:
                    v, c = summed(values, counts)
                    values, counts = [v], [c]
        if now:
            yield flush()[1]

    return batched(each())


def bitmaps(rows: DataFrame) -> DataFrame:
    """(g, hi, bits, more, n, extra, base, total): merged bitmaps, the group's rows before each and in all.

    Ranges of (g, hi) are cut by Spark; each task adds up its own, and sums of earlier tasks come from a row for each
    task and group, so nothing runs over all bitmaps.
    """
    parts = rows.select("g", "hi", "lo").mapInArrow(_bitmaps, "g string, hi long, bits binary, more binary")
    kept = parts.repartitionByRange("g", "hi").sortWithinPartitions("g", "hi").mapInArrow(_merged, "g string, hi long, n long, extra long, before long, bits binary, more binary")
    kept = stored(kept.withColumn("part", F.spark_partition_id()), "op13-bitmaps")
    sizes = kept.groupBy("g", "part").agg(F.sum("n").alias("size"))
    own = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("g", "part", F.coalesce(F.sum("size").over(own), F.lit(0)).alias("earlier"), F.sum("size").over(Window.partitionBy("g")).alias("total"))
    return kept.join(sizes, ["g", "part"]).withColumn("base", F.col("earlier") + F.col("before")).drop("part", "before", "earlier")


def _coordinates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """After each range's bitmap its leaves: i is the coordinate, for a repeated id that of its first row, and dup is set."""

    def each() -> Iterator[pa.RecordBatch]:
        key, bitmap, values, ahead, counts, base, total = None, None, None, None, None, 0, 0
        for k, rows in pieces(batches, ("g", "hi", "salt", "kind")):
            if k[3] == 0:
                row = rows.to_pylist()[0]
                values, counts = counted(row["bits"], row["more"])
                key, bitmap, base, total = k[:3], Bitmap(values), row["base"], row["total"]
                ahead = np.concatenate([[0], np.cumsum(counts - 1)])
                continue
            if k[:3] != key:
                raise ValueError("leaves without their bitmap")
            rank = bitmap.rank(rows.column("lo").to_numpy().astype(np.int64))
            i = base + rank + ahead[rank]
            names = ["g", "doc_id", "leaf", "bad"]
            more = [pa.array(i), pa.array(np.full(len(i), total)), pa.array(counts[rank] > 1)]
            yield pa.RecordBatch.from_arrays([rows.column(c) for c in names] + more, [*names, "i", "total", "dup"])

    return batched(each())


def numbered(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds at (0, 1, ... within the group, in the order of columns that no two rows share), cut into ranges, so no group meets in one task."""
    ranged = stored(df.repartitionByRange(*group, *order).withColumn("part", F.spark_partition_id()), name)
    own = F.row_number().over(Window.partitionBy("part", *group).orderBy(*order))
    sizes = ranged.groupBy("part", *group).agg(F.count("*").alias("size"))
    before = F.sum("size").over((Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("before", F.coalesce(before, F.lit(0))).drop("size")
    return ranged.withColumn("own", own).join(sizes, ["part", *group]).withColumn("at", F.col("before") + F.col("own") - 1).drop("part", "own", "before")


def coordinates(rows: DataFrame, meet: int = MEET) -> DataFrame:
    """(g, i, total, doc_id, leaf, bad): leaves with their place in their group, by doc_id; rows that repeat an id by their leaves.

    A range of ids has 4,096 rows at most unless ids repeat; one of more than `meet` rows is dealt to several tasks,
    each of which gets its bitmap.
    """
    maps = stored(bitmaps(rows), "op13-ranges")
    hot = maps.where(F.col("n") > meet).select("g", "hi", F.ceil(F.col("n") / meet).cast("int").alias("salts"))
    rows, once = rows.withColumn("salt", F.lit(0)), maps.withColumn("salt", F.lit(0))
    if not hot.isEmpty():
        salted = rows.join(hot, ["g", "hi"], "left").withColumn("salt", F.expr("cast(coalesce(pmod(xxhash64(monotonically_increasing_id()), salts), 0) as int)")).drop("salts")
        rows = stored(salted, "op13-salted")
        once = maps.join(hot, ["g", "hi"], "left").withColumn("salt", F.explode(F.expr("sequence(0, coalesce(salts, 1) - 1)"))).drop("salts")
    both = once.drop("n", "extra").withColumn("kind", F.lit(0)).unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    both = both.repartition("g", "hi", "salt").sortWithinPartitions("g", "hi", "salt", "kind")
    out = both.mapInArrow(_coordinates, "g string, doc_id long, leaf binary, bad binary, i long, total long, dup boolean")
    if maps.where("extra > 0").isEmpty():
        return out.drop("dup")
    out = stored(out, "op13-places")
    again = numbered(out.where("dup").withColumn("rid", F.monotonically_increasing_id()), ["g", "i"], ["leaf", "rid"], "op13-repeats")
    return out.where("not dup").drop("dup").unionByName(again.withColumn("i", F.col("i") + F.col("at")).drop("dup", "rid", "at"))


def levels(nodes: list[str], most: int | None) -> list[list[str]]:
    """All levels from these nodes up: `most` steps, or until one node is left."""
    out = [nodes]
    while (len(out) <= most) if most is not None else (len(out[-1]) > 1):
        last = out[-1]
        out.append([h(*last[k : k + 2]) for k in range(0, len(last), 2)])
    return out


def slots(rows: pa.Table, bits: int) -> tuple[np.ndarray, list[str], int]:
    """Places in the block, the block's nodes scattered by them, and the group's nodes in all."""
    at, total = rows.column("i").to_numpy() & ((1 << bits) - 1), rows.column("total")[0].as_py()
    nodes: list[str] = [""] * len(at)
    for k, d in zip(at.tolist(), rows.column("d").to_pylist(), strict=True):
        nodes[k] = d.hex()
    return at, nodes, total


def _reduced(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """One node for each block of 2^bits."""

    def each() -> Iterator[pa.RecordBatch]:
        for (g, block), rows in runs(batches, ("g", "block")):
            _, nodes, total = slots(rows, bits)
            top = levels(nodes, bits if total > 1 << bits else None)[-1][0]
            row = ((g, pa.string()), (block, pa.int64()), (-(-total >> bits), pa.int64()), (bytes.fromhex(top), pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in row], ["g", "i", "total", "d"])

    return batched(each())


def blocked(nodes: DataFrame, bits: int, *before: str) -> DataFrame:
    return nodes.repartition("g", "block").sortWithinPartitions("g", "block", *before)


def tree(nodes: DataFrame, most: int, bits: int, name: str) -> list[DataFrame]:
    """Tables of nodes (g, i, total, d), from the given one up to one node for each group; `most` is the largest total."""
    rounds = [nodes]
    while most > 1:
        keyed = rounds[-1].select("g", "i", "total", "d", F.shiftright("i", bits).alias("block"))
        rounds.append(stored(blocked(keyed, bits).mapInArrow(partial(_reduced, bits=bits), "g string, i long, total long, d binary"), name))
        most = -(-most >> bits)
    return rounds


#: Steps of a path: nobody beside the node, a sibling after it, a sibling before it.
ALONE, AFTER, BEFORE = b"\0", b"\1", b"\2"


def climb(tower: list[list[str]], at: int) -> bytes:
    """A node's siblings, level by level, as a path."""
    steps = []
    for level in tower[:-1]:
        other = at ^ 1
        steps.append(ALONE if other >= len(level) else (BEFORE if at & 1 else AFTER) + bytes.fromhex(level[other]))
        at >>= 1
    return b"".join(steps)


def folded(leaf: str, path: bytes) -> tuple[str, str]:
    """The root that a leaf and its path give, and the digest of the path's siblings."""
    at, beside = 0, []
    while at < len(path):
        step = path[at : at + 1]
        if step == ALONE:
            leaf, at = h(leaf), at + 1
            continue
        other, at = path[at + 1 : at + 33].hex(), at + 33
        beside.append(other)
        leaf = h(leaf, other) if step == AFTER else h(other, leaf)
    return leaf, h(*beside)


def _paths(batches: Iterator[pa.RecordBatch], bits: int, last: bool) -> Iterator[pa.RecordBatch]:
    """After each block's own path its nodes: their paths to the root, or with `last` what the paths of leaves give."""

    def each() -> Iterator[pa.RecordBatch]:
        for (g, _), rows in runs(batches, ("g", "block")):
            above, subroot = rows.column("path")[0].as_py(), rows.column("subroot")[0].as_py()
            rows = rows.slice(1)
            at, nodes, total = slots(rows, bits)
            tower = levels(nodes, bits if total > 1 << bits else None)
            paths = [climb(tower, k) + above for k in at.tolist()]
            same = pa.array([subroot] * len(paths), pa.string())
            if not last:
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(paths), pa.string()), rows.column("i").combine_chunks(), pa.array(paths, pa.binary()), same], ["g", "i", "path", "subroot"])
                continue
            leaf = [nodes[k] for k in at.tolist()]
            bad = [x.hex() if x else y for x, y in zip(rows.column("bad").to_pylist(), leaf, strict=True)]
            root, proof = zip(*(folded(x, p) for x, p in zip(bad, paths, strict=True)), strict=True)
            columns = [rows.column("doc_id").combine_chunks(), pa.array(leaf), same, pa.array(proof), pa.array(root)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])

    return batched(each())


def descend(nodes: DataFrame, above: DataFrame, bits: int, last: bool = False) -> DataFrame:
    """Paths of nodes from those of their blocks, which are the nodes (g, i) of the table above."""
    keyed = nodes.withColumns({"block": F.shiftright("i", bits), "kind": F.lit(1)})
    own = above.select("g", F.col("i").alias("block"), "path", "subroot", F.lit(0).alias("kind"))
    both = blocked(own.unionByName(keyed, allowMissingColumns=True), bits, "kind")
    schema = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string" if last else "g string, i long, path binary, subroot string"
    return both.mapInArrow(partial(_paths, bits=bits, last=last), schema)


def manifest(df: DataFrame, every: int = 7, bits: int = 12, meet: int = MEET) -> DataFrame:
    """Every row as a leaf of its lang's tree, under one root: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves ascend by doc_id, null first; rows that repeat a doc_id in one lang by their leaf, and equal rows in any order.
    Every value may be null; a null lang is a group of its own, the first. Rows whose doc_id's crc32 is divisible by
    `every` are tampered with (n_chars plus 1, unless null) before they are folded up, so verified is false for just
    those. An empty table gives no rows. Other columns are ignored. bits (of a block's coordinates) and meet (rows of
    one range of ids in a task) don't change the result.
    """
    spark = df.sparkSession
    prepare(spark)
    rows = stored(leaves(df, every), "op13-leaves")
    placed = stored(coordinates(rows, meet).withColumnRenamed("leaf", "d"), "op13-nodes")
    release(rows)
    most = placed.agg(F.max("total")).first()[0] or 0
    rounds = tree(placed, most, bits, "op13-nodes")

    subroots = rounds[-1].select("g", F.col("d"))
    few = subroots.count()
    top = numbered(subroots, [], ["g"], "op13-groups").select(F.lit("").alias("g"), F.col("at").alias("i"), F.lit(few).cast("long").alias("total"), "d", F.col("g").alias("own"))
    tops = tree(stored(top, "op13-top"), few, bits, "op13-top")
    root = (tops[-1].first() or [None, None, None, b""])[3].hex()

    paths = tops[-1].select("g", "i", F.lit(b"").alias("path"), F.lit("").alias("subroot"))
    for nodes in reversed(tops[:-1]):
        paths = descend(nodes.select("g", "i", "total", "d"), paths, bits)
    paths = tops[0].select("i", "own", "d").join(paths.select("i", "path"), "i")
    paths = paths.select(F.col("own").alias("g"), F.lit(0).cast("long").alias("i"), "path", F.lower(F.hex("d")).alias("subroot"))
    for nodes in reversed(rounds[1:-1]):
        paths = stored(descend(nodes, paths, bits), "op13-paths")
    out = descend(placed, paths, bits, last=True)
    return out.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))

