"""Benchmark decontamination with an FM-index for each training shard.

A shard is a few MB of documents. Its words become numbers: those that no benchmark window holds are left out, as no
window can reach over them, and what stands between is joined by separators. A suffix array of that sequence gives
its Burrows-Wheeler transform, held as a wavelet matrix. All windows are searched backward at once by wavelet ranks;
occurrences are located by walking to sampled suffix positions and merge into removal spans.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, bytes_of, documents, merged, passes, prepare, stored, words
from .common import hashes as hashes_of

#: Words of a window, bytes of text in a shard, bytes of benchmark text that a task holds, every how many positions are kept.
WINDOW, SHARD_BYTES, BLOCK_BYTES, SAMPLE = 10, 4 << 20, 4 << 20, 8
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
UPPER = bytes(range(65, 91))
LOWERED = bytes.maketrans(UPPER, UPPER.lower())


def suffix_array(t: np.ndarray) -> np.ndarray:
    """By prefix doubling, until all ranks differ."""
    n, k = len(t), 1
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, key[1:] != key[:-1]))
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


class FMIndex:
    """Of a sequence that ends with its only 0. Counts and positions of many patterns at once."""

    def __init__(self, t: np.ndarray, sample: int = SAMPLE):
        sa = suffix_array(t)
        self.bwt = t[sa - 1]
        self.before = np.append(0, np.cumsum(np.bincount(t)))
        self.marked = sa % sample == 0
        self.mark_rank = np.append(0, np.cumsum(self.marked))
        self.sampled = sa[self.marked]
        self.levels = []
        level = self.bwt
        for bit in range(max(int(t.max()).bit_length(), 1) - 1, -1, -1):
            ones = (level >> bit) & 1
            self.levels.append((bit, np.append(0, np.cumsum(ones)), len(t) - int(ones.sum())))
            level = np.concatenate([level[ones == 0], level[ones == 1]])

    def rank(self, c: np.ndarray, *at: np.ndarray) -> list[np.ndarray]:
        """How often each c stands in the transform before each position."""
        at = [np.zeros_like(c), *at]
        for bit, ones, zeros in self.levels:
            one = ((c >> bit) & 1).astype(bool)
            at = [np.where(one, zeros + ones[x], x - ones[x]) for x in at]
        return [x - at[0] for x in at[1:]]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [l, r) of the suffixes that begin with each pattern (rows of the matrix, equally long)."""
        l, r = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[:, k]
            live = c < len(self.before) - 1
            c = np.where(live, c, 0)
            x, y = self.rank(c, l, r)
            l, r = self.before[c] + x, np.where(live, self.before[c] + y, 0)
            r = np.maximum(l, r)
        return l, r

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes by their rows."""
        out, steps, todo = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            hit = self.marked[rows]
            out[todo[hit]] = self.sampled[self.mark_rank[rows[hit]]] + steps
            todo, rows = todo[~hit], rows[~hit]
            if len(rows):
                c = self.bwt[rows]
                rows = self.before[c] + self.rank(c, rows)[0]
            steps += 1
        return out


class Windows:
    """The windows of a block of benchmark items as numbers, by length."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = [i for i, _ in items]
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int]] = {}
        for k, (_, text) in enumerate(items):
            w = [vocabulary.setdefault(x, len(vocabulary)) for x in WORD.findall((text or "").encode().translate(LOWERED))]
            for p in range(len(w) - window + 1 if len(w) > window else bool(w)):
                found.setdefault(tuple(w[p : p + window]), set()).add(k)
        blob, sizes = b"".join(vocabulary), np.array([len(x) for x in vocabulary], np.int64)
        ends = np.cumsum(sizes)
        hashes = hashes_of(np.frombuffer(blob, np.uint8), ends - sizes, ends)
        order = np.argsort(hashes)
        self.blob, self.begin, self.size = np.frombuffer(blob, np.uint8), (ends - sizes)[order], sizes[order]
        self.hashes, self.symbols = hashes[order], (order + 2).astype(np.int64)  # 0 ends the sequence, 1 separates
        self.shortest = min(map(len, found), default=window)
        self.by_length = []
        for n in sorted({len(x) for x in found}):
            some = [x for x in found if len(x) == n]
            owners = [sorted(found[x]) for x in some]
            self.by_length.append((np.array(some, np.int64) + 2, np.array([len(x) for x in owners]), np.array([i for x in owners for i in x], np.int64)))


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether ranges of two buffers, of the same positive sizes, hold the same bytes."""
    if not len(sizes):
        return np.zeros(0, bool)
    differ = a[ranges(a_starts, sizes)] != b[ranges(b_starts, sizes)]
    return ~np.logical_or.reduceat(differ, np.cumsum(sizes) - sizes)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def shard_hits(raw: np.ndarray, offsets: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one shard: words of each row, hit words of each row, (row, item) pairs, and hit spans as (row, start, end)."""
    n_rows = len(offsets) - 1
    low = LOWER[raw]
    starts, ends, rows = words(low, offsets, ALNUM)
    n_words = np.bincount(rows, minlength=n_rows)
    out = n_words, np.zeros(n_rows, np.int64), np.zeros((0, 2), np.int64), np.zeros((0, 3), np.int64)
    if not len(starts) or not len(w.hashes):
        return out
    h = hashes_of(low, starts, ends)
    at = np.minimum(np.searchsorted(w.hashes, h), len(w.hashes) - 1)
    known = (w.hashes[at] == h) & (w.size[at] == ends - starts)
    while True:  # hashes only find words; those of a stretch are compared by their bytes
        # Stretches of known words of one row, as long as the shortest window at least.
        brk = np.ones(len(known) + 1, bool)
        brk[1:-1] = (known[1:] != known[:-1]) | (rows[1:] != rows[:-1])
        edge = np.flatnonzero(brk)
        first, size = edge[:-1], np.diff(edge)
        good = known[first] & (size >= w.shortest)
        first, size = first[good], size[good]
        if not len(first):
            return out
        some = ranges(first, size)
        right = same_bytes(low, starts[some], w.blob, w.begin[at[some]], w.size[at[some]])
        if right.all():
            break
        known[some[~right]] = False
    word = np.full(size.sum() + len(first) + 1, -1, np.int64)
    place = ranges(np.cumsum(size + 1) - size - 1, size)
    word[place] = ranges(first, size)
    t = np.ones(len(word), np.int64)
    t[place] = w.symbols[at[word[place]]]
    t[-1] = 0
    index = FMIndex(t)
    cover = np.zeros(len(starts) + 1, np.int64)
    pairs = []
    for patterns, counts, owners in w.by_length:
        l, r = index.search(patterns)
        occ = r - l
        hit = np.flatnonzero(occ)
        if not len(hit):
            continue
        where = word[index.locate(ranges(l[hit], occ[hit]))]
        np.add.at(cover, where, 1)
        np.add.at(cover, where + patterns.shape[1], -1)
        which = np.repeat(hit, occ[hit])
        seen = np.unique(rows[where] * len(counts) + which)
        row, which = seen // len(counts), seen % len(counts)
        begin = np.cumsum(counts) - counts
        pairs.append(np.stack([np.repeat(row, counts[which]), owners[ranges(begin[which], counts[which])]], 1))
    hit = np.cumsum(cover)[:-1] > 0
    n_hit = np.bincount(rows[hit], minlength=n_rows)
    pairs = np.unique(np.concatenate(pairs), axis=0) if pairs else out[2]
    begin = np.flatnonzero(hit & ~(np.append(False, hit[:-1]) & np.append(False, rows[1:] == rows[:-1])))
    stop = np.flatnonzero(hit & ~(np.append(hit[1:], False) & np.append(rows[1:] == rows[:-1], False)))
    spans = np.stack([rows[begin], starts[begin] - offsets[rows[begin]], ends[stop] - offsets[rows[begin]]], 1)
    return n_words, n_hit, pairs, spans


SPANS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


SHAPE = "doc_id long, n_words long, n_hit long, items array<string>, spans array<struct<s:long,e:long>>"
NAMES = [x.split(" ")[0] for x in SHAPE.split(", ")]


def found_in(raw: np.ndarray, offsets: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray, list[list[str]], list[list[dict]]]:
    """shard_hits with the items' names and the spans of each row as lists."""
    n_words, n_hit, pairs, spans = shard_hits(raw, offsets, w)
    names: list[list[str]] = [[] for _ in n_words]
    for row, item in pairs.tolist():
        names[row].append(w.names[item])
    where: list[list[dict]] = [[] for _ in n_words]
    for row, s, e in spans.tolist():
        where[row].append({"s": s, "e": e})
    return n_words, n_hit, names, where


def result(ids: pa.Array, n_words: np.ndarray, n_hit: np.ndarray, names: list, where: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(where, SPANS)], NAMES)


def _search(items: list[tuple[str, str]], window: int):
    """For a benchmark that fits a task: each shard is what a task reads next."""

    def go(batches):
        w = Windows(items, window)
        for batch in batches:
            raw, offsets = bytes_of(batch.column("text"))
            for i, j in passes(offsets, SHARD_BYTES):
                yield result(batch.column("doc_id").slice(i, j - i), *found_in(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], w))

    return go


def _cut(window: int):
    """An item's windows: its name and their words with spaces between."""

    def go(batches):
        for batch in batches:
            names, cut = [], []
            for name, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                w = WORD.findall((text or "").encode().translate(LOWERED))
                some = {b" ".join(w[p : p + window]).decode() for p in range(len(w) - window + 1 if len(w) > window else bool(w))}
                names += [name] * len(some)
                cut += some
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(cut, pa.string())], ["item_id", "window"])

    return go


def _held(batches):
    """(shard, word) of the documents' words, once for each document."""
    for batch in batches:
        shards, found = [], []
        for shard, text in zip(batch.column("shard").to_pylist(), batch.column("text").to_pylist()):
            some = set(WORD.findall(text.encode().translate(LOWERED)))
            shards += [shard] * len(some)
            found += [x.decode() for x in some]
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), pa.array(found, pa.string())], ["shard", "word"])


def _routed(window: int, block_bytes: int):
    """Over each shard's documents and then the windows that were sent to it, which are searched block by block."""

    class Shard:
        def __init__(self):
            self.ids, self.texts, self.block, self.size, self.names, self.spans = [], [], [], 0, [], []

        def search(self) -> None:
            n = len(self.ids)
            blob = b"".join(self.texts)
            offsets = np.append(0, np.cumsum([len(t) for t in self.texts])).astype(np.int64)
            self.n_words, _, names, spans = found_in(np.frombuffer(blob, np.uint8), offsets, Windows(self.block, window))
            self.names, self.spans = ([x + y for x, y in zip(old or [[]] * n, new)] for old, new in ((self.names, names), (self.spans, spans)))
            self.block, self.size = [], 0

        def close(self) -> pa.RecordBatch:
            if self.block or not self.names:
                self.search()
            n_hit, where = [], []
            for text, spans in zip(self.texts, self.spans):
                s, e = merged(np.array([x["s"] for x in spans], np.int64), np.array([x["e"] for x in spans], np.int64))
                low = text.translate(LOWERED) if len(s) else b""
                where.append([{"s": a, "e": b} for a, b in zip(s.tolist(), e.tolist())])
                n_hit.append(sum(len(WORD.findall(low[a:b])) for a, b in zip(s.tolist(), e.tolist())))
            return result(pa.array(self.ids, pa.int64()), self.n_words, np.array(n_hit, np.int64), [sorted(set(x)) for x in self.names], where)

    def go(batches):
        now, shard = None, None
        for batch in batches:
            for key, doc, text, names in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "text", "names"))):
                if key != now:
                    if shard:
                        yield shard.close()
                    now, shard = key, Shard()
                if names is None:
                    shard.ids.append(doc)
                    shard.texts.append(text.encode())
                    continue
                shard.block += [(name, text) for name in names]
                shard.size += len(names) * len(text)
                if shard.size > block_bytes:
                    shard.search()
        if shard:
            yield shard.close()

    return go


def decontaminate(df: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Words of each document that lie in an occurrence of a benchmark window.

    Returns doc_id, n_words, n_hit, items (the ids, as strings, of items with occurring windows), spans (array of s, e:
    maximal runs of hit words, in bytes). A window is `window` consecutive words of an item, or a whole shorter item.
    Words are ASCII letters (lower-cased), digits and all characters past ASCII. Null and empty texts have no words and
    items without words no windows; repeated rows, of the same text or another, are searched each. Empty tables give no
    hits or an empty result; other columns are ignored. Rows without doc_id and items without item_id are left out.

    A benchmark of at most block_bytes goes to every task. The windows of a larger one are a table: each is sent to the
    shards, of about shard_bytes of documents, that hold its rarest word (rarest in the benchmark), and a shard searches
    its windows block by block in an index of its own. So the documents are read a fixed number of times, whatever the
    benchmark's size, and no block of it passes the driver. Results are the same.
    """
    spark = df.sparkSession
    prepare(spark)
    docs = documents(df)
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + F.octet_length("item_id"))).first()[0] or 0
    if total <= block_bytes:
        return docs.mapInArrow(_search([tuple(r) for r in items.collect()], window), SHAPE)
    windows = stored(items.mapInArrow(_cut(window), "item_id string, window string").groupBy("window").agg(F.collect_set("item_id").alias("names")), "op4-windows")
    each = windows.select("window", F.explode(F.array_distinct(F.split("window", " "))).alias("word"))
    often = each.groupBy("word").agg(F.count("*").alias("often"))
    rarest = each.join(often, "word").groupBy("window").agg(F.min_by("word", F.struct("often", "word")).alias("word"))
    rarest = stored(rarest, "op4-rarest")
    size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    dealt = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(int(-(-size // shard_bytes)) or 1)))
    where = dealt.select("shard", "text").mapInArrow(_held, "shard long, word string").join(rarest.select("word").distinct(), "word").distinct()
    sent = where.join(rarest, "word").select("shard", "window").join(windows, "window")
    both = dealt.select("shard", "doc_id", "text", F.lit(None).cast("array<string>").alias("names")).unionByName(sent.select("shard", F.lit(None).cast("long").alias("doc_id"), F.col("window").alias("text"), "names"))
    both = both.repartition("shard").sortWithinPartitions("shard", F.col("names").isNotNull())
    return both.mapInArrow(_routed(window, block_bytes), SHAPE)


def digest(hits: DataFrame) -> DataFrame:
    """The counts and the digest of the item ids, sorted as strings."""
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
