"""LM scoring by prediction by partial matching over bytes, and over segments above them.

The model is the trie of all contexts of up to four bytes in the training documents with what follows them. A byte's
probability is its share in the longest context that knows it, after an escape from every longer one (method C:
as many escapes as distinct symbols), symbols of a longer context excluded from the shorter. As that depends on the
last five bytes only, the trie is kept as a table of 5-grams: counts are summed by Spark, all contexts of one suffix of
two bytes meet in one place, where their escapes and exclusions are worked out, and every 5-gram gets its code length.

Longer contexts than that are kept where they pay: text is cut, at places that its words choose, into segments of some
three dozen words, and a trie of segments stands above the one of bytes. A segment is coded by its share among what
followed the one before it (one escape a context), else by its share among all segments (method C), else byte by byte.
So passages and documents that training knows cost little, however long. Segments that a training document brought
itself are taken out of the counts before it is scored; else it would only be compared with itself.

Nothing of corpus size is broadcast. Documents are dealt into blocks of bounded size; a block's distinct 5-grams are
joined with their code lengths and return as that block's own dictionary. Of words and segments a block counts its own
again; what comes back to it are the totals of those that other blocks hold too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, MIX1, MIX2, NOT_SPACE, Rolling, bytes_of, documents, hashes, mix, passes, prepare, release, stored, words

ORDER, BLOCK_BYTES, HELD = 4, 16 << 20, 200_000
#: A cut follows one in so many pairs of words.
SEGMENT = 32
#: Symbols past the bytes, and bits of a symbol in a 5-gram's key.
END, BEFORE, BITS = 256, 257, 9
LAST, TWO = (1 << BITS) - 1, (1 << 2 * BITS) - 1
#: The top bits of a key say what it is.
PAIR_KEY, WORD_KEY, SEGMENT_KEY = (k << 61 for k in (1, 2, 3))


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key of the five symbols that end at each byte and at the end of each row, and how many a row has.

    Before a row stand four symbols and after it one that no byte equals.
    """
    n = np.diff(offsets)
    rows = np.repeat(np.arange(len(n)), n)
    padded = np.full(len(raw) + 5 * len(n), BEFORE, np.int64)
    ends = offsets[1:] + 5 * np.arange(1, len(n) + 1)
    padded[np.arange(len(raw)) + 5 * rows + ORDER] = raw
    padded[ends - 1] = END
    k = np.zeros(max(len(padded) - ORDER, 0), np.int64)
    for j in range(ORDER + 1):
        k <<= BITS
        k |= padded[j : j + len(k)]
    inside = np.ones(len(padded), bool)
    for j in range(1, ORDER + 1):
        inside[ends - j] = False
    return k[inside[: len(k)]], n + 1


def word_keys(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of words (A-Z in lower case) and the row of each."""
    low = LOWER[raw]
    starts, ends, rows = words(low, offsets, NOT_SPACE)
    return (hashes(low, starts, ends) >> np.uint64(3)).view(np.int64) | WORD_KEY, rows


def segments(raw: np.ndarray, offsets: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, row and key of every segment, and the key of it after the one before it (0 for a row's first).

    Every row has one at least. The last of a row is another than the same bytes elsewhere: it says that the row ends.
    """
    n = len(offsets) - 1
    starts, ends, of = words(raw, offsets, NOT_SPACE)
    rolling = Rolling(raw)
    h = rolling.ranges(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    pick = np.flatnonzero((mix(h[:-2] * MIX2 + h[1:-1]) % np.uint64(segment) == 0) & (of[:-2] == of[2:])) + 2
    pos, rows = np.concatenate([offsets[:-1], starts[pick]]), np.concatenate([np.arange(n), of[pick]])
    order = np.lexsort((pos, rows))
    pos, rows = pos[order], rows[order]
    last = np.append(rows[1:] != rows[:-1], True)[: len(rows)]
    h = rolling.ranges(pos, np.where(last, offsets[rows + 1], np.append(pos[1:], 0)[: len(pos)]))
    h = mix(h + last.astype(np.uint64) * MIX1)
    pair = np.zeros(len(h), np.int64)
    follows = np.flatnonzero(~np.append(True, last[:-1])[: len(h)])
    pair[follows] = (mix(h[follows - 1] * MIX1 + h[follows]) >> np.uint64(3)).view(np.int64) | PAIR_KEY
    return pos, rows, (h >> np.uint64(3)).view(np.int64) | SEGMENT_KEY, pair


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of counts by key."""
    keys = np.concatenate([np.zeros(0, np.int64), *(k for k, _ in parts)])
    counts = np.concatenate([np.zeros(0, np.int64), *(c for _, c in parts)])
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first)


def _deal(block_bytes: int):
    """Put rows, as they come, into blocks of bounded size; a block has rows of one task only."""

    def go(batches):
        from pyspark import TaskContext

        block, used = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = np.diff(bytes_of(batch.column("text"))[1]) + 16
            at = 0
            while at < batch.num_rows:
                fits = int(np.searchsorted(np.cumsum(sizes[at:]), block_bytes - used, "right"))
                if not fits and used:
                    block, used = block + 1, 0
                    continue
                fits = max(fits, 1)
                part = batch.slice(at, fits)
                yield part.append_column("block", pa.array(np.full(fits, block)))
                used += int(sizes[at : at + fits].sum())
                at += fits

    return go


def _count(batches):
    """The distinct keys of each block with how often its training documents hold them."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    block = None

    def closed() -> pa.RecordBatch:
        keys, counts = summed(parts)
        parts.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), block), pa.int64()), pa.array(keys), pa.array(counts)], ["block", "key", "n"])

    for batch in batches:
        raw, offsets = bytes_of(batch.column("text"))
        train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
        of_block = batch.column("block").to_numpy()
        edges = np.append(np.flatnonzero(np.append(True, of_block[1:] != of_block[:-1])), batch.num_rows)
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if block is not None and of_block[x] != block:
                yield closed()
            block = int(of_block[x])
            for i, j in passes(offsets[x : y + 1]):
                part, off, own = raw[offsets[x + i] : offsets[x + j]], offsets[x + i : x + j + 1] - offsets[x + i], train[x + i : x + j]
                g, n = grams(part, off)
                w, rows = word_keys(part, off)
                _, of, seg, pair = segments(part, off)
                inner = pair != 0
                for keys, is_train in ((g, np.repeat(own, n)), (w, own[rows]), (seg, own[of]), (pair[inner], own[of[inner]])):
                    parts.append(np.unique(keys[is_train], return_counts=True))
                    other = np.unique(keys[~is_train])
                    parts.append((other, np.zeros(len(other), np.int64)))
                if len(parts) > 90:
                    parts[:] = [summed(parts)]
    if block is not None:
        yield closed()
    pa.default_memory_pool().release_unused()


def code_lengths(keys: np.ndarray, counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 probability of each 5-gram's last byte after its first four.

    keys: all 5-grams of whole two-byte suffixes of the context; counts: in training, 0 included. first: training counts
    by (last symbol of the context, symbol).
    """
    symbol = keys & LAST
    logp = np.zeros(len(keys))
    done = np.zeros(len(keys), bool)
    # Levels from the longest context down: the context and the count of (context, symbol) of each row.
    level = []
    for bits in (5 * BITS, 4 * BITS, 3 * BITS):
        own = keys & ((1 << bits) - 1)
        uniq, inv = np.unique(own, return_inverse=True)
        c = np.bincount(inv, counts, len(uniq))
        ctx = uniq >> BITS
        start = np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1]))
        level.append((inv, uniq, c, np.repeat(np.arange(len(start)), np.diff(np.append(start, len(uniq)))), len(start)))
    zero = first.sum(0)
    by_last = {1: (first, first.sum(1), (first > 0).sum(1))}
    for k, (inv, uniq, c, ctx, n_ctx) in enumerate(level):
        total, kinds = np.bincount(ctx, c, n_ctx), np.bincount(ctx, c > 0, n_ctx)
        if k:  # leave out what the next longer context knows: per that context
            up_inv, up_uniq, up_c, up_ctx, up_n = level[k - 1]
            pos = np.searchsorted(uniq, up_uniq & ((1 << (BITS * (4 - k + 1))) - 1))
            known = up_c > 0
            gone = np.bincount(up_ctx, np.where(known, c[pos], 0), up_n)
            gone_kinds = np.bincount(up_ctx, known & (c[pos] > 0), up_n)
            above = up_ctx[up_inv]
            t, q = total[ctx[inv]] - gone[above], kinds[ctx[inv]] - gone_kinds[above]
        else:
            t, q = total[ctx[inv]], kinds[ctx[inv]]
        logp, done = _step(logp, done, c[inv], t, q)
    # One context byte, then none: bounded tables.
    last = (keys >> BITS) & LAST
    table, totals, kinds = by_last[1]
    up_inv, up_uniq, up_c, up_ctx, up_n = level[2]
    known = up_c > 0
    at = table[(up_uniq >> BITS) & LAST, up_uniq & LAST]
    gone, gone_kinds = np.bincount(up_ctx, np.where(known, at, 0), up_n), np.bincount(up_ctx, known & (at > 0), up_n)
    above = up_ctx[up_inv]
    logp, done = _step(logp, done, table[last, symbol], totals[last] - gone[above], kinds[last] - gone_kinds[above])
    gone = (np.where(table > 0, zero[None, :], 0)).sum(1)
    gone_kinds = ((table > 0) & (zero > 0)[None, :]).sum(1)
    logp, done = _step(logp, done, zero[symbol], zero.sum() - gone[last], (zero > 0).sum() - gone_kinds[last])
    return np.where(done, logp, logp - np.log10(max(257 - int((zero > 0).sum()), 1)))


def _step(logp: np.ndarray, done: np.ndarray, c: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: coded here where the symbol is known, else an escape; a context without anything left costs nothing."""
    some = ~done & (total + kinds > 0)
    hit = some & (c > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        add = np.where(hit, np.log10(c / (total + kinds)), np.log10(kinds / (total + kinds)))
    return np.where(some, logp + add, logp), done | hit


def _price(first: np.ndarray):
    """Over 5-grams in order of the context's last two bytes; whole suffixes are priced together."""

    def go(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(code_lengths(keys, counts, first))], ["key", "val"])

        for batch in batches:
            held.append((batch.column("key").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False)))
            if sum(len(k) for k, _ in held) < HELD:
                continue
            keys, counts = (np.concatenate(x) for x in zip(*held))
            suffix = (keys >> BITS) & TWO
            cut = int(np.searchsorted(suffix, suffix[-1]))  # the last suffix may go on
            held = [(keys[cut:], counts[cut:])]
            if cut:
                yield out(keys[:cut], counts[:cut])
        if held and sum(len(k) for k, _ in held):
            yield out(*(np.concatenate(x) for x in zip(*held)))

    return go


class Lookup:
    """Values by key: a table of one slot for each key's hash, and binary search where a slot is another's."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(len(keys) * 4, 2).bit_length())
        self.slots = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.slots[self.slot(self.keys)] = np.arange(len(keys))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots[self.slot(keys)]
        off = np.flatnonzero(self.keys[at] != keys)
        at[off] = np.searchsorted(self.keys, keys[off])
        return self.values[at]


def _totals(batches):
    """Over (block, key, n) in order of key: (block, key, sum of n) of keys that several blocks hold.

    Rows of block -1 have the task's sums: under each kind of key all of n, and under its negative the distinct keys.
    """
    sums = {k: [0, 0] for k in (1, 2, 3)}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def out(blocks: np.ndarray, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size, total = np.diff(np.append(first, len(keys))), np.add.reduceat(n, first)
        for k, x in sums.items():
            own = keys[first] >> 61 == k
            x[0] += int(total[own].sum())
            x[1] += int((total[own] > 0).sum())
        many = np.repeat(size > 1, size)
        return pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (blocks, keys, np.repeat(total, size))], ["block", "key", "n"])

    for batch in batches:
        held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "key", "n")))
        if sum(len(x[1]) for x in held) < HELD:
            continue
        columns = [np.concatenate(x) for x in zip(*held)]
        cut = int(np.searchsorted(columns[1], columns[1][-1]))  # the last key may go on
        held = [tuple(x[cut:] for x in columns)]
        if cut:
            yield out(*(x[:cut] for x in columns))
    if held and sum(len(x[1]) for x in held):
        yield out(*(np.concatenate(x) for x in zip(*held)))
    rows = [(-1, sign * k, x[at]) for k, x in sums.items() for at, sign in ((0, 1), (1, -1))]
    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["block", "key", "n"])


class Counts:
    """Training counts of all keys of a block: its own, replaced by the total where other blocks hold the key too."""

    def __init__(self, parts: list[np.ndarray], train: list[np.ndarray], keys: np.ndarray, totals: np.ndarray):
        every = np.concatenate([np.zeros(0, np.int64), *parts])
        uniq, at = np.unique(every, return_inverse=True)
        counts = np.bincount(at, np.concatenate([np.zeros(0), *train]), len(uniq)).astype(np.int64)
        counts[np.searchsorted(uniq, keys)] = totals
        self.parts = np.split(counts[at], np.cumsum([len(x) for x in parts])[:-1]) if parts else []


def own_counts(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each key stands in its row, and whether it stands there for the first time."""
    order = np.lexsort((keys, rows))
    r, k = rows[order], keys[order]
    first = np.append(True, (r[1:] != r[:-1]) | (k[1:] != k[:-1]))[: len(r)]
    at = np.flatnonzero(first)
    counts, new = np.zeros(len(r), np.int64), np.zeros(len(r), bool)
    counts[order] = np.repeat(np.diff(np.append(at, len(r))), np.diff(np.append(at, len(r))))
    new[order[at]] = True
    return counts, new


def segment_scores(
    rows: np.ndarray, train: np.ndarray, seg: np.ndarray, pair: np.ndarray, counts: np.ndarray, pair_counts: np.ndarray, by_bytes: np.ndarray, total: int, kinds: int
) -> np.ndarray:
    """log10 probability of every segment.

    counts, pair_counts: in training, of each segment and of it after the one before. by_bytes: its score byte by byte.
    total, kinds: segments of training, distinct ones. What a training row brought itself is taken out.
    """
    own, new = own_counts(rows, seg)
    own_pairs, _ = own_counts(rows, pair)
    mine = train[rows]
    c0, c1 = counts - own * mine, pair_counts - own_pairs * mine
    n1 = np.append(0, c0[:-1])[: len(c0)] * (pair != 0)
    size = np.bincount(rows, minlength=len(train))
    alone = np.bincount(rows, new & mine & (c0 == 0), len(train)).astype(np.int64)
    q0, n0 = (kinds - alone * train)[rows], (total - size * train)[rows]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.where(n1 > 0, np.where(c1 > 0, np.log10(np.maximum(c1, 1) / (n1 + 1)), -np.log10(n1 + 1.0)), 0.0)
        zero = np.where(c0 > 0, np.log10(np.maximum(c0, 1) / (n0 + q0)), np.where(n0 > 0, np.log10(q0 / (n0 + q0)), 0.0) + by_bytes)
    return np.where((n1 > 0) & (c1 > 0), out, out + zero)


def _score(sums: dict[int, int], n_docs: int):
    """n_docs: training documents, as each has an end."""

    def go(docs: pa.Table, model: pa.Table) -> pa.Table:
        docs, model = docs.combine_chunks(), model.combine_chunks()
        raw, offsets = bytes_of(docs.column("text"))
        keys, values = (model.column(c).to_numpy().copy() for c in ("key", "val"))
        price = Lookup(keys[keys < PAIR_KEY], values[keys < PAIR_KEY])
        totals = {k: (keys[keys >> 61 == k], values[keys >> 61 == k].astype(np.int64)) for k in (1, 2, 3)}
        train = docs.column("train").to_numpy(zero_copy_only=False).astype(bool)
        bounds = list(passes(offsets))
        pieces = [(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in bounds]
        word = [word_keys(*x) for x in pieces]
        parts = [segments(*x) for x in pieces]
        of = lambda rows, k: train[bounds[k][0] : bounds[k][1]][rows].astype(float)
        words_in = Counts([w for w, _ in word], [of(r, k) for k, (_, r) in enumerate(word)], *totals[2]).parts
        segs_in = Counts([x[2] for x in parts], [of(x[1], k) for k, x in enumerate(parts)], *totals[3]).parts
        pairs_in = Counts([x[3] for x in parts], [of(x[1], k) for k, x in enumerate(parts)], *totals[1]).parts
        n = docs.num_rows
        score, base, tokens, known = np.zeros(n), np.zeros(n), np.ones(n, np.int64), np.zeros(n, np.int64)
        n_words, n_kinds = sums.get(2, 0) + n_docs, sums.get(-2, 0) + (n_docs > 0)
        under = n_words + 0.1 * (n_kinds + 1)
        for k, (i, j) in enumerate(bounds):
            pos, rows, seg, pair = parts[k]
            by_bytes = np.add.reduceat(price(grams(*pieces[k])[0]), pos + rows)  # a row has one more than its bytes
            each = segment_scores(rows, train[i:j], seg, pair, segs_in[k], pairs_in[k] * (pair != 0), by_bytes, sums.get(3, 0), sums.get(-3, 0))
            score[i:j] = np.bincount(rows, each, j - i)
            rows, c = word[k][1], words_in[k]
            tokens[i:j] += np.bincount(rows, minlength=j - i)
            known[i:j] = np.bincount(rows, c > 0, j - i).astype(np.int64) + int(n_docs > 0)
            base[i:j] = np.bincount(rows, np.log10((c + 0.1) / under), j - i) + np.log10((n_docs + 0.1) / under)
        ids = docs.column("doc_id")
        del docs, model, price, raw, pieces
        pa.default_memory_pool().release_unused()
        return pa.table({"doc_id": ids, "held_out": pa.array(~train), "n_tokens": pa.array(tokens), "n_known": pa.array(known), "train_tokens": pa.array(np.full(n, n_words), pa.int64()), "base_score": pa.array(base), "score": pa.array(score)})

    return go


def in_training(doc_id: Column) -> Column:
    """Every id but a tenth: those whose crc32, of the id as text, isn't divisible by 10."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 10 != 0


def ppm_score(df: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """log10 probability of every document under a PPM model of the training documents, and a unigram base line.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. The score is that of the text's bytes
    and its end; segments that a training document brought itself don't count for it. Tokens of the base line are words
    between ASCII white space, A-Z in lower case, and one end each. Words and segments are told apart by 61-bit hashes.
    Null counts as empty: just its end is scored. Without training documents every byte and end has probability 1/257.
    Repeated rows count and are scored each; an empty table gives an empty result; other columns are ignored. Rows
    without doc_id are left out.
    """
    spark = df.sparkSession
    prepare(spark)
    docs = documents(df)
    docs = docs.select("doc_id", "text", in_training(F.col("doc_id")).alias("train"))
    docs = stored(docs.mapInArrow(_deal(block_bytes), "doc_id long, text string, train boolean, block long"), "op9-dealt")
    size = docs.agg(F.count_distinct("block").alias("blocks"), F.count_if("train").alias("train")).first()
    tasks = 2 * size.blocks or 1
    found = stored(docs.mapInArrow(_count, "block long, key long, n long"), "op9-found")
    grams_in = found.where(F.col("key") < PAIR_KEY)
    counts = stored(grams_in.groupBy("key").agg(F.sum("n").alias("n")), "op9-counts")
    first = np.zeros((BEFORE + 1, END + 1))
    short = counts.where("n > 0").groupBy(F.col("key").bitwiseAND(TWO).alias("k")).agg(F.sum("n").alias("n"))
    for k, n in short.collect():  # at most 258 x 257 rows
        first[k >> BITS, k & LAST] = n
    suffix = F.shiftright("key", BITS).bitwiseAND(TWO)
    five = counts.withColumn("suffix", suffix).repartition("suffix").sortWithinPartitions("suffix").select("key", "n")
    priced = grams_in.select("block", "key").join(five.mapInArrow(_price(first), "key long, val double"), "key").select("block", "key", "val")
    priced = stored(priced, "op9-priced")
    totals = found.where(F.col("key") >= PAIR_KEY).repartition("key").sortWithinPartitions("key").mapInArrow(_totals, "block long, key long, n long")
    totals = stored(totals, "op9-totals")
    sums = {r.key: r.n for r in totals.where("block = -1").groupBy("key").agg(F.sum("n").alias("n")).collect()}  # six rows
    release(found, counts)
    own = priced.unionByName(totals.where("block >= 0").selectExpr("block", "key", "double(n) as val")).repartition(tasks, "block")
    return docs.repartition(tasks, "block").groupBy("block").cogroup(own.groupBy("block")).applyInArrow(
        _score(sums, size.train), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
