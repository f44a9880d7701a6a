"""Suffix-array dedup: bytes covered by a long string that starts anywhere else too.

Which strings of `length` bytes repeat is decided in three steps. (1) Every such string picks one anchor inside
it: its k-gram of least hash (the leftmost of equals). Consecutive strings with the same anchor form a run, and
equal strings have equal anchors at equal distances, so only runs with equal anchors can hold equal strings. Counts
by anchor need some 40 bytes for every 170 bytes of text. (2) If all runs of a repeated anchor are the same bytes, by
their 128-bit cryptographic digests, all their strings repeat. (3) The rest meet in one group by anchor, each distinct
run once. There the suffixes from the anchor on, and the reversed prefixes before it, are put in order by deep-shallow
sorting: multikey quicksort to a shallow depth, then blind tries for what still shares a long prefix. Common prefixes
of neighbours in both orders tell how far each pair agrees to either side, and so which strings repeat. A group with
more than `block` distinct runs would be one large task, so its strings are counted by their own digests instead, in
sums that Spark forms before it shuffles; the result is the same.

The same steps, over words in place of bytes, find passages of `passage` words that another document holds too. Both
kinds travel together; the lowest bit of an anchor tells them apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, MIX1, MIX2, NOT_SPACE, bytes_of, documents, hashes, merged, mix, passes, prepare, release, sliding_min, stored, words

LENGTH, GRAM, BLOCK, SHALLOW = 400, 64, 8192, 32
#: Words of a passage, words of its anchors, and bytes that stand for a word.
PASSAGE, WORD_GRAM, CODE = 50, 8, 8
RUNS = "anchor long, c1 long, c2 long, doc_id long, th long, p int, n int, off int, cnt int, more array<int>"
SLICES = "anchor long, c1 long, c2 long, doc_id long, off int, cnt int, bytes binary"


# ---- deep-shallow sorting -------------------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, which is known to be at least `at`."""
    most = min(len(a), len(b))
    if a[at:most] == b[at:most]:
        return most
    lo, hi = at, most  # a[:lo] agrees, a[:hi] doesn't
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class BlindTrie:
    """A trie over distinct strings that keeps branching bytes only; what lies between is compared once, at a leaf.

    A node is (depth, {byte: child}), a leaf the number of its string; -1 stands for a string's end.
    """

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: int | tuple | None = None

    def insert(self, i: int) -> None:
        s, node, path = self.strings[i], self.root, []
        if node is None:
            self.root = i
            return
        while not isinstance(node, int):  # blind: only the branching bytes are looked at
            path.append(node)
            depth, kids = node
            c = s[depth] if depth < len(s) else -1
            node = kids[c] if c in kids else next(iter(kids.values()))
        other = self.strings[node]
        lcp = common_prefix(s, other)
        c = s[lcp] if lcp < len(s) else -1
        above = [x for x in path if x[0] < lcp]
        below = path[len(above)] if len(above) < len(path) else node
        if not isinstance(below, int) and below[0] == lcp:
            below[1][c] = i
            return
        made = (lcp, {other[lcp] if lcp < len(other) else -1: below, c: i})
        if above:
            depth, kids = above[-1]
            kids[s[depth] if depth < len(s) else -1] = made
        else:
            self.root = made

    def walk(self) -> Iterator[tuple[int, int]]:
        """(string, common prefix with the one before) in order; the first has 0."""
        stack, first = [(self.root, 0)], True
        while stack:
            node, lcp = stack.pop()
            if isinstance(node, int):
                yield node, 0 if first else lcp
                first = False
            else:
                depth, kids = node
                keys = sorted(kids)
                for k in reversed(keys):
                    stack.append((kids[k], lcp if k == keys[0] else depth))


def deep_shallow_sort(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Order of distinct strings, and the common prefix of each with the one before it.

    Multikey quicksort splits by one byte at a time down to `shallow`; a group that still agrees there goes to a
    blind trie.
    """
    order: list[int] = []
    lcps: list[int] = []
    todo = [(list(range(len(strings))), 0, 0)]
    while todo:
        group, depth, before = todo.pop()
        if not group:
            continue
        if len(group) == 1:
            order.append(group[0])
            lcps.append(before)
            continue
        if depth >= shallow:
            trie = BlindTrie(strings)
            for i in group:
                trie.insert(i)
            for k, (i, lcp) in enumerate(trie.walk()):
                order.append(i)
                lcps.append(lcp if k else before)
            continue
        pivot = strings[group[len(group) // 2]]
        pivot = pivot[depth] if depth < len(pivot) else -1
        less, same, more = [], [], []
        for i in group:
            c = strings[i][depth] if depth < len(strings[i]) else -1
            (less if c < pivot else more if c > pivot else same).append(i)
        parts = [(less, depth, depth), (same, depth + (pivot >= 0), depth), (more, depth, depth)]
        if pivot < 0:  # equal strings that end here
            parts[1] = (same[:1], depth, depth)
        parts = [x for x in parts if x[0]]
        parts[0] = (parts[0][0], parts[0][1], before)
        todo.extend(reversed(parts))
    if lcps:
        lcps[0] = 0
    return order, lcps


def _towards(lcps: np.ndarray, at: int) -> np.ndarray:
    """Common prefix of the string at this rank with every other rank."""
    n = len(lcps)
    out = np.empty(n, np.int64)
    out[at] = 1 << 30
    out[at + 1 :] = np.minimum.accumulate(lcps[at + 1 :]) if at + 1 < n else 0
    if at:
        out[:at] = np.minimum.accumulate(lcps[at:0:-1])[::-1]
    return out


def repeated_strings(
    texts: list[bytes], offs: np.ndarray, counts: np.ndarray, length: int, unit: int = 1, owners: np.ndarray | None = None
) -> list[tuple[int, int, int]]:
    """(run, first, last): strings of the runs, numbered by start, that occur in another run or in a copy of their own.

    texts: distinct runs with one anchor, at offs in each. offs, length and results are in symbols of `unit` bytes. With
    owners, two runs that have one owner each, and the same, don't count for each other.
    """
    n = len(texts)
    sizes = np.array([len(t) for t in texts]) // unit
    spans = [(i, 0, int(sizes[i]) - length) for i in range(n) if counts[i] > 1]
    if n < 2:
        return spans
    rights = [t[o * unit :] for t, o in zip(texts, offs)]
    lefts = [t[: o * unit][::-1] for t, o in zip(texts, offs)]

    def ranked(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        where: dict[bytes, int] = {}
        kinds = np.array([where.setdefault(s, len(where)) for s in strings])
        order, lcps = deep_shallow_sort(list(where))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return rank[kinds], np.array(lcps, np.int64) // unit, np.array([len(s) for s in where], np.int64)[kinds] // unit

    right_rank, right_lcp, right_len = ranked(rights)
    left_rank, left_lcp, left_len = ranked(lefts)
    for i in range(n):
        if counts[i] > 1:
            continue
        r = np.minimum(_towards(right_lcp, right_rank[i])[right_rank], right_len[i])
        l = np.minimum(_towards(left_lcp, left_rank[i])[left_rank], left_len[i])
        ok = r + l >= length
        ok[i] = False
        if owners is not None:
            ok &= (owners != owners[i]) | (counts > 1)
        if ok.any():
            first, after = merged(offs[i] - l[ok], offs[i] + r[ok] - length + 1)
            spans += [(i, int(x), int(y) - 1) for x, y in zip(first.tolist(), after.tolist())]
    return spans


# ---- runs ---------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def _odd_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    odd = int(MIX1)
    out = []
    for x in (odd, pow(odd, -1, 1 << 64)):
        p = np.full(n, np.uint64(x))
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def gram_hashes(units: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every `gram` symbols. It only chooses anchors: where hashes collide, groups grow but results stay."""
    n = len(units) - gram + 1
    size = 1 << max(int(len(units)).bit_length(), 16)
    p, inverse = _odd_powers(size) if size <= 1 << 24 else _odd_powers.__wrapped__(size)
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum((units.astype(np.uint64) + np.uint64(1)) * p[: len(units)], out=sums[1:])
    return mix((sums[gram:] - sums[:-gram]) * inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def runs_of(units: np.ndarray, offsets: np.ndarray, length: int, gram: int, kind: int = 0) -> dict[str, np.ndarray]:
    """Runs of strings that share their anchor: row, anchor and digest, first string, how many, anchor's distance."""
    w = length - gram + 1
    if len(units) < length:
        return {}
    h = gram_hashes(units, gram)
    at_bits = np.uint64((1 << 32) - 1)
    anchor = (sliding_min((h & ~at_bits) | np.arange(len(h), dtype=np.uint64), w) & at_bits).astype(np.int64)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + length <= offsets[1:][rows])
    if not len(start):
        return {}
    a = anchor[start]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (rows[start[1:]] != rows[start[:-1]])
    at = np.flatnonzero(first)
    p, n, a = start[at], np.diff(np.append(at, len(start))), a[at]
    data, size, row = memoryview(np.ascontiguousarray(units).view(np.uint8)), units.itemsize, rows[p]
    digest = np.frombuffer(digests(data, p * size, (p + n - 1 + length) * size), np.int64).reshape(-1, 2)
    return {
        "row": row, "anchor": ((h[a] & ~np.uint64(1)) | np.uint64(kind)).view(np.int64), "c1": digest[:, 0],
        "c2": digest[:, 1] ^ ((a - p).astype(np.uint64) * MIX2).view(np.int64), "p": p - offsets[row], "n": n, "off": a - p,
    }


def digests(data: memoryview, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """128-bit digests of byte ranges, one after the other."""
    made = hashlib.blake2b
    return b"".join([made(data[x:y], digest_size=16).digest() for x, y in zip(starts.tolist(), ends.tolist())])


def coded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One number for each word, A-Z in lower case, and the offsets of the rows among them."""
    low = LOWER[raw]
    starts, ends, rows = words(low, offsets, NOT_SPACE)
    return hashes(low, starts, ends), np.searchsorted(rows, np.arange(len(offsets)))


def _runs(length: int, gram: int, passage: int):
    def table(r: dict[str, np.ndarray], ids: np.ndarray, th: np.ndarray, kind: int) -> Iterator[pa.RecordBatch]:
        if not r:
            return
        n = len(r["p"])
        order = np.lexsort((r["p"], r["c2"], r["c1"], r["anchor"], r["row"]))
        row, an, c1, c2 = (r[k][order] for k in ("row", "anchor", "c1", "c2"))
        new = np.ones(n, bool)
        new[1:] = (row[1:] != row[:-1]) | (an[1:] != an[:-1]) | (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])
        size = np.diff(np.append(np.flatnonzero(new), n))
        keep = order[new]
        cols = {k: r[k][keep] for k in ("row", "anchor", "c1", "c2", "p", "n", "off")} | {"cnt": np.minimum(size, 2) if kind == 0 else np.ones(len(keep), np.int64)}
        valid, more = np.ones(len(keep), bool), pa.nulls(len(keep), pa.list_(pa.int32()))
        often = np.repeat(size > 1, size)
        if often.any() and kind == 0:  # a run that comes twice in its row repeats for sure: one counts, all are intervals
            o = order[often]
            shift = r["row"][o] << 32
            s, e = merged(r["p"][o] + shift, r["p"][o] + shift + r["n"][o] - 1 + length)
            extra = {"p": s & 0xFFFFFFFF, "n": e - s, "row": s >> 32}
            cols = {c: np.concatenate([v, extra.get(c, np.zeros(len(s), np.int64))]) for c, v in cols.items()}
            valid = np.concatenate([valid, np.zeros(len(s), bool)])
            more = pa.nulls(len(valid), pa.list_(pa.int32()))
        elif often.any():  # of words only other documents' runs matter: one counts and brings the places of all
            rest = pa.array(r["p"][order[~new]].astype(np.int32))
            more = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size - 1)).astype(np.int32)), rest)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols["anchor"], mask=~valid), *(pa.array(x) for x in (cols["c1"], cols["c2"], ids[cols["row"]], th[cols["row"]]))] + [pa.array(cols[c].astype(np.int32)) for c in ("p", "n", "off", "cnt")] + [more],
            ["anchor", "c1", "c2", "doc_id", "th", "p", "n", "off", "cnt", "more"],
        )

    def go(batches):
        for batch in batches:
            raw, offsets = bytes_of(batch.column("text"))
            ids, th = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "th"))
            for i, j in passes(offsets):
                part, off = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                yield from table(runs_of(part, off, length, gram), ids[i:j], th[i:j], 0)
                if passage:
                    yield from table(runs_of(*coded(part, off), passage, min(WORD_GRAM, passage), 1), ids[i:j], th[i:j], 1)

    return go


def _slices(length: int, passage: int):
    """Cut the runs that a group needs out of the text of their document."""

    def go(batches):
        for batch in batches:
            raw, offsets = bytes_of(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for k, rows in enumerate(batch.column("runs").to_pylist()):
                own = raw[offsets[k] : offsets[k + 1]]
                whole = own.tobytes(), coded(own, np.array([0, len(own)]))[0].tobytes() if any(r["anchor"] & 1 for r in rows) else b""
                cut = []
                for r in rows:
                    kind = r["anchor"] & 1
                    unit, most = (CODE, passage) if kind else (1, length)
                    cut.append(whole[kind][r["p"] * unit : (r["p"] + r["n"] - 1 + most) * unit])
                col = lambda c, t: pa.array([r[c] for r in rows], t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [col("anchor", pa.int64()), col("c1", pa.int64()), col("c2", pa.int64()), pa.array([ids[k]] * len(rows), pa.int64()), col("off", pa.int32()), col("cnt", pa.int32()), pa.array(cut, pa.binary())],
                    ["anchor", "c1", "c2", "doc_id", "off", "cnt", "bytes"],
                )

    return go


def _order_groups(length: int, passage: int):
    """Over rows in order of their anchor: one group at a time is held, of `block` distinct runs at most."""

    def go(batches):
        held: list[tuple] = []
        out: list[list[int]] = [[], [], [], [], []]

        def close() -> None:
            kind = held[0][0] & 1
            offs, counts, owners = (np.array([x[k] for x in held]) for k in (4, 5, 3))
            found = repeated_strings([x[6] for x in held], offs, counts, passage if kind else length, CODE if kind else 1, owners if kind else None)
            for i, a, b in found:
                for column, v in zip(out, (*held[i][:3], a, b)):
                    column.append(v)
            held.clear()

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["anchor", "c1", "c2", "a", "b"])
            for column in out:
                column.clear()
            return made

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "c1", "c2", "doc_id", "off", "cnt", "bytes"))):
                if held and held[0][0] != row[0]:
                    close()
                held.append(row)
            yield batch_of()
        if held:
            close()
        yield batch_of()

    return go


def _strings(length: int, passage: int):
    """For groups past the block size: one row for each string of a run, by its own digest."""

    def go(batches):
        for batch in batches:
            anchors = batch.column("anchor").to_numpy(zero_copy_only=False)
            raw, offsets = bytes_of(batch.column("bytes"))
            for i, j in passes(offsets, 1 << 17):
                unit, most = np.where(anchors[i:j] & 1, CODE, 1), np.where(anchors[i:j] & 1, passage, length)
                size = np.diff(offsets[i : j + 1])
                n = size // unit - most + 1
                row = np.repeat(np.arange(j - i), n)
                at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                begin = offsets[i:j][row] + at * unit[row]
                d = np.frombuffer(digests(memoryview(raw), begin, begin + (most * unit)[row]), np.int64).reshape(-1, 2)
                take = lambda c: batch.column(c).to_numpy(zero_copy_only=False)[i:j][row]  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(take(c)) for c in ("anchor", "c1", "c2", "doc_id")] + [pa.array(at.astype(np.int32)), pa.array((take("off") - at).astype(np.int32)), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(take("cnt"))],
                    ["anchor", "c1", "c2", "doc_id", "at", "dist", "h1", "h2", "cnt"],
                )

    return go


def _finish(keep_text: bool):
    def go(batches):
        for batch in batches:
            raw, offsets = bytes_of(batch.column("text"))
            spans = batch.column("spans")
            counts = pc.fill_null(pc.list_value_length(spans), 0).to_numpy()
            kinds, starts, ends = (spans.flatten().field(k).to_numpy(zero_copy_only=False) for k in range(3))
            stop = np.cumsum(counts)
            lens, removed, shared, shas, texts, all_s, all_e, n_spans = np.diff(offsets), [], [], [], [], [], [], []
            for k in range(len(counts)):
                text = raw[offsets[k] : offsets[k + 1]].tobytes()
                own = slice(stop[k] - counts[k], stop[k])
                kind, s, e = kinds[own], starts[own].astype(np.int64), ends[own].astype(np.int64)
                ws, we = merged(s[kind == 1], e[kind == 1])
                s, e = merged(s[kind == 0], e[kind == 0])
                shared.append(int((we - ws).sum()))
                removed.append(int((e - s).sum()))
                n_spans.append(len(s))
                all_s.append(s)
                all_e.append(e)
                if len(s):
                    text = b"".join(text[x:y] for x, y in zip([0, *e.tolist()], [*s.tolist(), len(text)]))
                shas.append(hashlib.sha256(text).hexdigest())
                texts.append(text.decode("utf-8", "ignore") if keep_text else None)
            ints = [pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int32)) for x in (all_s, all_e)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n_spans]).astype(np.int32)), pa.StructArray.from_arrays(ints, ["s", "e"]))
            longs = [pa.array(np.asarray(x, np.int64)) for x in (lens, removed, n_spans)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *longs, pa.array(shas, pa.string()), pa.array(np.asarray(shared, np.int64)), lists, pa.array(texts, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared_words", "spans", "kept_text"],
            )

    return go


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared_words long, spans array<struct<s:int,e:int>>, kept_text string"


def suffix_dedup(df: DataFrame, length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, keep_text: bool = True, passage: int = PASSAGE) -> DataFrame:
    """Remove every byte covered by a `length`-byte string that also starts anywhere else, in any document.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared_words (words, between ASCII white space and with
    A-Z in lower case, that lie in `passage` words in a row which another document holds too; 0 with passage=0), spans
    (array of s, e in bytes), kept_text (a character of which only a part goes is dropped from the text, not from the
    digest; null without keep_text). Null and empty texts and texts shorter than `length` lose nothing. Rows may repeat
    a doc_id, with the same text or another: each row gives a row and all lose their repeats, as strings are judged on
    the input; for n_shared_words rows of one doc_id are one document. An empty table gives an empty result; other
    columns are ignored. Rows without doc_id are left out.
    """
    spark = df.sparkSession
    prepare(spark)
    docs = documents(df).withColumn("th", F.xxhash64("text"))
    runs = stored(docs.mapInArrow(_runs(length, gram, passage), RUNS), "op1-runs")
    size = f"if(anchor & 1 = 1, {passage}, {length})"
    kind = "cast(anchor & 1 as int) as kind"
    plain = runs.where("anchor is null").selectExpr("doc_id", "th", "0 as kind", "p as s", "p + n as e")
    often = (
        runs.where("anchor is not null")
        .groupBy("anchor")
        .agg(F.sum("cnt").alias("c"), *(f(x).alias(f"{x}_{f.__name__}") for x in ("c1", "c2") for f in (F.min, F.max)))
        .where("c > 1")
        .selectExpr("anchor as key", "c1_min = c1_max and c2_min = c2_max as same")
    )
    hits = stored(runs.where("anchor is not null").join(often, F.col("anchor") == F.col("key")).drop("key"), "op1-hits")
    plain = stored(plain, "op1-plain")
    release(runs)
    places = "explode(if(more is null, array(p), concat(array(p), more))) as at"
    whole = hits.where("same").selectExpr("*", places).selectExpr("doc_id", "th", kind, "at as s", f"at + n - 1 + {size} as e")
    mixed = hits.where("not same")
    # One text for each distinct run; copies are counted before anything is shuffled.
    one = mixed.groupBy("anchor", "c1", "c2").agg(F.sum("cnt").cast("int").alias("cnt"), F.min_by(F.struct("doc_id", "th", "p", "n", "off"), F.struct("doc_id", "th", "p")).alias("r"))
    wanted = one.select("r.doc_id", "r.th", F.struct("anchor", "c1", "c2", "r.p", "r.n", "r.off", "cnt").alias("run"))
    wanted = wanted.groupBy("doc_id", "th").agg(F.collect_list("run").alias("runs"))  # at most the runs of one document
    cut = docs.join(wanted, ["doc_id", "th"]).mapInArrow(_slices(length, passage), SLICES)
    large = one.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > block).selectExpr("anchor as big")
    cut = stored(cut.join(large, F.col("anchor") == F.col("big"), "left"), "op1-cut")
    groups = cut.where("big is null").drop("big").repartition("anchor").sortWithinPartitions("anchor")
    ordered = groups.mapInArrow(_order_groups(length, passage), "anchor long, c1 long, c2 long, a int, b int")
    singles = cut.where("big is not null").drop("big").mapInArrow(_strings(length, passage), "anchor long, c1 long, c2 long, doc_id long, at int, dist int, h1 long, h2 long, cnt int")
    same = ["anchor", "dist", "h1", "h2"]
    shared = singles.groupBy(same).agg(F.sum("cnt").alias("c"), F.max("cnt").alias("most"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    shared = shared.where("c > 1 and (anchor & 1 = 0 or most > 1 or lo < hi)").select(same)
    counted = singles.join(shared, same).selectExpr("anchor", "c1", "c2", "at as a", "at as b")
    parts = ordered.unionByName(counted)
    some = mixed.selectExpr("*", places).join(parts, ["anchor", "c1", "c2"]).selectExpr("doc_id", "th", kind, "at + a as s", f"at + b + {size} as e")
    spans = plain.unionByName(whole).unionByName(some).groupBy("doc_id", "th").agg(F.collect_set(F.struct("kind", "s", "e")).alias("spans"))
    done = docs.join(spans, ["doc_id", "th"], "left")
    return done.mapInArrow(_finish(keep_text), RESULT)
