"""Packing by lexical retrieval.

Documents become token ids; whole windows of a document are sequences by themselves, and what is left of each goes to
a shard, chosen by the id's hash and of bounded size. A shard holds a BM25 inverted index over its rests. A seed opens a
window, the index returns its best neighbours among those not used yet, and these fill the window one after the other;
the last is cut where the window is full, and its remainder seeds the next. The last window of a shard is cut into
powers of two, so that nothing is padded.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import ChainMap
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, MIX1, MIX2, bytes_of, documents, mix, passes, prepare
from .token_counts import merger

#: Ids of a window, bytes of text in a shard, id that ends a document, and the usual BM25 parameters.
WINDOW, SHARD_BYTES, END, K1, B = 4096, 8 << 20, 2, 1.2, 0.75
#: Pre-tokens that a task remembers, and bytes of text that it looks up together.
REMEMBERED, TOGETHER = 900_000, 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Kinds of characters as this tokenizer tells them apart: letters, numbers, white space, and all others.
SPACE, LETTER, NUMBER, OTHER = range(4)
#: What it splits off after an apostrophe, by length.
AFTER_ONE, AFTER_TWO = b"stmd", (b"re", b"ve", b"ll")
APOSTROPHE = ord("'")
#: Bytes of a pre-token that are held as numbers; longer ones are found by a dictionary.
SHORT = 16


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """The kind of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        out[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), np.uint32)] = kind
    return out


def kinds_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kind of the character that each byte belongs to, and whether the byte begins one."""
    kind, lead = kinds()[raw], (raw & 0xC0) != 0x80
    wide = np.flatnonzero(raw >= 0xC0)
    if len(wide):
        at = np.append(raw, np.zeros(3, np.uint8)).astype(np.uint32)
        b, tail = at[wide], [at[wide + k] & 0x3F for k in (1, 2, 3)]
        code = np.where(b < 0xE0, (b & 0x1F) << 6 | tail[0], np.where(b < 0xF0, (b & 0x0F) << 12 | tail[0] << 6 | tail[1], (b & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]))
        kind[wide] = kinds()[code]
        for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
            some = wide[b >= least]
            kind[some + k] = kind[some]
    return kind, lead


def pre_tokens(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pre-tokens: runs of letters, single numbers, runs of other characters, and short endings
    after an apostrophe that stands alone. None crosses a row."""
    kind, lead = kinds_of(low)
    edge = np.empty(len(low) + 1, bool)
    edge[0] = edge[-1] = True
    edge[1:-1] = (kind[1:] != kind[:-1]) | ((kind[1:] == NUMBER) & lead[1:])
    edge[offsets] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    real = kind[starts] != SPACE
    starts, ends = starts[real], ends[real]
    lone = np.flatnonzero((low[starts] == APOSTROPHE) & (ends - starts == 1))
    lone = lone[lone + 1 < len(starts)]
    lone = lone[(starts[lone + 1] == ends[lone]) & (kind[starts[lone + 1]] == LETTER) & ~np.isin(ends[lone], offsets)]
    if len(lone):
        follow = starts[lone + 1]
        one = np.isin(low[follow], np.frombuffer(AFTER_ONE, np.uint8))
        pair = low[follow].astype(np.uint16) << 8 | low[np.minimum(follow + 1, len(low) - 1)]
        two = np.isin(pair, [x[0] << 8 | x[1] for x in AFTER_TWO]) & (ends[lone + 1] - follow >= 2)
        take = np.where(one, 1, np.where(two, 2, 0))
        ends[lone] += take
        starts[lone + 1] += take
        some = starts < ends
        starts, ends = starts[some], ends[some]
    return starts, ends


class Encoder:
    """The ids that the tokenizers library gives, remembered for each pre-token; no token reaches over two.

    A pre-token of up to 16 bytes is known by these bytes as two numbers and by its length, so nothing rests on hashes;
    a table of slots finds it. New pre-tokens in lower case are merged together by the file's own ranks, others by the
    library. Text that normalisation could join or part differently (not in composed form, a dotted capital I, which
    becomes two characters, or what looks like a special token) goes to the library as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids are held in two bytes")
        self.merger = merger(path)
        self.forget()

    def forget(self) -> None:
        self.n, self.long = 0, {}
        self.slots = np.full(1 << 22, -1, np.int32)
        self.first, self.second = np.zeros(1 << 12, np.uint64), np.zeros(1 << 12, np.uint64)
        self.length, self.begin, self.size = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint16), 0

    def ids(self, texts: list[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)] if texts else []

    def add(self, tokens: list[bytes]) -> np.ndarray:
        """Numbers of new pre-tokens, whose ids go to the pool."""
        words = [t.decode() for t in tokens]
        simple = np.array([t.isascii() or (w == w.lower() and "\u03a3" not in w) for t, w in zip(tokens, words)], bool)
        own: list[bytes] = [b""] * len(tokens)
        for part in np.array_split(np.flatnonzero(simple), max(1, int(simple.sum()) // 50_000)):
            if len(part):
                symbols, sizes = self.merger.merge([tokens[k] for k in part.tolist()])
                packed, ends = symbols.astype("<u2").tobytes(), np.cumsum(2 * sizes).tolist()
                for k, x, y in zip(part.tolist(), [0, *ends[:-1]], ends):
                    own[k] = packed[x:y]
        rest = np.flatnonzero(~simple).tolist()
        for k, x in zip(rest, self.ids([words[k] for k in rest])):
            own[k] = x
        made = np.frombuffer(b"".join(own), "<u2")
        sizes = np.array([len(x) // 2 for x in own], np.int64)
        number = self.n + np.arange(len(tokens))
        self.pool = grown(self.pool, self.used + len(made))
        self.pool[self.used : self.used + len(made)] = made
        for name in ("first", "second", "length", "begin", "size"):
            setattr(self, name, grown(getattr(self, name), self.n + len(tokens)))
        self.begin[number], self.size[number] = self.used + np.cumsum(sizes) - sizes, sizes
        self.used += len(made)
        self.n += len(tokens)
        return number

    def numbers(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each pre-token."""
        length = ends - starts
        padded = np.append(low, np.zeros(SHORT, np.uint8))
        eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))  # the eight bytes from each on
        masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
        a = eight[starts] & masks[np.minimum(length, 8)]
        b = eight[np.minimum(starts + 8, len(eight) - 1)] & masks[np.clip(length - 8, 0, 8)]
        slot = mix(a + b * MIX1 + length.astype(np.uint64) * MIX2) >> np.uint64(42)
        out = self.slots[slot].astype(np.int64)
        hit = (out >= 0) & (self.first[out] == a) & (self.second[out] == b) & (self.length[out] == length)
        hit &= length <= SHORT
        miss = np.flatnonzero(~hit)
        if not len(miss):
            return out
        # What a slot doesn't have: new pre-tokens, and those of the dictionary, long or with a slot that is another's.
        data = low.tobytes()
        words = [data[x:y] for x, y in zip(starts[miss].tolist(), ends[miss].tolist())]
        where = {w: k for w, k in zip(words, miss.tolist()) if w not in self.long}
        met = self.long
        if where:
            number, at = self.add(list(where)), np.fromiter(where.values(), np.int64)
            self.first[number], self.second[number], self.length[number] = a[at], b[at], length[at]
            fits = (length[at] <= SHORT) & (self.slots[slot[at]] < 0)
            self.slots[slot[at[fits]]] = number[fits]
            own = self.slots[slot[at]] == number
            met = dict(zip(where, number.tolist()))
            self.long.update((w, n) for (w, n), x in zip(met.items(), own.tolist()) if not x)
            met = ChainMap(met, self.long)
        out[miss] = [met[w] for w in words]
        return out

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each text, the end's id after them."""
        n = len(offsets) - 1
        whole = np.zeros(n, bool)
        row_of = lambda at: np.searchsorted(offsets, at, "right") - 1
        for x, y in ((0x3C, 0x7C), (0xC4, 0xB0)):  # "<|", and the dotted capital I
            whole[row_of(np.flatnonzero((raw[:-1] == x) & (raw[1:] == y)))] = True
        past = np.append(0, np.cumsum(raw >= 0x80))
        wide = past[offsets[1:]] > past[offsets[:-1]]
        texts = {r: raw[offsets[r] : offsets[r + 1]].tobytes().decode() for r in np.flatnonzero(wide | whole).tolist()}
        for r in np.flatnonzero(wide & ~whole).tolist():
            whole[r] = not is_normalized("NFC", texts[r])
        if self.n > REMEMBERED:
            self.forget()
        low = LOWER[raw]
        starts, ends = pre_tokens(low, offsets)
        if whole.any():
            own = ~whole[row_of(starts)]
            starts, ends = starts[own], ends[own]
        number = self.numbers(low, starts, ends) if len(starts) else np.zeros(0, np.int64)
        sizes = self.size[number]
        stop = np.append(0, np.cumsum(sizes))
        flat = self.pool[np.repeat(self.begin[number] - stop[:-1], sizes) + np.arange(stop[-1])]
        cut = stop[np.searchsorted(starts, offsets)]
        end = np.array([END], np.uint16)
        rest = np.flatnonzero(whole).tolist()
        known = dict(zip(rest, self.ids([texts[r] for r in rest])))
        return [np.append(np.frombuffer(known[r], "<u2") if r in known else flat[cut[r] : cut[r + 1]], end) for r in range(n)]


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """x with room for n entries."""
    return x if len(x) >= n else np.append(x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _encode(name: str, window: int):
    def go(batches):
        import public_tokenizers

        encode = encoder(public_tokenizers.path(name))
        for batch in batches:
            raw, offsets = bytes_of(batch.column("text"))
            for i, j in passes(offsets, TOGETHER):
                ids = encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                full = [len(x) // window for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(i, j - i), batch.column("shard").slice(i, j - i), pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([[crc(x[k * window : (k + 1) * window]) for k in range(n)] for x, n in zip(ids, full)], pa.list_(pa.int64())),
                        pa.array([x[n * window :].tobytes() for x, n in zip(ids, full)], pa.binary()),
                    ],
                    ["doc_id", "shard", "doc_tokens", "full", "rest"],
                )

    return go


class Bm25:
    """An inverted index over the rests of one shard."""

    def __init__(self, rests: list[np.ndarray]):
        n = len(rests)
        self.terms, tf = zip(*(np.unique(x, return_counts=True) for x in rests)) if n else ((), ())
        sizes = np.array([len(x) for x in rests], float)
        doc = np.repeat(np.arange(n), [len(t) for t in self.terms])
        term, tf = np.concatenate(self.terms).astype(np.int64), np.concatenate(tf).astype(float)
        order = np.argsort(term, kind="stable")
        term, self.doc, tf = term[order], doc[order], tf[order]
        self.at = np.searchsorted(term, np.arange(int(term[-1]) + 2))
        df = np.diff(self.at)
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[self.doc] / sizes.mean()))
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        """Of every rest, for the terms of one."""
        a, z = self.at[self.terms[seed]], self.at[self.terms[seed].astype(np.int64) + 1]
        size = z - a
        where = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(self.doc[where], self.weight[where], self.n)


def fill(rests: list[np.ndarray], window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (rest, start, length); all but the last few are full."""
    used = np.array([len(x) == 0 for x in rests])
    index = Bm25(rests) if len(rests) else None
    out: list[list[tuple[int, int, int]]] = []
    carried: tuple[int, int] | None = None
    next_seed = 0
    while True:
        if carried is None:
            while next_seed < len(rests) and used[next_seed]:
                next_seed += 1
            if next_seed == len(rests):
                break
            carried = next_seed, 0
            used[next_seed] = True
        seed, start = carried
        carried = None
        take = min(window, len(rests[seed]) - start)
        line, left = [(seed, start, take)], window - take
        if left:
            scores = index.scores(seed)
            scores[used] = -1.0
            some = int(min(len(scores), 64))
            while left:
                best = np.argpartition(-scores, some - 1)[:some] if some < len(scores) else np.arange(len(scores))
                best = best[np.lexsort((best, -scores[best]))]
                best = best[scores[best] >= 0]
                if not len(best):
                    break
                for d in best.tolist():
                    used[d], scores[d] = True, -1.0
                    take = min(left, len(rests[d]))
                    line.append((d, 0, take))
                    left -= take
                    if take < len(rests[d]):
                        carried = d, take
                    if not left:
                        break
        out.append(line)
    if out and (short := sum(n for _, _, n in out[-1])) < window:
        line, size = out.pop(), 1 << (short.bit_length() - 1)
        cut: list[tuple[int, int, int]] = []
        room = size
        for d, s, n in line:
            while n:
                take = min(n, room)
                cut.append((d, s, take))
                s, n, room, short = s + take, n - take, room - take, short - take
                if not room:
                    out.append(cut)
                    cut, room = [], 1 << (short.bit_length() - 1) if short else 0
    return out


def _pack(window: int):
    def go(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        ids, tokens = table.column("doc_id").to_pylist(), table.column("doc_tokens").to_pylist()
        rests = [np.frombuffer(x, "<u2") for x in table.column("rest").to_pylist()]
        first = table.column("shard")[0].as_py() << 32
        rows: list[tuple[int, ...]] = []
        n = 0
        for d, (doc, whole) in enumerate(zip(ids, table.column("full").to_pylist())):
            for k, c in enumerate(whole):
                rows.append((doc, k * window, window, c, tokens[d], first + n, 0))
                n += 1
        for line in fill(rests, window):
            offset = 0
            for d, s, size in line:
                rows.append((ids[d], tokens[d] - len(rests[d]) + s, size, crc(rests[d][s : s + size]), tokens[d], first + n, offset))
                offset += size
            n += 1
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(names, zip(*rows))})

    return go


def pack(df: DataFrame, tokenizer: str = "word_bpe_49k.json", window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Every document's ids, cut into the pieces of sequences of at most `window` ids; window is a power of two.

    Returns doc_id, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers), doc_tokens,
    sequence_id, offset. Each sequence is as long as a power of two, most as the window, so none is padded. Null and
    empty texts are the end's id alone; repeated rows are packed each; an empty table gives an empty result; other
    columns are ignored. Rows without doc_id are left out.
    """
    prepare(df.sparkSession)
    docs = documents(df)
    size = docs.agg(F.sum(F.octet_length("text")).alias("s"), F.count("*").alias("n")).first()
    shards = int(-(-((size.s or 0) + 16 * size.n) // shard_bytes)) or 1
    placed = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)))  # rows that repeat an id part by text
    ids = placed.mapInArrow(_encode(tokenizer, window), "doc_id long, shard long, doc_tokens long, full array<long>, rest binary")
    return ids.groupBy("shard").applyInArrow(_pack(window), PIECES)
