"""Token counts by rank-synchronous array merging of byte-level BPE.

Pre-tokens that a task hasn't met yet are held together as one ragged array of symbols. Every round applies to each
sequence its own lowest-rank pair, wherever it stands, to all sequences at once; a sequence without a mergeable pair
leaves with the count of its symbols. Long sequences share rounds of one rank each, which touch only what changes.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bytes_of, documents, prepare

#: Fixed value: how byte-level BPE of this vocabulary splits text into pre-tokens.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pre-tokens whose counts a task remembers, and bytes of new ones that it merges together.
REMEMBERED, TOGETHER = 500_000, 1 << 20
#: Bytes past which a pre-token takes its ranks one by one, as rounds over all its symbols would cost their square.
LONG = 96


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it is printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class RankMerger:
    """The merges of one tokenizer file as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.first = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.last = np.array([vocab[c + suffix] for c in byte_letters()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        # A table of slots finds most pairs; those whose slot went to another are few and searched for.
        self.slots = np.zeros(1 << 20, np.int32)
        slot = self.slot(self.keys)
        self.slots[slot] = np.arange(len(keys))
        self.crowded = np.flatnonzero(self.slots[slot] != np.arange(len(keys)))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[str, int] = {}

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).view(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs can merge, and where they stand among the merges."""
        at = self.slots[self.slot(keys)].astype(np.int64)
        found = self.keys[at] == keys
        if len(self.crowded):
            other = np.flatnonzero(~found)
            rare = self.keys[self.crowded]
            pos = np.minimum(np.searchsorted(rare, keys[other]), len(rare) - 1)
            hit = rare[pos] == keys[other]
            at[other[hit]] = self.crowded[pos[hit]]
            found[other[hit]] = True
        return found, at

    def merge(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are left of non-empty pre-tokens, one after the other, and how many of each."""
        sizes = np.array([len(t) for t in tokens], np.int64)
        parts = [f(np.flatnonzero(own), [tokens[k] for k in np.flatnonzero(own).tolist()]) for f, own in ((self._together, sizes <= LONG), (self._by_rank, sizes > LONG)) if own.any()]
        if not parts:
            return np.zeros(0, np.int64), sizes
        seq, symbols = (np.concatenate(x) for x in zip(*parts))
        return symbols[np.argsort(seq, kind="stable")], np.bincount(seq, minlength=len(tokens))

    def _letters(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first symbols of pre-tokens as one ragged array, where each ends, and which each symbol is of."""
        sizes = np.array([len(t) for t in tokens], np.int64)
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        symbols, ends = self.first[raw], np.cumsum(sizes) - 1
        symbols[ends] = self.last[raw[ends]]
        return symbols, ends, np.repeat(np.arange(len(tokens)), sizes)

    def _together(self, names: np.ndarray, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Rounds in which every sequence applies its own lowest rank; each looks at all symbols that are left."""
        symbols, _, seq = self._letters(tokens)
        none, over = len(self.keys), []
        while len(symbols):
            together = seq[1:] == seq[:-1]
            found, at = self.find((symbols[:-1] << 32) | symbols[1:])
            rank = np.append(np.where(found & together, self.rank[at], none), none)
            starts = np.flatnonzero(np.append(True, ~together))
            size = np.diff(np.append(starts, len(symbols)))
            least = np.minimum.reduceat(rank, starts)
            done = np.repeat(least == none, size)
            over.append((seq[done], symbols[done]))
            hit = (rank == np.repeat(least, size)) & (rank < none)
            # Pairs of one letter can overlap: of a chain, every other one counts, from the left.
            chained = np.append(False, hit[:-1]) & hit
            if chained.any():
                begin = np.flatnonzero(hit & ~chained)
                hits = np.flatnonzero(hit)
                odd = (hits - begin[np.searchsorted(begin, hits, "right") - 1]) % 2 == 1
                hit[hits[odd]] = False
            where = np.flatnonzero(hit)
            symbols[where] = self.made[at[where]]
            stay = ~done
            stay[1:] &= ~hit[:-1]
            symbols, seq = symbols[stay], seq[stay]
        seq, symbols = (np.concatenate(x) for x in zip(*over))
        return names[seq], symbols

    def _by_rank(self, names: np.ndarray, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """One round for each rank, from the lowest, over the places of that rank in all sequences.

        A round touches what it merges and the neighbours of that alone, so n symbols cost n log n whatever their
        sequences' lengths. Places wait under their rank; one whose pair has changed since is passed over.
        """
        symbols, ends, seq = self._letters(tokens)
        n, none = len(symbols), len(self.keys)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        after[ends] = n
        before[np.append(0, ends[:-1] + 1)] = -1
        rank, waiting, heap = np.full(n, none), {}, []
        made = np.zeros(none, np.int64)
        made[self.rank] = self.made

        def enter(places: np.ndarray) -> None:
            places = places[after[places] < n]
            found, at = self.find((symbols[places] << 32) | symbols[after[places]])
            places, own = places[found], self.rank[at[found]]
            rank[places] = own
            order = np.argsort(own, kind="stable")
            places, own = places[order], own[order]
            cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
            for k, some in zip(own[np.append(0, cuts)].tolist() if len(own) else (), np.split(places, cuts)):
                if k not in waiting:
                    waiting[k] = []
                    heapq.heappush(heap, k)
                waiting[k].append(some)

        enter(np.arange(n))
        while heap:
            now = heapq.heappop(heap)
            some = waiting.pop(now)
            first = np.unique(np.concatenate(some)) if len(some) > 1 else np.sort(some[0])
            first = first[alive[first] & (rank[first] == now)]
            if not len(first):
                continue
            second = after[first]
            chained = np.append(False, second[:-1] == first[1:])
            if chained.any():
                begin = np.flatnonzero(~chained)
                place = np.arange(len(first))
                keep = (place - begin[np.searchsorted(begin, place, "right") - 1]) % 2 == 0
                first, second = first[keep], second[keep]
            symbols[first] = made[now]
            alive[second] = False
            rank[first] = rank[second] = none
            third = after[second]
            after[first] = third
            before[third[third < n]] = first[third < n]
            left = before[first]
            left = left[left >= 0]
            rank[left] = none
            enter(np.unique(np.concatenate([left, first])))
        return names[seq[alive]], symbols[alive]

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        return self.merge(tokens)[1]

    def learn(self, tokens: set[str]) -> None:
        batch, size = [], 0
        todo = list(tokens)
        for k, t in enumerate(todo):
            batch.append(t)
            size += len(t)
            if size > TOGETHER or k == len(todo) - 1:
                self.known.update(zip(batch, self.counts([x.encode() for x in batch]).tolist()))
                batch, size = [], 0

    def count_texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text as the tokenizer gives them, the strings of special tokens counted as one token each."""
        split, out, held, size = SPLIT.findall, [], [], 0

        def flush() -> None:
            nonlocal held, size
            new = set().union(*(x for x, _ in held)) - self.known.keys() if held else set()
            if new:
                if len(self.known) + len(new) > REMEMBERED:
                    self.known.clear()
                    new = set().union(*(x for x, _ in held))
                self.learn(new)
            get = self.known.__getitem__
            out.extend(sum(map(get, words)) + more for words, more in held)
            held, size = [], 0

        for t in texts:
            more = 0
            if self.special_at is not None and any(s in t for s in self.special):
                parts = self.special_at.split(t)
                more = len(parts) - 1
                words = [w for p in parts for w in split(p)]
            else:
                words = split(t)
            held.append((words, more))
            size += len(t)
            if size > TOGETHER:
                flush()
        flush()
        return out


@lru_cache(maxsize=2)
def merger(path: str) -> RankMerger:
    return RankMerger(path)


def _count(name: str, limit: int):
    def go(batches):
        import public_tokenizers

        rank_merger = merger(public_tokenizers.path(name))
        for batch in batches:
            texts = batch.column("text")
            n = np.array(rank_merger.count_texts(texts.to_pylist()), np.int64)
            sizes = pa.array(np.diff(bytes_of(texts)[1]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return go


def token_counts(df: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every document; nothing is shuffled.

    tokenizer: a byte-level BPE file of public_tokenizers. Null and empty texts have 0 tokens; repeated rows count
    each; a text without white space is one long sequence, whose time grows with n log n. An empty table gives an empty
    result; other columns are ignored. Rows without doc_id are left out.
    """
    prepare(df.sparkSession)
    return documents(df).mapInArrow(_count(tokenizer, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
