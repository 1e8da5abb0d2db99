"""Token ids of whole corpora under a byte-level pair vocabulary.

A text is cut into words by the vocabulary's pattern; each different word of a batch
is encoded once. A word is a row of parts, held with all other words in one
contiguous array, beside the ranks of all adjacent pairs. In each pass the pair of the
lowest rank of every word (the leftmost, on ties) is found by a scan, the boundary
inside it deleted, and the ranks of its two neighbours looked up again; words without a pair that merges
leave the array. Words above LONG bytes, for which repeated scans would be quadratic,
go through a heap of (rank, position) over a linked list, with the same result.
"""

from __future__ import annotations

import heapq
import os
from base64 import b64decode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS_DIR = os.environ.get("STORYLOOM_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = "byte_bpe_50k.tiktoken"
#: The pattern that cuts text into words (fixed value of the public vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG = 400
#: Bytes of text encoded at a time, to bound a worker's memory.
SLICE_BYTES = 1 << 20
NO_PAIR = np.int32(2**31 - 1)


class Vocabulary:
    """Ids of the single bytes, and the id two adjacent tokens merge to, as sorted arrays."""

    def __init__(self, byte_ids: np.ndarray, pairs: np.ndarray, merged: np.ndarray) -> None:
        self.byte_ids, self.pairs, self.merged = byte_ids, pairs, merged
        self._words = self._table = self._dict = None

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            ranks = {b64decode(a): int(b) for a, b in map(bytes.split, f)}
        byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    merged.append(rank)
        order = np.argsort(np.array(pairs, np.int64))
        return cls(byte_ids, np.array(pairs, np.int64)[order], np.array(merged, np.int32)[order])

    def bytes_of(self) -> dict[int, bytes]:
        """The bytes every id stands for, put together from the merges."""
        out = {int(t): bytes([i]) for i, t in enumerate(self.byte_ids)}
        for m in np.argsort(self.merged, kind="stable"):
            a, b = int(self.pairs[m]) >> 32, int(self.pairs[m]) & 0xFFFFFFFF
            if a in out and b in out:
                out.setdefault(int(self.merged[m]), out[a] + out[b])
        return out

    def __getstate__(self):
        return self.byte_ids, self.pairs, self.merged

    def __setstate__(self, state):
        self.__init__(*state)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What each pair merges to, which is also its rank; NO_PAIR if it doesn't."""
        if self._table is None:  # open addressing over a power of two, four slots a pair
            self._bits = max(8, (4 * len(self.pairs)).bit_length())
            self._table = np.full(1 << self._bits, -1, np.int64)
            self._to = np.full(1 << self._bits, NO_PAIR, np.int32)
            todo, step = np.arange(len(self.pairs)), 0
            while len(todo):
                slot = self._slot(self.pairs[todo], step)
                free = self._table[slot] < 0
                self._table[slot[free]] = self.pairs[todo[free]]  # of several for one slot the last stays
                done = self._table[slot] == self.pairs[todo]
                self._to[slot[done]] = self.merged[todo[done]]
                todo, step = todo[~done], step + 1
            self._steps = step
        wanted = (left.astype(np.int64) << 32) | right
        slot = self._slot(wanted, 0)
        found = np.where(self._table[slot] == wanted, self._to[slot], NO_PAIR)
        left_over = np.flatnonzero((found == NO_PAIR) & (self._table[slot] >= 0))
        for step in range(1, self._steps):
            if not len(left_over):
                break
            slot = self._slot(wanted[left_over], step)
            same = self._table[slot] == wanted[left_over]
            found[left_over[same]] = self._to[slot[same]]
            left_over = left_over[~same & (self._table[slot] >= 0)]
        return found

    def _slot(self, pairs: np.ndarray, step: int) -> np.ndarray:
        mixed = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed >> np.uint64(64 - self._bits)).astype(np.int64) + step) & ((1 << self._bits) - 1)

    def words_of(self, text: str) -> list[str]:
        if self._words is None:
            import regex

            self._words = regex.compile(PATTERN)
        return self._words.findall(text)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each word)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        short = sizes <= LONG
        data = np.frombuffer(b"".join(w for w in words if len(w) <= LONG), np.uint8)
        ids, counts = self._scan(self.byte_ids[data], sizes[short])
        if short.all():
            return ids, counts
        rest = [self._heap(w) for w in words if len(w) > LONG]
        every = np.empty(len(words), np.int64)
        every[short], every[~short] = counts, list(map(len, rest))
        out = np.empty(every.sum(), np.int32)
        belongs = np.repeat(short, every)
        out[belongs], out[~belongs] = ids, np.concatenate(rest)
        return out, every

    def _scan(self, parts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        done_words, done_parts = [], []
        words = np.arange(len(sizes))
        alive = sizes > 0
        words, counts = words[alive], sizes[alive]
        ranks = self._adjacent(parts, counts)
        while len(words):
            starts = np.cumsum(counts) - counts
            least = np.minimum.reduceat(ranks, starts)
            merging = least != NO_PAIR
            if not merging.all():
                stay = np.repeat(merging, counts)
                done_words.append(np.repeat(words[~merging], counts[~merging]))
                done_parts.append(parts[~stay])
                parts, ranks, words, counts, least = parts[stay], ranks[stay], words[merging], counts[merging], least[merging]
                if not len(words):
                    break
                starts = np.cumsum(counts) - counts
            hits = np.flatnonzero(ranks == np.repeat(least, counts))
            owner = np.searchsorted(starts, hits, "right") - 1
            at = hits[np.diff(owner, prepend=-1) != 0]  # the leftmost of each word
            parts[at] = least
            keep = np.ones(len(parts), bool)
            keep[at + 1] = False
            parts, ranks, at = parts[keep], ranks[keep], at - np.arange(len(at))
            counts = counts - 1
            ends = np.cumsum(counts)
            last, first = at == ends - 1, at == ends - counts
            ranks[at[last]] = NO_PAIR
            right, left = at[~last], at[~first]
            fresh = self.ranks(np.concatenate([parts[right], parts[left - 1]]), np.concatenate([parts[right + 1], parts[left]]))
            ranks[right], ranks[left - 1] = fresh[: len(right)], fresh[len(right) :]
        if not done_words:
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
        word, part = np.concatenate(done_words), np.concatenate(done_parts)
        order = np.argsort(word, kind="stable")
        return part[order], np.bincount(word, minlength=len(sizes))

    def _adjacent(self, parts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        ranks = np.full(len(parts), NO_PAIR, np.int32)
        if len(parts) > 1:
            ranks[:-1] = self.ranks(parts[:-1], parts[1:])
        ranks[np.cumsum(counts) - 1] = NO_PAIR
        return ranks

    def _heap(self, word: bytes) -> np.ndarray:
        if self._dict is None:
            self._dict = dict(zip(self.pairs.tolist(), self.merged.tolist()))
        merged, parts = self._dict, self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := merged.get(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or merged.get(parts[i] << 32 | parts[j]) != rank:
                continue  # one of the two has merged since
            parts[i], parts[j], after[i] = rank, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := merged.get(rank << 32 | parts[after[j]])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := merged.get(parts[h] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, h))
        return np.array([p for p in parts if p >= 0], np.int32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each); null and empty texts have none."""
        import pandas as pd

        cut = [self.words_of(t) if t else [] for t in texts]
        words = [w for c in cut for w in c]
        if not words:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        codes, unique = pd.factorize(np.array(words, object))
        ids, sizes = self.encode_words([w.encode("utf-8", "surrogatepass") for w in unique])
        starts, counts = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
        ends = np.cumsum(counts)
        flat = ids[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1])]
        per_text = np.fromiter(map(len, cut), np.int64, len(cut))
        total = np.append(0, ends)[np.append(0, np.cumsum(per_text))]
        return flat, np.diff(total)


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held > SLICE_BYTES // 2:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _mapped(docs: DataFrame, key: str, text: str, vocabulary: Vocabulary, schema: str, build) -> DataFrame:
    """build(key column, ids, counts) of every slice of the documents."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a few MB, fixed by the vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                yield build(batch.column(0).slice(a, b - a), *own.encode(texts[a:b]))

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)


def vocabulary(name: str = BYTE_BPE_50K, folder: str = TOKENIZERS_DIR) -> Vocabulary:
    return Vocabulary.read(os.path.join(folder, name))


def token_ids(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): one row per row of docs, ids without special tokens, of the text as stored.

    Null and empty texts give the empty list; text that looks like a special token is
    plain text; a repeated row is encoded again; a null key is kept. Texts of any
    length are encoded whole. Other columns are dropped.
    """

    def build(keys, ids, counts):
        offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(offsets, pa.array(ids))], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return _mapped(docs, key, text, vocabulary, f"{key} {kind}, ids array<int>", build)


def token_counts(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens): as token_ids, with the number of ids only."""
    kind = docs.schema[key].dataType.simpleString()
    return _mapped(docs, key, text, vocabulary, f"{key} {kind}, n_tokens bigint", lambda keys, ids, counts: pa.RecordBatch.from_arrays([keys, pa.array(counts)], [key, "n_tokens"]))


def decoded(ids: DataFrame, vocabulary: Vocabulary, key: str = "doc_id") -> DataFrame:
    """(key, text): rows of (key, ids) turned back to text; ids that make no whole characters give replacement characters, a null list null."""
    kind = ids.schema[key].dataType.simpleString()
    sent = ids.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value.bytes_of()
        for batch in batches:
            texts = [None if row is None else b"".join(map(known.__getitem__, row)).decode("utf-8", "replace") for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return ids.select(key, "ids").mapInArrow(run, f"{key} {kind}, text string")
