"""Encoding with a byte-level BPE vocabulary, over Arrow batches.

Two tiers: a minimal perfect hash resolves pre-tokens that are in the vocabulary as they stand; the others are merged
with a heap over a linked list of bytes. A text is first cut before each blank that begins a word: no pre-token spans
such a cut and each cut-off part is encoded as it would be in its place, so a batch is encoded by its distinct parts.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens of the byte-level vocabularies. Fixed value of the public tokenizer.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WS_RE2 = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_PARTS = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
SEP = "\ue000"  # private use; a text that holds it takes the other way
_MEMO = 400_000
_MASK = (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash of byte strings (hash and displace): n keys, n slots, one probe, then one comparison."""

    def __init__(self, keys: list[bytes], values: np.ndarray):
        n = len(keys)
        self.n, self.buckets = n, max(1, n // 3)
        h = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        taken = np.zeros(n, bool)
        self.disp = np.zeros(self.buckets, np.int64)
        self.slot_key: list[bytes] = [b""] * n
        self.slot_value = np.zeros(n, np.int64)
        free, free_at = None, 0
        for b in np.argsort(starts[:-1] - starts[1:], kind="stable"):  # largest first
            own = order[starts[b] : starts[b + 1]]
            if not len(own):
                break
            if len(own) == 1:
                # a negative displacement names the slot itself
                if free is None:
                    free = np.flatnonzero(~taken)
                slots = [int(free[free_at])]
                free_at += 1
                self.disp[b] = -slots[0] - 1
            else:
                hs, d = [int(x) for x in h[own]], 1
                while True:
                    slots = [self._mix(x, d) for x in hs]
                    if len(set(slots)) == len(slots) and not any(taken[s] for s in slots):
                        break
                    d += 1
                self.disp[b] = d
            for k, s in zip(own, slots):
                taken[s] = True
                self.slot_key[s] = keys[k]
                self.slot_value[s] = values[k]
        self._disp, self._value = self.disp.tolist(), self.slot_value.tolist()

    def _mix(self, h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & _MASK
        x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & _MASK
        return (x ^ (x >> 29)) % self.n

    def get(self, key: bytes) -> int:
        """The value, or -1."""
        h = xxhash.xxh64_intdigest(key)
        d = self._disp[h % self.buckets]
        s = -d - 1 if d < 0 else self._mix(h, d)
        return self._value[s] if self.slot_key[s] == key else -1


class Encoder:
    """Ids of texts; holds the vocabulary and a memo of parts seen by this process."""

    def __init__(self, path: str = DEFAULT_VOCABULARY):
        keys, ranks = [], []
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    a, b = line.split()
                    keys.append(base64.b64decode(a))
                    ranks.append(int(b))
        self.table = PerfectHash(keys, np.array(ranks, np.int64))
        self.split = regex.compile(PATTERN)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token that isn't in the vocabulary: always the pair of lowest rank, leftmost first."""
        get, n = self.table.get, len(word)
        end = list(range(1, n + 1))  # end of the symbol that starts here
        prev = list(range(-1, n - 1))
        alive = [True] * n
        heap = []
        for i in range(n - 1):
            r = get(word[i : i + 2])
            if r >= 0:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            j = end[i]
            if not alive[i] or j >= n or end[j] != stop:
                continue  # one of the pair has changed
            alive[j] = False
            end[i] = stop
            if stop < n:
                prev[stop] = i
                r = get(word[i : end[stop]])
                if r >= 0:
                    heapq.heappush(heap, (r, i, end[stop]))
            p = prev[i]
            if p >= 0:
                r = get(word[p:stop])
                if r >= 0:
                    heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(get(word[i : end[i]]))
            i = end[i]
        return out

    def part(self, text: str) -> tuple[int, ...]:
        """Ids of a text without the cut into parts, by its pre-tokens."""
        got = self.memo.get(text)
        if got is not None:
            return got
        ids: list[int] = []
        for w in self.split.findall(text):
            known = self.words.get(w)
            if known is None:
                b = w.encode()
                one = self.table.get(b)
                known = (one,) if one >= 0 else tuple(self.merge(b))
                if len(w) <= 64:
                    if len(self.words) > _MEMO:
                        self.words.clear()
                    self.words[w] = known
            ids += known
        got = tuple(ids)
        if len(text) <= 64:
            if len(self.memo) > _MEMO:
                self.memo.clear()
            self.memo[text] = got
        return got

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for p in _PARTS.findall(text):
            out += self.part(p)
        return out

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets); NULL counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        parts, bounds = cut_parts(texts)
        codes = parts.dictionary_encode()
        each = [self.part(p) for p in codes.dictionary.to_pylist()]
        size = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.fromiter((i for t in each for i in t), np.int32, int(size.sum()))
        first = np.concatenate([[0], np.cumsum(size)])
        idx = codes.indices.to_numpy()
        lens = size[idx]
        ends = np.concatenate([[0], np.cumsum(lens)])
        at = np.repeat(first[idx] - ends[:-1], lens) + np.arange(ends[-1])
        return flat[at], ends[bounds]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text; 0 for NULL."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        parts, bounds = cut_parts(texts)
        codes = parts.dictionary_encode()
        size = np.fromiter((len(self.part(p)) for p in codes.dictionary.to_pylist()), np.int64, len(codes.dictionary))
        ends = np.concatenate([[0], np.cumsum(size[codes.indices.to_numpy()])])
        return np.diff(ends[bounds])


def plain_blanks(texts: pa.Array) -> np.ndarray:
    """Whether every blank of a text is followed by something that isn't white space, so that it begins a part."""
    odd = pc.match_substring_regex(texts, pattern=f" (?:[{_WS_RE2}]|$)|{SEP}")
    return ~odd.to_numpy(zero_copy_only=False).astype(bool)


def cut_parts(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(parts of all texts, offsets of the texts in them). Joined, the parts of a text are the text."""
    plain = plain_blanks(texts)
    if plain.all():
        lists = pc.split_pattern(pc.replace_substring(texts, " ", SEP + " "), SEP)
        return lists.flatten(), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    odd = np.flatnonzero(~plain)
    found = [_PARTS.findall(t) for t in texts.take(pa.array(odd)).to_pylist()]
    lists = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(plain)), " ", SEP + " "), SEP)
    sizes = np.zeros(len(texts), np.int64)
    own = np.diff(lists.offsets.to_numpy().astype(np.int64))
    sizes[plain] = own
    sizes[odd] = [len(x) for x in found]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    # parts of plain texts come first, then those of the odd ones; put them in order of the texts
    base = np.zeros(len(texts), np.int64)
    base[plain] = np.concatenate([[0], np.cumsum(own)])[:-1]
    base[odd] = own.sum() + np.concatenate([[0], np.cumsum(sizes[odd])])[:-1]
    order = np.repeat(base - bounds[:-1], sizes) + np.arange(bounds[-1])
    both = pa.concat_arrays([lists.flatten().cast(pa.large_string()), pa.array([p for x in found for p in x], pa.large_string())])
    return both.take(pa.array(order)), bounds


@lru_cache(maxsize=4)
def encoder(path: str = DEFAULT_VOCABULARY) -> Encoder:
    """One encoder per process and vocabulary."""
    return Encoder(path)


def slices(batch: pa.RecordBatch, column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about ``most`` bytes of text at a time; a longer text is a run of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    if size.sum() <= most:
        yield batch
        return
    start, held = 0, 0
    for i, s in enumerate(size):
        if held and held + s > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(s)
    yield batch.slice(start)


def encode(df: DataFrame, key: str, text: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(key, ids array<int>): the ids of each text without special tokens; strings of special tokens are plain text.

    An empty text and a NULL text both have the empty list. Rows are kept one to one, repeated keys included; no
    shuffle. The vocabulary's file must be at ``path`` on every executor.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for part in slices(b, 1):
                ids, offsets = enc.batch(part.column(1))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["_key", "ids"])

    out = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, f"_key {kind}, ids array<int>")
    return out.withColumnRenamed("_key", key)


def token_counts(df: DataFrame, text: str, out: str = "n_tokens", path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``df`` without ``text`` and with the number of ids of each text; 0 for an empty and for a NULL text."""
    rest = [c for c in df.columns if c not in (text, out)]
    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest], f"`{out}` bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            for part in slices(b, part_at := b.num_columns - 1):
                n = enc.counts(part.column(part_at))
                yield pa.RecordBatch.from_arrays([*part.columns[:part_at], pa.array(n, pa.int64())], [*rest, out])

    return df.select(*rest, text).mapInArrow(run, schema)
