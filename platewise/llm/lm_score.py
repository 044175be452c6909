"""Language-model scoring by an Elias-Fano n-gram trie.

The model is a bigram model with a Dirichlet prior. With c the counts of the training texts and P1 the additive unigram
estimate (c(w) + 0.1) / (N + 0.1 (V + 1)):
    P(w | v) = (c(v w) + m P1(w)) / (c(v) + m),  m = mu * c(v) ** power
After a word that no training text has, P1(w) is used. Every word and every pair of every training text is modelled.

Training freezes a model in a folder of the shared store, which any later call can score with: the head (the most
frequent words with their counts, a fixed number, which every worker gets) and the shards of a trie, a row each. A
shard has the words that are not in the head, with their counts, and under each word of any kind the words that stood
before it. Keys and pointers are Elias-Fano sequences and stay packed: low bits of any width, high bits in unary with a
select directory. A pair is found by the successor of its second key within the range that the pointers give to its
first. Pairs carry relative frequencies as codes of 16 bits (exact counts up to 4,096, steps of 1/2048 octave beyond);
counts of words, which the additive estimate needs exactly, are whole numbers.

Scoring sends pairs to shards and codes back. Texts are read in blocks. A block asks for each of its distinct pairs
once, so a word or a phrase that a third of all texts hold costs one question for each block. Pairs go to shards by
their second word; the pairs of the `split` most frequent words are dealt over SPREAD ranges of the first word. The
smoothing needs no further question: the context of a token is the token before it. A shard is streamed: its trie lies
in a memory map, and the blocks' questions pass by it one batch at a time.

Blocks are cut again from the texts when the codes come back, which costs reading them twice, not carrying them through
the shuffle. So docs should be a table as it was read: its rows come in the same order in every scan. If they ever did
not, the digest of a block's pairs would differ, and the query fails instead of scoring wrongly.

Words are told apart by 64-bit hashes. Defined results: null and empty texts are the end token alone; with no training
text every token has probability one; rows with a null id are scored, not learned; repeated rows are scored (and
learned) each; texts of any length are read in pieces; an empty table gives an empty result; further columns, also
clashing ones, are ignored.
"""

from __future__ import annotations

import mmap
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.common import batch, discard, materialize, shared_dir, word_hash, write_table

END, START = b" end", b" start"  # no word holds a space
_U = np.uint64
_EMPTY = np.empty(0, np.int64)


# ---------------------------------------------------------------- packed sequences


class EliasFano:
    """A non-decreasing sequence of n values, queried as it is packed.

    low: the low `low_bits` bits of each value, one after another in words of 64 bits. high: bit h + i is set for the
    high part h of value i. The directory holds the ones before each word of `high`; zeros follow from it.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        self.top = int(self._one(np.array([n - 1]))[0]) - (n - 1) if n else -1  # high part of the last value

    @staticmethod
    def parts(values: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """(low_bits, low, high) of non-decreasing values below 2 ** 64."""
        v = np.asarray(values).astype(_U)
        n = len(v)
        top = int(v[-1]) if n else 0
        bits = max(0, (top // max(1, n)).bit_length() - 1)
        low = np.zeros(n * bits // 64 + 2, _U)
        if bits:
            x, at = v & _U((1 << bits) - 1), np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(_U)
            np.add.at(low, word, x << shift)
            over = np.flatnonzero(shift.astype(np.int64) + bits > 64)
            np.add.at(low, word[over] + 1, x[over] >> (_U(64) - shift[over]))
        at = (v >> _U(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(at[-1]) + 2) // 64 + 1 if n else 1, _U)
        np.add.at(high, at >> 6, _U(1) << (at & 63).astype(_U))
        return bits, low, high

    def _one(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th one (from 0) of the high bits."""
        word = np.searchsorted(self.ones, k, "right") - 1
        return word * 64 + self._select(self.high[word], k - self.ones[word])

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        return word * 64 + self._select(~self.high[word], k - self.zeros[word])

    @staticmethod
    def _select(x: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Place of a one in each word, `left` ones before it."""
        place = np.zeros(len(x), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(x & _U((1 << half) - 1)).astype(np.int64)
            up = left >= count
            left = left - np.where(up, count, 0)
            place += np.where(up, half, 0)
            x = np.where(up, x >> _U(half), x)
        return place

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), _U)
        at = i * self.low_bits
        word, shift = at >> 6, (at & 63).astype(_U)
        return (self.low[word] >> shift | self.low[word + 1] << _U(1) << (_U(63) - shift)) & _U((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return (self._one(i) - i).astype(_U) << _U(self.low_bits) | self._low(i)

    def find(self, keys: np.ndarray, first: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """Index of each key, found as its successor within [first, stop); -1 where the successor is another value."""
        keys = np.asarray(keys).astype(_U)
        out = np.full(len(keys), -1, np.int64)
        high = (keys >> _U(self.low_bits)).astype(np.int64)
        at = np.flatnonzero((high >= 0) & (high <= self.top))
        if not len(at):
            return out
        h = high[at]
        end = self._zero(h) - h  # values with a high part of at most h
        begin = np.where(h > 0, self._zero(np.maximum(h - 1, 0)) - np.maximum(h - 1, 0), 0)
        if first is not None:
            begin, end = np.maximum(begin, first[at]), np.minimum(end, stop[at])
        want = keys[at] & _U((1 << self.low_bits) - 1)
        last = end.copy()
        open_ = np.flatnonzero(begin < end)
        while len(open_):
            mid = (begin[open_] + end[open_]) >> 1
            less = self._low(mid) < want[open_]
            begin[open_] = np.where(less, mid + 1, begin[open_])
            end[open_] = np.where(less, end[open_], mid)
            open_ = open_[begin[open_] < end[open_]]
        hit = np.flatnonzero(begin < last)
        hit = hit[self._low(begin[hit]) == want[hit]]
        out[at[hit]] = begin[hit]
        return out


#: Codes up to here are the count itself; each further octave has STEP codes.
EXACT, STEP = 4096, 2048.0


def quantise(counts: np.ndarray) -> np.ndarray:
    c = np.maximum(np.asarray(counts, np.float64), 1.0)
    return np.where(c <= EXACT, np.asarray(counts), np.minimum(EXACT + np.rint(STEP * np.log2(c / EXACT)), 65_535)).astype(np.uint16)


def counts_of(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.float64)
    return np.where(x <= EXACT, x, EXACT * np.exp2((x - EXACT) / STEP))


class Trie:
    """Words of one shard and, under each word, the words that stood before it.

    Words are numbers: those of the head first, then the shard's own, ascending by hash.
    """

    def __init__(self, head: int, words: EliasFano, pointers: EliasFano, pairs: EliasFano, counts: np.ndarray, codes: np.ndarray):
        self.head, self.words, self.pointers, self.pairs, self.counts, self.codes = head, words, pointers, pairs, counts, codes

    @staticmethod
    def pack(head: int, words: np.ndarray, counts: np.ndarray, pairs: np.ndarray, codes: np.ndarray) -> bytes:
        """One block of bytes, in pieces of 8. words: ascending hashes; pairs: ascending word * (head + len(words)) + word before."""
        n = head + len(words)
        sequences = (words, np.searchsorted(pairs // max(1, n), np.arange(n + 1)), pairs)
        width = np.min_scalar_type(int(counts.max())) if len(counts) else np.dtype(np.uint8)
        plain = (counts.astype(width), codes.astype(np.uint16))
        packed = [(len(v), *EliasFano.parts(v)) for v in sequences]
        numbers = [head, *[x for m, bits, low, high in packed for x in (m, bits, len(low), len(high))], *[x for a in plain for x in (len(a), a.itemsize)]]
        out = [np.array(numbers, np.int64).tobytes()]
        for _, _, low, high in packed:
            out += [low.tobytes(), high.tobytes()]
        out += [a.tobytes() + b"\0" * (-a.nbytes % 8) for a in plain]
        return b"".join(out)

    @classmethod
    def view(cls, data: np.ndarray) -> Trie:
        """A trie over packed bytes; nothing is copied but the select directories."""
        numbers, at, parts = data[: 8 * 17].view(np.int64).tolist(), 8 * 17, []
        for k in range(3):
            n, bits, a, b = numbers[1 + 4 * k : 5 + 4 * k]
            parts.append(EliasFano(n, bits, data[at : at + 8 * a].view(_U), data[at + 8 * a : at + 8 * (a + b)].view(_U)))
            at += 8 * (a + b)
        for k in range(2):
            n, width = numbers[13 + 2 * k : 15 + 2 * k]
            parts.append(data[at : at + n * width].view(np.dtype(f"u{width}")))
            at += -(-n * width // 8) * 8
        return cls(numbers[0], *parts)

    @classmethod
    def mapped(cls, data: bytes) -> Trie:
        """A trie in a memory map of its own, which no folder holds and which goes with the task."""
        m = mmap.mmap(-1, max(1, len(data)))
        m.write(data)
        return cls.view(np.frombuffer(m, np.uint8))

    @classmethod
    def open(cls, path: str) -> Trie:
        """A trie in a file of packed bytes, mapped."""
        return cls.view(np.memmap(path, np.uint8, "r"))

    def word(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word that is not in the head, or -1."""
        at = self.words.find(hashes)
        return np.where(at >= 0, self.head + at, -1)

    def pair(self, word: np.ndarray, before: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """Index of each pair among the words that stood before its word, or -1; sizes: how many words before each word."""
        sizes = np.ones(len(word), np.int64) if sizes is None else sizes
        out = np.full(len(before), -1, np.int64)
        if not self.pairs.n or not len(before):
            return out
        w = np.maximum(word, 0)  # the range of a word is read once
        first, stop = self.pointers.get(w).astype(np.int64), self.pointers.get(w + 1).astype(np.int64)
        some = np.repeat((word >= 0) & (first < stop), sizes)
        at = np.flatnonzero(some & (before >= 0))
        of = np.repeat(np.arange(len(word)), sizes)[at]
        out[at] = self.pairs.find(w[of] * (self.head + self.words.n) + before[at], first[of], stop[of])
        return out

    def code(self, pair: np.ndarray) -> np.ndarray:
        return np.where(pair >= 0, self.codes[np.maximum(pair, 0)], 0).astype(np.uint16) if len(self.codes) else np.zeros(len(pair), np.uint16)

    def count(self, word: np.ndarray) -> np.ndarray:
        """Training count of each of the shard's own words; 0 for -1."""
        at = word - self.head
        return np.where(at >= 0, self.counts[np.maximum(at, 0)], 0).astype(np.int64) if len(self.counts) else np.zeros(len(word), np.int64)


class Head:
    """The most frequent words: number 0 is the start of a text, the others follow by count."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.counts, order = counts, np.argsort(hashes)
        self.sorted, self.number = hashes[order], order

    def __len__(self) -> int:
        return len(self.counts)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, or -1."""
        if not len(self.sorted):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.number[at], -1)


# ---------------------------------------------------------------- reading texts

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _pieces(text: bytes, step: int) -> Iterator[bytes]:
    """A text cut at white space into pieces of some `step` bytes."""
    at = 0
    while len(text) - at > step:
        cut = _SPACE.search(text, at + step)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


class Block:
    """Tokens of many texts as numbers of the block's own words.

    A text is one or more segments. A segment begins with tokens that are context only (`lead`): the start, or the last
    two tokens of the segment before it.
    """

    def __init__(self):
        self.x: list[int] = []
        self.ids: dict[bytes, int] = defaultdict()  # a new word gets the next number
        self.ids.default_factory = self.ids.__len__
        for w in (START, END):
            self.ids[w]
        self.segments: list[tuple] = []  # key, doc_id, train, held out, first place, lead

    def put(self, words: list[bytes]) -> None:
        self.x.extend(map(self.ids.__getitem__, words))

    def close(self) -> Block:
        self.hashes = np.array([word_hash(w) for w in self.ids], np.int64).view(_U)
        self.n = len(self.ids)
        self.x = np.array(self.x, np.int64)
        self.first = np.array([s[4] for s in self.segments], np.int64)
        self.sizes = np.diff(np.append(self.first, len(self.x)))
        self.place = np.arange(len(self.x)) - np.repeat(self.first, self.sizes)
        self.lead = np.repeat(np.array([s[5] for s in self.segments], np.int64), self.sizes)
        return self

    def pairs(self, head: Head, counted: bool) -> Pairs:
        """The distinct pairs: all that scoring asks for, or those that count."""
        at = np.flatnonzero(self.place >= (self.lead if counted else 1))
        keys, of = np.unique(self.x[at] * self.n + self.x[at - 1], return_inverse=True)
        return Pairs(self, head, keys, of, at)


class Pairs:
    """Distinct pairs of a block, by word and then by the word before; `of` and `at`: the pair of each place."""

    #: Parts of a frequent word's pairs, and how many words count as such.
    SPREAD, SPLIT = 64, 1024

    def __init__(self, block: Block, head: Head, keys: np.ndarray, of: np.ndarray, at: np.ndarray):
        self.keys, self.of, self.at = keys, of, at
        self.word, self.before = keys // max(1, block.n), keys % max(1, block.n)
        self.number = head.find(block.hashes)  # of each word of the block
        h = block.hashes
        part = _mix(h[self.before]) % _U(self.SPREAD) + _U(1)
        number = self.number[self.word]
        self.route = _mix(h[self.word] + np.where((number >= 0) & (number < self.SPLIT), part, _U(0)))

    def digest(self, own: np.ndarray) -> int:
        """Of some of the pairs; it travels with the questions and back, to be compared with what the texts say then."""
        return int(np.bitwise_xor.reduce(self.route[own], initial=_U(len(own))).view(np.int64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def _blocks(batches, size: int) -> Iterator[tuple[int, Block]]:
    """(number, block) of rows (key, doc_id, train, held_out, text); numbers are unique over all tasks."""
    block, number = Block(), None
    for b in batches:
        for key, doc, train, held, text in zip(*(c.to_pylist() for c in b.columns[:4]), b.column(4)):
            number = key if number is None else number
            block.segments.append((key, doc, train, held, len(block.x), 1))
            block.x.append(0)
            pieces = list(_pieces((text.as_py() or "").encode().lower(), 4 * size))
            while pieces:
                block.put(pieces.pop(0).split())
                if pieces and len(block.x) >= size:
                    names = list(block.ids)
                    before = [names[i] for i in block.x[-2:]]
                    yield number, block.close()
                    block, number = Block(), number + 1
                    block.segments.append((key, doc, train, held, 0, 2))
                    block.put(before)
            block.x.append(1)
            if len(block.x) >= size:
                yield number, block.close()
                block, number = Block(), number + 1
    if block.segments:
        yield number, block.close()


def _shares(route: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(order by shard, borders): what belongs to shard s is order[borders[s] : borders[s + 1]]."""
    shard = (route % _U(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, lengths) of the runs of an ascending sequence."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return x[first], np.diff(np.append(first, len(x))).astype(np.uint32)


_RARE = 65_535  # stands for a word that is not in the head; its hash follows apart


def _pack(block: Block, p: Pairs, shards: int, counts: tuple | None) -> Iterator[tuple[int, bytes]]:
    """(shard, bytes): its words with the number of their pairs, the words before them, and counts of pairs and words if any."""
    order, borders = _shares(p.route, shards)
    for s in range(shards):
        own = order[borders[s] : borders[s + 1]]  # ascending by word, as the sort is stable
        if not len(own):
            continue
        words, size = _runs_of(p.word[own])
        before = p.before[own]
        w, v = p.number[words], p.number[before]
        rare_w, rare_v = words[w < 0], before[v < 0]
        out = [np.array([len(words), len(own), len(rare_w), len(rare_v), p.digest(own)], np.int64).tobytes(), block.hashes[rare_w].tobytes(), block.hashes[rare_v].tobytes()]
        out += [size.tobytes(), np.where(w < 0, _RARE, w).astype(np.uint16).tobytes(), np.where(v < 0, _RARE, v).astype(np.uint16).tobytes()]
        if counts is not None:
            out += [counts[0][own].astype(np.uint32).tobytes(), counts[1][rare_w].astype(np.uint32).tobytes()]
        yield s, b"".join(out)


def _unpack(data: bytes, counted: bool) -> tuple:
    """(words, sizes, before, hashes of rare words, hashes of rare words before[, counts of pairs, counts of rare words])."""
    n, m, a, b, _ = np.frombuffer(data, np.int64, 5).tolist()
    at, out = 40, []
    for size, kind in ((a, _U), (b, _U), (n, np.uint32), (n, np.uint16), (m, np.uint16), *(((m, np.uint32), (a, np.uint32)) if counted else ())):
        out.append(np.frombuffer(data, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return (out[3], out[2].astype(np.int64), out[4], out[0], out[1], *out[5:])


def _numbers(marks: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Numbers of words: head numbers, and those of the rare words in turn."""
    out = marks.astype(np.int64)
    out[marks == _RARE] = rare
    return out


# ---------------------------------------------------------------- training

_SENT = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])
_SENT_SQL = "shard int, block long, data binary"
_TRIES = pa.schema([("shard", pa.int32()), ("trie", pa.binary())])
_TRIES_SQL = "shard int, trie binary"
_HEAD_SQL = "number long, hash long, n long, tokens long, words long, shards long"


def _runs(batches) -> Iterator[tuple]:
    """Rows (shard, block, data) of a sorted partition."""
    for b in batches:
        yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2))


def build_trie(head: int, rows: list[tuple]) -> bytes:
    """Packed trie of unpacked rows with counts."""
    words = np.unique(np.concatenate([x for r in rows for x in r[3:5]])) if rows else np.empty(0, _U)
    n = head + len(words)
    counts = np.zeros(len(words), np.int64)
    keys, times = [], []
    for marks, sizes, before, rare_w, rare_v, c2, c1 in rows:
        own = np.searchsorted(words, rare_w)
        np.add.at(counts, own, c1.astype(np.int64))
        w, v = _numbers(marks, head + own), _numbers(before, head + np.searchsorted(words, rare_v))
        keys.append(np.repeat(w, sizes) * n + v)
        times.append(c2)
    pairs, of = np.unique(np.concatenate(keys) if keys else _EMPTY, return_inverse=True)
    count2 = np.bincount(of, np.concatenate(times) if times else _EMPTY, minlength=len(pairs))
    return Trie.pack(head, words, counts, pairs, quantise(count2))


def _rows(docs: DataFrame) -> DataFrame:
    part = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10))
    return docs.select(
        F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(part != 0, F.lit(False)).alias("train"),
        F.coalesce(part == 0, F.lit(False)).alias("held_out"), "text",
    )


def _word_counts(block: Block) -> np.ndarray:
    """Count of each of the block's words; the start counts its texts."""
    begins = np.flatnonzero((block.place == 0) & (block.lead == 1))
    return np.bincount(np.concatenate([block.x[block.place >= block.lead], block.x[begins]]), minlength=block.n)


@dataclass
class Model:
    """A frozen model: `path` holds the shards' tries and the head, which has a fixed size."""

    path: str
    shards: int
    tokens: int
    words: int
    head: Head

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        rows = spark.read.schema(_HEAD_SQL).parquet(f"{path}/head").orderBy("number").toPandas()
        head = rows[rows["number"] >= 0]
        return cls(path, int(rows["shards"][0]), int(rows["tokens"][0]), int(rows["words"][0]), Head(head["hash"].to_numpy(np.int64).view(_U), head["n"].to_numpy(np.int64)))

    def tries(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_TRIES_SQL).parquet(f"{self.path}/tries")


def train(docs: DataFrame, path: str | None = None, head_words: int = 60_000, shard_bytes: int = 8 << 20, least_shards: int = 64, block_tokens: int = 600_000) -> Model:
    """Learn from the training texts of docs (doc_id, text) and freeze the model in a folder of the shared store.

    `head_words` (below 65,000) decides what is sent to every worker, never a result.
    """
    if head_words >= _RARE - 1:
        raise ValueError("head_words must be below 65,534")
    spark, rows = docs.sparkSession, _rows(docs).where("train")
    path = path or shared_dir(spark)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(least_shards, -(-int(size) // shard_bytes))
    start = word_hash(START)
    counted = pa.schema([("hash", pa.int64()), ("n", pa.int64())])

    def count(batches):
        for _, block in _blocks(batches, block_tokens):
            n = _word_counts(block)
            yield batch(counted, (block.hashes.view(np.int64)[n > 0], n[n > 0]))

    words = materialize(rows.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")))
    tokens, distinct = words.where(F.col("hash") != start).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = words.where(F.col("hash") != start).orderBy(F.desc("n"), "hash").limit(head_words).toPandas()
    texts = words.where(F.col("hash") == start).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    discard(words)
    kept = [(0, start, int(texts)), *zip(range(1, len(top) + 1), top["hash"].tolist(), top["n"].tolist())]
    spark.createDataFrame([(*k, int(tokens), int(distinct), shards) for k in kept], _HEAD_SQL).coalesce(1).write.parquet(f"{path}/head")
    shared = spark.sparkContext.broadcast(Model.load(spark, path).head)

    def send(batches):
        head = shared.value
        for number, block in _blocks(batches, block_tokens):
            p = block.pairs(head, counted=True)
            counts = np.bincount(p.of, minlength=len(p.keys)), _word_counts(block)
            yield batch(_SENT, zip(*[(s, number, data) for s, data in _pack(block, p, shards, counts)]))

    def build(batches):
        head, now, rows = shared.value, None, []
        for shard, _, data in _runs(batches):
            if shard != now and rows:
                yield batch(_TRIES, ([now], [build_trie(len(head), rows)]))
                rows.clear()
            now = shard
            rows.append(_unpack(data.as_py(), True))
        if rows:
            yield batch(_TRIES, ([now], [build_trie(len(head), rows)]))

    sent = rows.mapInArrow(send, _SENT_SQL)
    write_table(sent.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(build, _TRIES_SQL), f"{path}/tries")
    return Model.load(spark, path)


# ---------------------------------------------------------------- scoring

_FOUND = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("segments", pa.binary()), ("data", pa.binary())])
_FOUND_SQL = "block long, shard int, segments binary, data binary"
_OUT = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_OUT_SQL = "key long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_CHANGED = "the texts of a block changed between two scans of the table"


def answer(trie: Trie | None, data: bytes) -> bytes:
    """Digest of the questions, codes of pairs and counts of rare words, in the order of the questions."""
    marks, sizes, before, rare_w, rare_v = _unpack(data, False)
    if trie is None:
        return data[32:40] + b"\0" * (2 * len(before) + 8 * len(rare_w))
    own = trie.word(rare_w)
    codes = trie.code(trie.pair(_numbers(marks, own), _numbers(before, trie.word(rare_v)), sizes))
    return data[32:40] + codes.tobytes() + trie.count(own).tobytes()


def _questions(rows: DataFrame, shared, shards: int, block_tokens: int) -> DataFrame:
    def run(batches):
        for number, block in _blocks(batches, block_tokens):
            p = block.pairs(shared.value, counted=False)
            yield batch(_SENT, zip(*[(s, number, data) for s, data in _pack(block, p, shards, None)]))

    return rows.mapInArrow(run, _SENT_SQL)


def _answers(questions: DataFrame, tries: DataFrame, shards: int) -> DataFrame:
    """Each shard's trie comes first (block null), then the questions of all blocks pass by it."""

    def run(batches):
        now, trie = None, None
        for shard, block, data in _runs(batches):
            if shard != now:
                now, trie = shard, None
            if block is None:
                trie = Trie.mapped(data.as_py())
            else:
                yield batch(_FOUND, ([block], [shard], [None], [answer(trie, data.as_py())]))

    both = questions.unionByName(tries.select("shard", F.lit(None).cast("long").alias("block"), F.col("trie").alias("data")))
    return both.repartition(shards, "shard").sortWithinPartitions("shard", F.col("block").asc_nulls_first()).mapInArrow(run, _FOUND_SQL)


_SEGMENT = np.dtype([("key", np.int64), ("doc", np.int64), ("none", np.int8), ("held", np.int8), ("first", np.int64), ("lead", np.int8)])


def _texts(rows: DataFrame, block_tokens: int) -> DataFrame:
    """The blocks again, as rows that meet their answers: word numbers of all tokens and the words' hashes."""

    def run(batches):
        for number, block in _blocks(batches, block_tokens):
            segments = np.array([(k, d or 0, d is None, h, a, lead) for k, d, _, h, a, lead in block.segments], _SEGMENT)
            kind = np.uint16 if block.n <= 65_536 else np.uint32
            data = np.array([block.n], np.int64).tobytes() + block.hashes.tobytes() + block.x.astype(kind).tobytes()
            yield batch(_FOUND, ([number], [None], [segments.tobytes()], [data]))

    return rows.mapInArrow(run, _FOUND_SQL)


def score_block(segments: bytes, data: bytes, answers: list[tuple[int, bytes]], model: Model, mu: float, power: float) -> pa.RecordBatch:
    """Sums of each segment of a block; answers: (shard, bytes)."""
    block, seg = Block(), np.frombuffer(segments, _SEGMENT)
    block.n = int(np.frombuffer(data, np.int64, 1)[0])
    block.hashes = np.frombuffer(data, _U, block.n, 8)
    block.x = np.frombuffer(data, np.uint16 if block.n <= 65_536 else np.uint32, -1, 8 + 8 * block.n).astype(np.int64)
    sizes = np.diff(np.append(seg["first"], len(block.x)))
    block.place, block.lead = np.arange(len(block.x)) - np.repeat(seg["first"], sizes), np.repeat(seg["lead"].astype(np.int64), sizes)
    p = block.pairs(model.head, counted=False)
    order, borders = _shares(p.route, model.shards)
    if len(answers) != int((np.diff(borders) > 0).sum()):
        raise RuntimeError(_CHANGED)
    counts = np.where(p.number >= 0, model.head.counts[np.maximum(p.number, 0)], 0)
    codes = np.zeros(len(p.keys), np.uint16)
    for s, got in answers:
        own = order[borders[s] : borders[s + 1]]
        words, _ = _runs_of(p.word[own])
        rare = words[p.number[words] < 0]
        if len(got) != 8 + 2 * len(own) + 8 * len(rare) or int.from_bytes(got[:8], "little", signed=True) != p.digest(own):
            raise RuntimeError(_CHANGED)
        codes[own] = np.frombuffer(got, np.uint16, len(own), 8)
        counts[rare] = np.frombuffer(got[8 + 2 * len(own) :], np.int64)
    c1, c2, before = counts[block.x].astype(np.float64), np.zeros(len(block.x)), np.zeros(len(block.x))
    c2[p.at] = counts_of(codes)[p.of]
    before[1:] = c1[:-1]
    p1 = (c1 + 0.1) / (model.tokens + 0.1 * (model.words + 1))
    m = mu * np.maximum(before, 1.0) ** power
    p2 = np.where(before > 0, (c2 + m * p1) / (before + m), p1)
    own = block.place >= block.lead
    sums = [np.add.reduceat(np.where(own, x, 0), seg["first"]) for x in (own.astype(np.int64), (c1 > 0).astype(np.int64), np.log10(p1), np.log10(p2))]
    docs = pa.array(seg["doc"].copy(), mask=seg["none"] != 0)
    return batch(_OUT, (seg["key"].copy(), docs, seg["held"] != 0, *sums))


def score(docs: DataFrame, model: Model, mu: float = 2.0, power: float = 0.9, block_tokens: int = 600_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text)."""
    spark, rows = docs.sparkSession, _rows(docs)
    shared = spark.sparkContext.broadcast(model.head)
    found = _answers(_questions(rows, shared, model.shards, block_tokens), model.tries(spark), model.shards)
    found = write_table(found, shared_dir(spark))
    frozen = spark.sparkContext.broadcast(model)

    def run(tab: pa.Table) -> pa.Table:
        rows = list(zip(tab.column("shard").to_pylist(), tab.column("segments"), tab.column("data")))
        text = [r for r in rows if r[0] is None]
        if len(text) != 1:
            raise RuntimeError(_CHANGED)
        answers = [(s, d.as_py()) for s, _, d in rows if s is not None]
        return pa.Table.from_batches([score_block(text[0][1].as_py(), text[0][2].as_py(), answers, frozen.value, mu, power)])

    scored = found.unionByName(_texts(rows, block_tokens)).groupBy("block").applyInArrow(run, _OUT_SQL)
    whole = scored.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    )  # a text of many pieces has several rows
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def score_documents(docs: DataFrame, mu: float = 2.0, power: float = 0.9, head_words: int = 60_000, shard_bytes: int = 8 << 20, least_shards: int = 64, block_tokens: int = 600_000) -> DataFrame:
    """`train` on docs, then `score` them."""
    return score(docs, train(docs, None, head_words, shard_bytes, least_shards, block_tokens), mu, power, block_tokens)
