"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. Every word n-gram of an item is a seed, however many texts hold it: copies of an item make its own n-grams frequent,
   so none is left out for its count.
2. A text is joined with the items whose seeds it holds. Around the hits, at the item's length and half of it on each
   side, the item's words are counted: an alignment of `threshold` has that share of them at least, so windows with
   fewer (phrases of common words) are left. The others are aligned locally (match +2, mismatch -1, gap -1). The pair is
   reported if the score reaches `threshold` of the item's perfect score; an edited copy with a third of its words
   changed still does if three words in a row are left, chance does not (0.1).

Words are compared without case and punctuation. Items are broadcast in slices of `slice_items`, so the size of what
is sent is bounded however large the benchmark is. No table is shuffled.

Defined results: null or empty texts and items of fewer than n words match nothing; repeated items and rows are
reported each; rows with a null id are reported with a null id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import batch, slices, word_hash
from platewise.llm.ngram_join import mix


#: ASCII characters that are neither letters nor digits nor white space.
_MARKS = bytes(c for c in range(128) if not chr(c).isalnum() and c not in b" \t\n\x0b\x0c\r")
_WIDE_MARKS = re.compile(r"[^\x00-\x7f\w]")


def plain_words(text: str | None) -> list[bytes]:
    """Words in lower case without what is not a letter or digit; words of nothing else vanish."""
    text = (text or "").lower()
    if not text.isascii():
        text = _WIDE_MARKS.sub("", text)
    return text.encode().translate(None, _MARKS).split()


def smith_waterman(item: np.ndarray, words: np.ndarray, match: int = 2, mismatch: int = -1, gap: int = -1) -> tuple[int, int]:
    """(best local score, end of the alignment in words): one vector step for each word of the item."""
    if not len(item) or not len(words):
        return 0, 0
    row = np.zeros(len(words) + 1, np.int64)
    slope = -gap * np.arange(len(words) + 1)
    best, end = 0, 0
    for w in item:
        step = np.maximum(row[:-1] + np.where(words == w, match, mismatch), row[1:] + gap)
        now = np.concatenate([[0], np.maximum(step, 0)])
        row = np.maximum.accumulate(now + slope) - slope  # a gap in the item runs along the row
        k = int(row.argmax())
        if row[k] > best:
            best, end = int(row[k]), k
    return best, end


class Seeds:
    """Items of one slice and their n-grams."""

    BITS = 20

    def __init__(self, items: list[tuple[int, str]], n: int):
        forms = [plain_words(t) for _, t in items]
        self.known = {f: word_hash(f) or 1 for fs in forms for f in fs}
        self.n, self.ids = n, [i for i, _ in items]
        self.words = [np.array([self.known[f] for f in fs], np.int64) for fs in forms]
        self.bags = [np.unique(w, return_counts=True) for w in self.words]
        grams, owner, offset = [], [], []
        for k, w in enumerate(self.words):
            g = self.grams_at(w, np.arange(max(0, len(w) - n + 1)))
            grams.append(g)
            owner.append(np.full(len(g), k, np.int64))
            offset.append(np.arange(len(g)))
        grams, owner, offset = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (grams, owner, offset))
        order = np.argsort(grams, kind="stable")
        self.grams, self.owner, self.offset = grams[order].astype(np.uint64), owner[order], offset[order]
        self.unique = np.unique(self.grams)
        self.filter = np.zeros(1 << self.BITS, np.bool_)
        self.filter[(self.unique & np.uint64((1 << self.BITS) - 1)).astype(np.int64)] = True

    def word_hashes(self, text: str | None) -> np.ndarray:
        """Hash of each word; 0 for a word that no item has."""
        get = self.known.get
        return np.array([get(w, 0) for w in plain_words(text)], np.int64)

    def grams_at(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hashes of the n-grams that begin at these words."""
        w = words.view(np.uint64)
        h = mix(w[at] + np.uint64(self.n)) if len(at) else np.empty(0, np.uint64)
        for j in range(1, self.n):
            h = mix(h + w[at + j])
        return h

    def seeds_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of a text's n-grams that are n-grams of an item; only runs of items' words are hashed."""
        known = words != 0
        at = known[: max(0, len(words) - self.n + 1)].copy()
        for j in range(1, self.n):
            at &= known[j : j + len(at)]
        at = np.flatnonzero(at)
        grams = self.grams_at(words, at)
        some = self.filter[(grams & np.uint64((1 << self.BITS) - 1)).astype(np.int64)]
        at, grams = at[some], grams[some]
        if not len(at) or not len(self.unique):
            return at[:0], grams[:0]
        found = np.minimum(np.searchsorted(self.unique, grams), len(self.unique) - 1)
        hit = self.unique[found] == grams
        return at[hit], grams[hit]

    def hits(self, words: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item, seeds hit, from, to): merged windows of the text around the hits of each item."""
        at, grams = self.seeds_of(words)
        if len(at):
            a, b = np.searchsorted(self.grams, grams), np.searchsorted(self.grams, grams, "right")
            place = np.repeat(at, b - a)
            entry = np.concatenate([np.arange(x, y) for x, y in zip(a, b)])
            start = place - self.offset[entry]
            owner = self.owner[entry]
            for k in np.unique(owner):
                size = len(self.words[k])
                margin = size // 2 + 8
                s = np.sort(start[owner == k])
                cut = np.flatnonzero(np.diff(s) > size + 2 * margin) + 1
                for part in np.split(s, cut):
                    yield int(k), len(part), max(0, int(part[0]) - margin), min(len(words), int(part[-1]) + size + margin)

    def shared(self, k: int, words: np.ndarray) -> int:
        """How many of an item's words are among these, each as often as both have it: no alignment matches more."""
        own, times = self.bags[k]
        at = np.minimum(np.searchsorted(own, words), len(own) - 1)
        return int(np.minimum(times, np.bincount(at[own[at] == words], minlength=len(own))).sum())

    def matches(self, text: str | None, threshold: float) -> list[tuple[int, float, int, int, int]]:
        """(item id, score share, seeds hit, from, to in plain words), the best window of each item that reaches the threshold."""
        words = self.word_hashes(text)
        best: dict[int, tuple] = {}
        for k, n, a, b in self.hits(words):
            item = self.words[k]
            if self.shared(k, words[a:b]) / len(item) < threshold:
                continue
            score, end = smith_waterman(item, words[a:b])
            share = score / (2 * len(item))
            if share >= threshold and (k not in best or share > best[k][1]):
                best[k] = (self.ids[k], share, n, max(0, a + end - len(item)), a + end)
        return [best[k] for k in sorted(best)]


def _slices(benchmark: DataFrame, slice_items: int) -> Iterator[list[tuple[int, str]]]:
    rows = benchmark.where("text is not null").select("item_id", "text").toLocalIterator()
    part: list[tuple[int, str]] = []
    for r in rows:
        part.append((r[0], r[1]))
        if len(part) == slice_items:
            yield part
            part = []
    if part:
        yield part


def all_seeds(docs: DataFrame, benchmark: DataFrame, n: int, slice_items: int) -> Iterator:
    """Broadcast seeds, slice by slice. At most the n-grams of one slice are in the driver."""
    for items in _slices(benchmark, slice_items):
        yield docs.sparkSession.sparkContext.broadcast(Seeds(items, n))


_PAIRS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("n_seeds", pa.int64()), ("from_word", pa.int64()), ("to_word", pa.int64())])
_PAIRS_SQL = "doc_id long, item_id long, score double, n_seeds long, from_word long, to_word long"


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.4, slice_items: int = 20_000) -> DataFrame:
    """(doc_id, item_id, score, n_seeds, from_word, to_word) of every document and item that align."""

    def finder(shared):
        def run(batches):
            seeds = shared.value
            for b in slices(batches):
                out = [(doc, *m) for doc, t in zip(b.column(0).to_pylist(), b.column(1)) for m in seeds.matches(t.as_py(), threshold)]
                if out:
                    yield batch(_PAIRS, zip(*out))

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for shared in all_seeds(docs, benchmark, n, slice_items):
        part = rows.mapInArrow(finder(shared), _PAIRS_SQL)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], _PAIRS_SQL)


def clean_documents(docs: DataFrame, benchmark: DataFrame, n: int = 3, threshold: float = 0.4, slice_items: int = 20_000) -> DataFrame:
    """The rows of docs that align with no item, with all their columns."""
    where = docs.columns.index("text")

    def cleaner(shared):
        def run(batches):
            seeds = shared.value
            for b in slices(batches):
                yield b.filter(pa.array([not seeds.matches(t.as_py(), threshold) for t in b.column(where)], pa.bool_()))

        return run

    out = docs
    for shared in all_seeds(docs, benchmark, n, slice_items):
        out = out.mapInArrow(cleaner(shared), docs.schema)
    return out
