"""Alignment of two tokenizers' tokens on the bytes they share.

A text is encoded twice, by a byte-level BPE (A, given a space and the text) and by a piece model (B, which adds that space
itself). Both sequences of tokens end at byte offsets; one merge of the two sorted lists of ends tells everything: where
both end a group is cut, and between two neighbouring ends exactly one token of each side lies, which is a link. The two
pointers of the merge are kept as running counts of each side's ends, so a text is merged by a few array operations.

Words are merged once: where one space stands between two visible characters both sides end a token (A's pre-tokens hold a
space at their start only; of B's pieces that is checked when the model is read, else texts stay whole), so a text is the
row of its words, and its tokens, groups and links are theirs. The distinct words of a slice of about 1 MB of text are encoded
and merged together, and documents add up what their words have.

Plan: texts are aligned where they are read, inside mapInArrow, in blocks of a fixed number of characters. A block writes its
documents, each with its links as packed places in the block's list of pairs, and the list itself with the links of each
pair. Links are packed slice by slice, so a task holds arrays of one slice, not of a block. Spark sums the lists by pair, takes the highest count of each id of either side, and joins both back to the lists;
a block's list then meets the block's documents again. Pairs are added up within a block before anything is shuffled, so
a pair that all documents have is one row a block. Nothing is broadcast but the two vocabularies, whose size is checked.

Defined results: null and empty texts, and texts that a tokenizer does not give back byte for byte, have no tokens: zeros
and an empty digest. Strings of special tokens are plain text. A text longer than a block is a block of its own. Rows of
null or repeated ids are aligned each, and count each; an empty table gives an empty result; columns other than the id
and the text are ignored, so clashing names cannot disturb.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.bpe import vocabulary_bytes
from platewise.llm.common import batch, materialize, rows_of, slices
from platewise.llm.merges import Merges

#: Characters of text whose pairs are added up before they are shuffled.
BLOCK = 8 << 20
#: Characters of text whose words are merged together.
SLICE = 1 << 20

#: A space between two characters that no rule counts as white space or joins with a space.
_BETWEEN = re.compile("(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")


class Pieces:
    """The piece model: ids of a text, and the bytes of each id."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.bytes_of = []
        for i in range(self.model.piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes_of.append(bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-Fa-f]{2}>", piece) else piece.replace("▁", " ").encode())
        #: Whether no piece goes on behind the end of a word.
        self.by_word = all(re.fullmatch("▁*[^▁]*", self.model.id_to_piece(i)) for i in range(self.model.piece_size()))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def merged(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two-pointer merge of two rising lists of ends with the same last end.

    Returns the places of the a and b tokens of each link, and the number of the group of each a and of each b token.
    """
    both = np.concatenate((ends_a, ends_b))
    order = np.argsort(both, kind="stable")  # merges the two runs; of equal ends a comes first
    end, is_a = both[order], order < len(ends_a)
    passed_a, passed_b = np.cumsum(is_a), np.cumsum(~is_a)
    same = np.zeros(len(end), bool)
    same[1:] = end[1:] == end[:-1]  # the b end of a common end
    group = np.cumsum(same) - same
    step = ~np.append(same[1:], False)  # one of each distinct end
    link_a, link_b = (passed_a - 1 + ~is_a)[step], (passed_b - 1 + is_a)[step]
    link_a[same[step]] -= 1
    return link_a, link_b, group[is_a], group[~is_a]


class Words(NamedTuple):
    """What some texts are made of: words of each text, and by word whether both sides give it back, tokens, groups, text of
    its groups, and where its links begin (one place more at the end) in the list of linked pairs."""

    of: list[list[int]]
    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    said: list[str]
    start: np.ndarray
    pairs: np.ndarray


class Aligner:
    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = Merges(a), Pieces(b)
        self.a.REMEMBER = 16 << 20  # a slice's words stand beside it
        self.size_a = np.array([len(x) for x in self.a.bytes_of])
        self.size_b = np.array([len(x) for x in self.b.bytes_of])
        #: Decimal ids with what follows them: within a side, after the last of side a, after the last of side b.
        self.said = [f"{i}{c}" for c in ",|" for i in range(len(self.size_a))] + [f"{i}{c}" for c in ",;" for i in range(len(self.size_b))]

    def tokens(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides; none where there is no text or a side does not give the bytes back."""
        out = []
        for text, b in zip(texts, self.b.encode([t or "" for t in texts])):
            raw = b" " + (text or "").encode()
            if not text or b"".join(map(self.b.bytes_of.__getitem__, b)) != raw:
                out.append(None)
                continue
            packed = self.a.encode(" " + text)
            out.append((self.a.ids(packed).astype(np.int64), np.array(b, np.int64)) if self.a.decode(packed) == raw else None)
        return out

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return merged(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))

    def written(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> list[str]:
        """The groups as text, by token: ids of a, ids of b, a semicolon behind each group."""
        last_a, last_b = np.append(np.diff(group_a) > 0, True), np.append(np.diff(group_b) > 0, True)
        place = np.concatenate((a + len(self.size_a) * last_a, 2 * len(self.size_a) + b + len(self.size_b) * last_b))
        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        return list(map(self.said.__getitem__, place[order].tolist()))

    def words(self, texts: list[str]) -> Words:
        """Each distinct word of the texts encoded and merged once."""
        number: dict[str, int] = {}
        put = number.setdefault
        of = [[put(w, len(number)) for w in (_BETWEEN.split(t) if self.b.by_word else [t])] if t else [] for t in texts]
        words, bytes_b = list(number), self.b.bytes_of.__getitem__
        raw = [b" " + w.encode() for w in words]
        ids_b = self.b.encode(words)
        good = np.array([b"".join(map(bytes_b, b)) == r for b, r in zip(ids_b, raw)], bool)
        plain = np.array([w.isascii() for w in words], bool)  # these are split by a quicker rule
        kept = [np.flatnonzero(good & plain), np.flatnonzero(good & ~plain)]
        packed = [self.a.encode_together(" " + " ".join([words[i] for i in k])) if len(k) else b"" for k in kept]
        if any(self.a.decode(x) != b"".join([raw[i] for i in k]) for x, k in zip(packed, kept)):
            good &= [self.a.decode(self.a.encode(" " + w)) == r for w, r in zip(words, raw)]
            kept = [np.flatnonzero(good & plain), np.flatnonzero(good & ~plain)]
            packed = [self.a.encode_together(" " + " ".join([words[i] for i in k])) if len(k) else b"" for k in kept]
        kept = np.concatenate(kept)
        n_a, n_b, n_groups, n_links = np.zeros((4, len(words)), np.int64)
        said = [""] * len(words)
        if not len(kept):
            return Words(of, good, n_a, n_b, n_groups, said, np.zeros(len(words) + 1, np.int64), np.empty(0, np.int64))
        a = self.a.ids(b"".join(packed)).astype(np.int64)
        n_b[kept] = [len(ids_b[i]) for i in kept.tolist()]
        b = np.fromiter(chain.from_iterable([ids_b[i] for i in kept.tolist()]), np.int64)
        end = np.cumsum([len(raw[i]) for i in kept.tolist()])
        ends_a = np.cumsum(self.size_a[a])
        n_a[kept] = per = np.diff(np.searchsorted(ends_a, end, "right"), prepend=0)
        last = np.cumsum(per) - 1
        if (ends_a[last] != end).any():
            raise ValueError("a token of side A goes on behind the end of a word")
        link_a, link_b, group_a, group_b = self.align(a, b)
        n_groups[kept] = np.diff(group_a[last], prepend=-1)
        tokens, at = self.written(a, b, group_a, group_b), 0
        for i, n in zip(kept.tolist(), (n_a + n_b)[kept].tolist()):
            said[i] = "".join(tokens[at : at + n])
            at += n
        # links lie in the order of kept; by word they are dealt out again
        owner = kept[np.searchsorted(last, link_a)]
        n_links += np.bincount(owner, minlength=len(words))
        pairs = (a[link_a] << 32 | b[link_b])[np.argsort(owner, kind="stable")]
        return Words(of, good, n_a, n_b, n_groups, said, np.append(0, np.cumsum(n_links)), pairs)


_LOADED: dict[bytes, Aligner] = {}


def aligner(a: bytes, b: bytes) -> Aligner:
    """Built once in each worker process."""
    key = hashlib.sha256(a + b).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Aligner(a, b)
    return _LOADED[key]


#: kind 0 is a document with its links, kind 1 a pair of the block and its place there.
_WORK = "kind int, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary, pair long, place int, n long"
_WORK_ARROW = pa.schema([(name, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[kind]) for name, kind in (c.split() for c in _WORK.split(", "))])
_DOCS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
_SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_best_a long"


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one behind the other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


class _Block:
    """Documents with packed links, and the pairs of all of them in the order in which they came."""

    def __init__(self):
        self.docs: list[tuple] = []
        self.place: dict[int, int] = {}
        self.total = np.zeros(0, np.int64)
        self.held = 0
        self.pack = zstandard.ZstdCompressor(level=1).compress

    def add(self, al: Aligner, ids: list[int | None], texts: list[str]) -> None:
        w = al.words(texts)
        of = [x if w.good[x].all() else [] for x in w.of]
        doc, word = np.repeat(np.arange(len(of)), [len(x) for x in of]), np.fromiter(chain.from_iterable(of), np.int64)
        key, times = np.unique(doc * len(w.said) + word, return_counts=True) if len(word) else (word, word)
        doc, word = np.divmod(key, max(len(w.said), 1))
        sums = [np.bincount(doc, times * x[word], len(of)).astype(np.int64).tolist() for x in (w.n_a, w.n_b, w.n_groups, np.diff(w.start))]
        found, at = np.unique(w.pairs, return_inverse=True)
        put = self.place.setdefault
        at = np.array([put(p, len(self.place)) for p in found.tolist()], np.int64)[at]
        size = np.diff(w.start)[word]
        key = np.repeat(doc, size) << 32 | at[_ranges(w.start[word], size)]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        n = np.add.reduceat(np.repeat(times, size)[order], first) if len(first) else first
        key = key[first]
        place = key & 0xFFFFFFFF
        self.total = np.append(self.total, np.zeros(len(self.place) - len(self.total), np.int64)) + np.bincount(place, n, len(self.place)).astype(np.int64)
        cut = np.searchsorted(key, np.arange(len(of) + 1) << 32)
        for i, (doc_id, x, lo, hi) in enumerate(zip(ids, of, cut[:-1].tolist(), cut[1:].tolist())):
            said = hashlib.sha256("".join([w.said[k] for k in x])[:-1].encode()).hexdigest() if x else ""
            links = self.pack(np.concatenate((np.diff(place[lo:hi], prepend=0), n[lo:hi])).astype("<u4").tobytes())
            self.docs.append((doc_id, *(s[i] for s in sums), said, links))
        self.held += sum(map(len, texts))

    def batches(self, block: int) -> Iterator[pa.RecordBatch]:
        rows = len(self.docs)
        doc_id, n_a, n_b, n_groups, n_links, said, links = zip(*self.docs)
        zero = np.zeros(rows, np.int64)
        yield batch(_WORK_ARROW, (zero, zero + block, doc_id, n_a, n_b, n_groups, n_links, said, links, zero, zero, zero))
        pairs = np.fromiter(self.place, np.int64, len(self.place))
        for lo in range(0, len(pairs), 20_000):
            part = pairs[lo : lo + 20_000]
            zero = np.zeros(len(part), np.int64)
            yield batch(_WORK_ARROW, (zero + 1, zero + block, zero, zero, zero, zero, zero, [""] * len(part), [b""] * len(part), part, zero + lo + np.arange(len(part)), self.total[lo : lo + 20_000]))


def _align(files, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = aligner(*files.value)
        number = TaskContext.get().partitionId() << 24
        block, ids, texts, size = _Block(), [], [], 0
        for doc_id, text in rows_of(slices(batches, 200), "doc_id", "text"):
            ids.append(doc_id)
            texts.append(text or "")
            size += len(texts[-1])
            if size >= SLICE or block.held + size >= block_bytes or len(ids) >= 20_000:
                block.add(al, ids, texts)
                ids, texts, size = [], [], 0
                if block.held >= block_bytes:
                    yield from block.batches(number)
                    block, number = _Block(), number + 1
        if ids:
            block.add(al, ids, texts)
        if block.docs:
            yield from block.batches(number)
        al.a.forget()

    return run


def _score(docs: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """A block's documents and its pairs with their counts over all blocks."""
    _LOADED.clear()  # a worker that aligned before holds vocabularies that nothing here needs
    pairs = pairs.sort_values("place")
    counts, best_a, best_b = (pairs[c].to_numpy() for c in ("count", "best_a", "best_b"))
    unpack = zstandard.ZstdDecompressor().decompress
    out = []
    for data in docs["links"]:
        both = np.frombuffer(unpack(data), "<u4").astype(np.int64)
        place, n = np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]
        out.append((int(n[best_b[place]].sum()), int((n * counts[place]).sum()), int(n[best_a[place]].sum())) if len(n) else (0, 0, 0))
    out = pd.DataFrame(out, columns=["n_best", "count_sum", "n_best_a"], index=docs.index)
    return docs[_DOCS].astype({"doc_id": "Int64"}).join(out)[[c.split()[0] for c in _SCORED.split(", ")]]


def _work(docs: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str, block_bytes: int) -> DataFrame:
    files = docs.sparkSession.sparkContext.broadcast((vocabulary_bytes(a_path), vocabulary_bytes(b_path)))
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return materialize(docs.mapInArrow(_align(files, block_bytes), _WORK), compression="zstd")


def _counted(work: DataFrame) -> DataFrame:
    """(pair, count, best_a, best_b): links of each pair, and whether no pair of its a id, or b id, has more."""
    counts = work.where("kind = 1").groupBy("pair").agg(F.sum("n").alias("count"))
    side = {"a": F.shiftright("pair", 32), "b": F.col("pair").bitwiseAND(0xFFFFFFFF)}
    counts = counts.select("pair", "count", *[v.alias(k) for k, v in side.items()])
    for k in side:
        counts = counts.join(counts.groupBy(k).agg(F.max("count").alias(f"most_{k}")), k)
    return counts.select("pair", "a", "b", "count", *[(F.col("count") == F.col(f"most_{k}")).alias(f"best_{k}") for k in side])


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """One row for each document: tokens, groups and links, links that are the best of their b (or a) id, sum of counts."""
    work = _work(docs, a_path, b_path, id_col, text_col, block_bytes)
    asked = work.where("kind = 1").select(F.col("block").alias("home"), "pair", "place").join(_counted(work), "pair").select("home", "place", "count", "best_a", "best_b")
    return work.where("kind = 0").select("block", *_DOCS, "links").groupBy("block").cogroup(asked.groupBy("home")).applyInPandas(_score, _SCORED)


def pair_counts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, count, best_a, best_b): how often each pair of ids is linked in all documents."""
    return _counted(_work(docs, a_path, b_path, id_col, text_col, BLOCK)).drop("pair")


def groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, groups): the aligned groups of every document, each with its a and its b ids."""
    files = docs.sparkSession.sparkContext.broadcast((vocabulary_bytes(a_path), vocabulary_bytes(b_path)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        al = aligner(*files.value)
        for df in frames:
            out = []
            for found in al.tokens([t if isinstance(t, str) else None for t in df["text"]]):
                if found is None:
                    out.append([])
                    continue
                a, b = found
                _, _, group_a, group_b = al.align(a, b)
                cut_a, cut_b = np.flatnonzero(np.diff(group_a)) + 1, np.flatnonzero(np.diff(group_b)) + 1
                out.append([{"a": x.tolist(), "b": y.tolist()} for x, y in zip(np.split(a, cut_a), np.split(b, cut_b))])
            yield pd.DataFrame({"doc_id": df["doc_id"].astype("Int64"), "groups": out})

    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return docs.mapInPandas(run, "doc_id long, groups array<struct<a: array<int>, b: array<int>>>")
