"""BPE encoding that encodes content-defined chunks once and repairs the joins.

A rolling hash over the last 32 bytes cuts texts where the content says so, so equal passages of different documents fall
into equal chunks. Chunks that occur more than once in the corpus are encoded once, wherever else they stand; the rest
of a text is encoded where it was read. A text's segments are then joined in order. Around a join the pre-tokens are cut
anew, from the last boundary that nothing beyond the join could have moved, until a boundary agrees with one of the next
segment's own; the pattern never looks back, so from there on that segment's ids are those of the whole text. If none agrees,
the segment is cut anew as a whole and the search goes on in the next one. Results are thus exact, not approximate.

Plan: one scan counts chunk digests (a few bytes for each chunk, summed before the shuffle). Those found twice or more set bits
in a filter of fixed size, made in Spark, so what is broadcast does not grow. The second scan encodes all chunks the filter does not know,
and finishes the texts that hold none it knows; the others are written as segments of ids and references, with the text
of a referenced chunk once for each task. Texts of equal digest are encoded once, references meet their ids in one join, and
segments meet by text in a sorted stream, one segment in memory at a time. A false positive of the filter sends a lone
chunk along, and a full filter sends all; both cost traffic only. A passage of a third of all documents is one encoded
row on one side of the join, and its references, which are small, are split by adaptive execution. Equal texts of one
task share one set of segments.

Defined results: null and empty texts have no ids; texts of any length are encoded whole; strings of special tokens in a
text become those tokens, as the library does by default; rows of null or repeated ids are encoded each; an empty table
gives an empty result; columns other than the id and the text are ignored, so clashing names cannot disturb.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm.bpe import vocabulary_bytes
from platewise.llm.common import batch, materialize, slices
from platewise.llm.merges import Merges, merges, pre_tokens_of_library

#: Shortest chunk, bits that are zero at a cut (mean distance 2^bits) and longest chunk.
LEAST, BITS, MOST = 192, 9, 8192
#: Bits of the filter of shared chunks.
FILTER_BITS = 1 << 27
#: Characters at the end of a piece of text whose boundaries may still move: the pattern looks two ahead at most.
LOOK = 3
#: Bytes of text whose new pre-tokens are merged together; a longer text is taken by itself.
TOGETHER = 1 << 20


def _gear() -> np.ndarray:
    """A pseudo-random number for each byte, from its digest."""
    return np.array([int.from_bytes(hashlib.blake2b(bytes([b]), digest_size=4).digest(), "little") for b in range(256)], np.uint32)


_GEAR = _gear()


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a text, in bytes and at character boundaries."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    raw = np.frombuffer(data, np.uint8)
    h = _GEAR[raw]
    for s in (1, 2, 4, 8, 16):  # a sum over the last 32 bytes, each shifted by its distance
        h[s:] = h[s:] + (h[:-s] << np.uint32(s))
    found = np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1
    out, last = [], 0
    for at in [*found.tolist(), n]:
        while at - last > MOST:
            last = _whole(raw, last + MOST)
            out.append(last)
        if at - last >= LEAST and at < n:
            at = _whole(raw, at)
            if last < at < n:
                out.append(at)
                last = at
    out.append(n)
    return [e for i, e in enumerate(out) if not i or e > out[i - 1]]


def _whole(raw: np.ndarray, at: int) -> int:
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def chunk_digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


class Cutter:
    """Sections between special tokens, and the chunks of each."""

    def __init__(self, m: Merges):
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(m.special, key=len, reverse=True))) + ")") if m.special else None

    def sections(self, text: str) -> list[str]:
        """Plain sections at even places, special tokens at odd ones."""
        return self.special.split(text) if self.special else [text]


def chunks(data: bytes) -> list[bytes]:
    ends = cuts(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


# ---------------------------------------------------------------- segments


#: A segment is a head, then packed ids. The head is the number of ids after the last safe boundary, or HARD.
_HEAD = np.dtype("<u4")
HARD = 0xFFFFFFFF


def segments(m: Merges, texts: list[str]) -> list[bytes]:
    """Stretches of text, each encoded by itself, with the number of ids at its end that a later text may change."""
    out, cut = [], [pre_tokens_of_library(t) for t in texts]
    for pieces, packed in zip(cut, m.pack_together(cut)):
        at, left = len(pieces), LOOK
        while at and left > 0:
            at -= 1
            left -= len(pieces[at])
        tail = len(m.pack(pieces[at:])) // m.dtype.itemsize
        out.append(np.array([tail], _HEAD).tobytes() + packed)
    return out


def segment(m: Merges, text: str) -> bytes:
    return segments(m, [text])[0]


def special_segment(m: Merges, token: str) -> bytes:
    return np.array([HARD], _HEAD).tobytes() + np.array([m.special[token]], m.dtype).tobytes()


class Joiner:
    """Joins the segments of one text."""

    def __init__(self, m: Merges):
        self.m, self.out, self.carry = m, [], ""

    def _boundaries(self, text: str) -> tuple[list[str], list[int]]:
        """Pre-tokens and their ends, without those that what follows the text could change."""
        pieces, ends, at = pre_tokens_of_library(text), [], 0
        for p in pieces:
            at += len(p)
            if at > len(text) - LOOK:
                break
            ends.append(at)
        return pieces[: len(ends)], ends

    def add(self, data: bytes) -> None:
        m, width = self.m, self.m.dtype.itemsize
        tail, packed = int(np.frombuffer(data, _HEAD, 1)[0]), data[_HEAD.itemsize :]
        if tail == HARD:
            self.flush()
            self.out.append(packed)
            return
        safe, taken = len(packed) - tail * width, 0
        if self.carry:
            text = m.decode(packed).decode()
            window = 64
            while True:
                at = self._agreement(text[:window], packed, safe)
                if at is not None or window >= len(text):
                    break
                window *= 4
            if at is None:  # cut anew as a whole
                joined = self.carry + text
                pieces, ends = self._boundaries(joined)
                self.out.append(m.pack(pieces))
                self.carry = joined[ends[-1] if ends else 0 :]
                return
            taken = at
        self.out.append(packed[taken:safe])
        self.carry = m.decode(packed[safe:]).decode()

    def _agreement(self, head: str, packed: bytes, safe: int) -> int | None:
        """Packed length of the segment's ids before the first boundary that both sides share; emits what comes before."""
        m, c = self.m, len(self.carry)
        own, at, size = {0: 0}, 0, 0
        for p, e in zip(*self._boundaries(head)):
            size += len(m.piece(p))
            if size > safe:
                break
            own[e] = size
        pieces, ends = self._boundaries(self.carry + head)
        for at, e in enumerate(ends):
            if e >= c and e - c in own:
                self.out.append(m.pack(pieces[: at + 1]))
                return own[e - c]
        return None

    def flush(self) -> None:
        if self.carry:
            self.out.append(self.m.encode(self.carry))
            self.carry = ""

    def ids(self) -> bytes:
        self.flush()
        return b"".join(self.out)


# ---------------------------------------------------------------- scans


def _long(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


_COUNT = pa.schema([("h", pa.int64()), ("n", pa.int64())])
#: What the second scan writes, by kind: 0 document and its text's key, 1 result of a key, 2 segment, 3 reference, 4 chunk.
_WORK = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("key", pa.int64()), ("seq", pa.int64()), ("digest", pa.binary()), ("data", pa.binary()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32()))])
_WORK_DDL = "kind int, doc_id long, key long, seq long, digest binary, data binary, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"
_RESULT = pa.schema([f for f in _WORK if f.name in ("key", "n_tokens", "ids_sha256", "decoded_sha256", "ids")])
_RESULT_DDL = "key long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>"


def _count(path_data, limit: int = 400_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(path_data.value)
        cutter, held = Cutter(m), {}
        for b in slices(batches):
            for t in b.column(0):
                for i, part in enumerate(cutter.sections(t.as_py() or "")):
                    if not i % 2:
                        for c in chunks(part.encode()):
                            h = _long(chunk_digest(c))
                            held[h] = held.get(h, 0) + 1
            if len(held) > limit:
                yield batch(_COUNT, (held.keys(), held.values()))
                held = {}
        if held:
            yield batch(_COUNT, (list(held.keys()), list(held.values())))

    return run


class Filter:
    """Bloom filter of two bits a key, from its non-zero words."""

    def __init__(self, words: bytes, values: bytes, bits: int):
        self.bits, self.table = bits, np.zeros(bits >> 6, np.uint64)
        self.table[np.frombuffer(words, np.int64)] = np.frombuffer(values, np.int64).view(np.uint64)

    def may_hold(self, h: int) -> bool:
        a, b = h & (self.bits - 1), (h >> 32) & (self.bits - 1)
        t = self.table
        return bool(int(t[a >> 6]) >> (a & 63) & 1 and int(t[b >> 6]) >> (b & 63) & 1)


def shared_filter(docs: DataFrame, data, bits: int = FILTER_BITS) -> tuple[bytes, bytes, int]:
    """The words of the filter of all chunks that occur more than once: at most bits / 64 of them reach the driver."""
    counted = docs.select("text").mapInArrow(_count(data), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    places = counted.select(F.explode(F.array(F.expr(f"h & {bits - 1}L"), F.expr(f"shiftright(h, 32) & {bits - 1}L"))).alias("at"))
    words = places.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("v")).toArrow()
    return words["w"].to_numpy().astype(np.int64).tobytes(), words["v"].to_numpy().astype(np.int64).tobytes(), bits


def _finished(m: Merges, packed: bytes, keep_ids: bool) -> tuple:
    ids = m.ids(packed)
    return (len(ids), hashlib.sha256(m.decimals(packed)).hexdigest(), hashlib.sha256(m.decode(packed)).hexdigest(), ids.tolist() if keep_ids else None)


def _split(data, filter_data, keep_ids: bool, limit: int = 100_000):
    """The second scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(data.value)
        known = Filter(*filter_data.value)
        cutter = Cutter(m)
        key = TaskContext.get().partitionId() << 40
        keys: dict[bytes, int] = {}  # texts of this task by digest
        sent: set[bytes] = set()  # chunks of this task whose text is written
        rows: list[tuple] = []
        held: list[tuple[int, list[tuple], bool]] = []  # texts whose own chunks are still to be encoded
        size = 0

        def settle() -> pa.RecordBatch:
            whole = [[pre_tokens_of_library(x[1].decode()) for x in parts if x[0] == 5] for _, parts, shared in held if not shared]
            whole = iter(m.pack_together(list(chain.from_iterable(whole))))
            own = iter(segments(m, [x[1].decode() for _, parts, shared in held if shared for x in parts if x[0] == 5]))
            for key, parts, shared in held:
                if not shared:
                    packed = b"".join([next(whole) if x[0] == 5 else x[1][_HEAD.itemsize :] for x in parts])
                    rows.append((1, None, key, None, None, None, *_finished(m, packed, keep_ids)))
                    continue
                for seq, x in enumerate(parts):
                    if x[0] == 3:
                        rows.append((3, None, key, seq, x[1], *[None] * 5))
                        if x[1] not in sent:
                            if len(sent) >= 4 * limit:
                                sent.clear()
                            sent.add(x[1])
                            rows.append((4, None, None, None, x[1], x[2], *[None] * 4))
                    else:
                        rows.append((2, None, key, seq, None, next(own) if x[0] == 5 else x[1], *[None] * 4))
            out = batch(_WORK, zip(*rows))
            rows.clear()
            held.clear()
            return out

        for b in slices(batches):
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py() or ""
                raw = text.encode()
                digest = chunk_digest(raw)
                if digest in keys:
                    rows.append((0, doc_id, keys[digest], *[None] * 7))
                    continue
                if len(keys) >= limit:
                    keys.clear()
                key += 1
                keys[digest] = key
                rows.append((0, doc_id, key, *[None] * 7))
                parts, shared = [], False
                for i, section in enumerate(cutter.sections(text)):
                    if i % 2:
                        parts.append((2, special_segment(m, section)))
                        continue
                    own: list[bytes] = []
                    for c in chunks(section.encode()):
                        d = chunk_digest(c)
                        if known.may_hold(_long(d)):
                            if own:
                                parts.append((5, b"".join(own)))
                                own = []
                            parts.append((3, d, c))
                            shared = True
                        else:
                            own.append(c)
                    if own:
                        parts.append((5, b"".join(own)))
                held.append((key, parts, shared))
                size += len(raw)
                if size >= TOGETHER:
                    yield settle()
                    size = 0
            if rows:
                yield settle()
                size = 0
        m.forget()

    return run


def _encode_chunks(data):
    schema = pa.schema([("digest", pa.binary()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(data.value)
        for b in slices(batches):
            yield batch(schema, (b.column(0), segments(m, [c.as_py().decode() for c in b.column(1)])))
        m.forget()

    return run


def _join(data, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(data.value)
        key, joiner, done = None, None, []
        for b in slices(batches):
            for k, part in zip(b.column(0).to_pylist(), b.column(1)):
                if k != key:
                    if joiner is not None:
                        done.append((key, *_finished(m, joiner.ids(), keep_ids)))
                    key, joiner = k, Joiner(m)
                joiner.add(part.as_py())
            if done:
                yield batch(_RESULT, zip(*done))
                done = []
        if joiner is not None:
            yield batch(_RESULT, zip((key, *_finished(m, joiner.ids(), keep_ids))))
        m.forget()

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids): every text by the tokenizer file at path.

    The digests are of decimal ids joined by commas, and of the bytes that the ids decode to. ids is null unless kept.
    """
    spark: SparkSession = docs.sparkSession
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    data = spark.sparkContext.broadcast(vocabulary_bytes(path))
    known = spark.sparkContext.broadcast(shared_filter(docs, data, filter_bits))
    work = materialize(docs.mapInArrow(_split(data, known, keep_ids), _WORK_DDL), compression="zstd")
    texts = work.where("kind = 4").groupBy("digest").agg(F.min("data").alias("data"))
    encoded = texts.mapInArrow(_encode_chunks(data), "digest binary, data binary")
    found = work.where("kind = 3").select("key", "seq", "digest").join(encoded, "digest").select("key", "seq", "data")
    parts = work.where("kind = 2").select("key", "seq", "data").unionByName(found)
    ordered = parts.repartition("key").sortWithinPartitions("key", "seq").select("key", "data")
    results = work.where("kind = 1").select(*_RESULT.names).unionByName(ordered.mapInArrow(_join(data, keep_ids), _RESULT_DDL))
    return work.where("kind = 0").select("doc_id", "key").join(results, "key").drop("key")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text): the text that the ids stand for, special tokens included; null ids count as none."""
    data = encoded.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches):
        m = merges(data.value)
        for b in slices(batches):
            yield batch(schema, (b.column(0), [b"".join(map(m.bytes_of.__getitem__, x.as_py() or [])).decode("utf-8", "replace") for x in b.column(1)]))

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256); the ids stay in the workers."""
    return encode(docs, path, id_col, text_col, keep_ids=False).drop("ids")
