"""Byte-level BPE encoding and decoding.

Two tiers. A minimal perfect hash over the vocabulary resolves every pre-token that is a vocabulary entry by one
probe and one comparison. Any other pre-token is merged by a heap of candidate pairs over a doubly linked list of
byte runs, so a run of n bytes costs O(n log n).

Defined results: null and empty texts have no tokens; a text of any length is encoded whole; special tokens do not
exist; rows with a null id keep it, and repeated rows are encoded each; an empty table gives an empty result; input
columns other than the id and the text are ignored, so clashing names cannot disturb the result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from platewise.llm.common import batch, slices

#: Pre-token pattern and the white space of its \s (Unicode White_Space).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPACE = "\\x09-\\x0d\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

_MASK = (1 << 64) - 1


def _latin1_pattern() -> re.Pattern:
    """The same pattern as explicit character classes for texts whose characters are all below U+0100."""
    kinds = {k: "".join(re.escape(chr(c)) for c in range(256) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    space = "\\x09-\\x0d\\x20\\x85\\xa0"
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{kinds['L']}]+| ?[{kinds['N']}]+| ?[^{space}{kinds['L']}{kinds['N']}]+|[{space}]+(?![^{space}])|[{space}]+")


_WIDE = regex.compile(PATTERN.replace("[^\\s", f"[^{SPACE}").replace("\\s", f"[{SPACE}]").replace("\\S", f"[^{SPACE}]"))
_NARROW = _latin1_pattern()


def pre_tokens(text: str) -> list[str]:
    if text.isascii():
        return _NARROW.findall(text)
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _WIDE.findall(text)
    return _NARROW.findall(text)


class PerfectHash:
    """Minimal perfect hash by hash-and-displace: n keys, n slots, one displacement for each bucket of keys.

    Buckets with several keys are placed first, each by the smallest displacement that puts all its keys on free
    slots; a bucket with one key then stores its slot directly, as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.m = m = max(1, n // 3)
        buckets: list[list[int]] = [[] for _ in range(m)]
        parts = [self._parts(k) for k in keys]
        for i, (a, _, _) in enumerate(parts):
            buckets[a % m].append(i)
        self.shift = shift = array("q", bytes(8 * m))
        self.slot_key: list[bytes | None] = [None] * n
        self.slot_value = array("i", [-1]) * n
        for b in sorted((b for b in range(m) if len(buckets[b]) > 1), key=lambda b: -len(buckets[b])):
            d = 0
            while True:
                slots = {self._slot(parts[i], d) for i in buckets[b]}
                if len(slots) == len(buckets[b]) and all(self.slot_key[s] is None for s in slots):
                    break
                d += 1
                if d > 1 << 22:
                    raise ValueError("equal keys cannot be hashed perfectly")
            shift[b] = d
            for i in buckets[b]:
                s = self._slot(parts[i], d)
                self.slot_key[s], self.slot_value[s] = keys[i], i
        free = iter([s for s in range(n) if self.slot_key[s] is None])
        for b in range(m):
            if len(buckets[b]) == 1:
                s = next(free)
                shift[b] = -s - 1
                self.slot_key[s], self.slot_value[s] = keys[buckets[b][0]], buckets[b][0]

    @staticmethod
    def _parts(key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return h & 0xFFFFFFFF, (h >> 32) & 0xFFFFFFFF, (h >> 64) & 0xFFFFFFFF

    def _slot(self, parts: tuple[int, int, int], d: int) -> int:
        return (((parts[1] + d * 0x9E3779B97F4A7C15) * (parts[2] | 1) & _MASK) >> 24) % self.n

    def find(self, key: bytes) -> int:
        """The key's index in the list it was built from, or -1."""
        if not self.n:
            return -1
        parts = self._parts(key)
        d = self.shift[parts[0] % self.m]
        s = -d - 1 if d < 0 else self._slot(parts, d)
        return self.slot_value[s] if self.slot_key[s] == key else -1


class Vocabulary:
    """Ranks of a rank file (lines of base64 token and rank) behind the two tiers.

    The perfect hash answers for whole pre-tokens. The heap looks up millions of pairs, for which a plain table over the
    same byte strings is several times faster in Python and costs some 3 MB.
    """

    #: Bytes of pre-tokens remembered at most by one task; a full memory is emptied, which costs time only.
    REMEMBER = 32 << 20

    def __init__(self, data: bytes):
        pairs = [line.split() for line in data.splitlines() if line.strip()]
        tokens = [base64.b64decode(a) for a, _ in pairs]
        self.ids = array("i", [int(b) for _, b in pairs])
        self.whole = PerfectHash(tokens)
        self.rank = dict(zip(tokens, self.ids))
        self.by_id: list[bytes | None] = [None] * (max(self.ids, default=-1) + 1)
        for i, t in zip(self.ids, tokens):
            self.by_id[i] = t
        self.memory: dict[str, str] = {}
        self.held = 0

    def forget(self) -> None:
        """Empties the memory of pre-tokens, as at the end of a task."""
        self.memory.clear()
        self.held = 0

    def piece(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        i = self.whole.find(data)
        return [self.ids[i]] if i >= 0 else self.merge(data)

    def merge(self, data: bytes) -> list[int]:
        """Heap over linked bytes: always the lowest-ranked adjacent pair, the leftmost of equals."""
        n, rank = len(data), self.rank
        end = list(range(1, n + 1))  # end of the run that begins here; 0 once it is swallowed
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two runs has changed since
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank.get(data[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := rank.get(data[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(rank[data[i : end[i]]])
            i = end[i]
        return out

    def _ids_text(self, piece: str) -> str:
        found = self.memory.get(piece)
        if found is None:
            found = " ".join(map(str, self.piece(piece.encode())))
            if len(piece) <= 64:
                self.held += 210 + 2 * len(piece)  # two strings and their place in the table
                if self.held >= self.REMEMBER:
                    self.forget()
                self.memory[piece] = found
        return found

    def encode_text(self, text: str) -> str:
        """Decimal ids joined by one space."""
        memory, miss = self.memory, self._ids_text
        return " ".join([memory.get(p) or miss(p) for p in pre_tokens(text)])

    def encode_array(self, text: str) -> np.ndarray:
        joined = self.encode_text(text)
        return np.fromstring(joined, np.int32, sep=" ") if joined else np.empty(0, np.int32)

    def encode(self, text: str) -> list[int]:
        return self.encode_array(text).tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids))

    def count(self, piece: str) -> int:
        return self._ids_text(piece).count(" ") + 1 if piece else 0


_LOADED: dict[bytes, Vocabulary] = {}


def vocabulary(data: bytes) -> Vocabulary:
    """Built once in each worker process."""
    key = hashlib.sha256(data).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(data)
    return _LOADED[key]


def vocabulary_bytes(path: str, limit: int = 64 << 20) -> bytes:
    """The rank file, read on the driver. Its size is checked as it is broadcast to every worker."""
    with open(path, "rb") as f:
        data = f.read(limit + 1)
    if len(data) > limit:
        raise ValueError(f"{path} is larger than {limit} bytes")
    return data


_ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every text, in order."""
    data = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))

    def run(batches):
        v = vocabulary(data.value)
        for b in slices(batches):
            yield batch(_ENCODED, (b.column(0), [v.encode_array(t.as_py() or "") for t in b.column(1)]))
        v.forget()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, data): the bytes that the ids stand for; null ids count as none."""
    data = encoded.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))
    schema = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])

    def run(batches):
        v = vocabulary(data.value)
        for b in slices(batches):
            yield batch(schema, (b.column(0), [v.decode(x.as_py() or []) for x in b.column(1)]))

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) in one pass: encodes, then decodes the ids it got.

    The ids stay in the worker; only digests leave it. Decoding starts from the decimal ids, not from the text.
    """
    data = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))

    def run(batches):
        v = vocabulary(data.value)
        sha = hashlib.sha256
        for b in slices(batches):
            n, ids_sha, out_sha = [], [], []
            for t in b.column(1):
                joined = v.encode_text(t.as_py() or "")
                ids = np.fromstring(joined, np.int32, sep=" ") if joined else ()
                n.append(len(ids))
                ids_sha.append(sha(joined.encode()).hexdigest())
                out_sha.append(sha(v.decode(ids)).hexdigest())
            yield batch(_DIGEST, (b.column(0), n, ids_sha, out_sha))
        v.forget()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

