"""Byte-level BPE by merge rules, as a tokenizer file (JSON) lists them: the two operators on token ids share it.

Merges are looked up by pairs of ids, as the rules are stated, so a pair whose joint bytes happen to be an entry without a
rule of its own is never merged. Ids are packed as little-endian 16- or 32-bit numbers, whichever holds the vocabulary.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from itertools import chain

import numpy as np
import pyarrow as pa

from platewise.llm.bpe import pre_tokens


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    own = set(plain)
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merges:
    """Vocabulary, merge rules and added tokens of a byte-level BPE file."""

    #: Bytes of pre-tokens remembered at most by one task; a full memory is emptied, which costs time only.
    REMEMBER = 48 << 20
    #: Bytes of pre-tokens that are merged without a heap; with two ends their places must fit five bits.
    SHORT = 24

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model, before = spec["model"], spec["pre_tokenizer"]
        odd = [a for a in spec.get("added_tokens", []) if a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"]]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or odd:
            raise ValueError("only plain byte-level BPE files are read")
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        vocab = model["vocab"]
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(map(byte_of.__getitem__, token))
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_strings = pa.array(self.bytes_of, pa.large_binary())
        self.decimal_strings = pa.array([b"%d," % i for i in range(size)], pa.large_binary())
        self.byte_id = [vocab[c] for c in _byte_letters()]
        self.rule: dict[int, tuple[int, int]] = {}  # left id and right id in one number -> (rank, merged id)
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rule[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.made = np.zeros(len(model["merges"]), np.int32)  # by rank
        for rank, i in self.rule.values():
            self.made[rank] = i
        self._place_rules()
        self.memory: dict[str, bytes] = {}
        self.held = 0

    def forget(self) -> None:
        self.memory.clear()
        self.held = 0

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token: always the lowest rule, the leftmost of equals."""
        ids = [self.byte_id[b] for b in data]
        return self._short(ids) if len(ids) <= self.SHORT else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        rule = self.rule
        found = [rule.get(a << 32 | b) for a, b in zip(ids, ids[1:])]
        while True:
            at, best = -1, None
            for i, x in enumerate(found):
                if x is not None and (best is None or x[0] < best[0]):
                    at, best = i, x
            if best is None:
                return ids
            ids[at : at + 2] = [best[1]]
            del found[at]
            if at < len(found):
                found[at] = rule.get(best[1] << 32 | ids[at + 1])
            if at:
                found[at - 1] = rule.get(ids[at - 1] << 32 | best[1])

    def _long(self, ids: list[int]) -> list[int]:
        """The same with a heap over linked ids."""
        n, rule = len(ids), self.rule
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(x[0], i, ids[i], ids[i + 1], x[1]) for i in range(n - 1) if (x := rule.get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, merged = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has changed since
            ids[i], ids[j] = merged, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if x := rule.get(merged << 32 | ids[k]):
                    heapq.heappush(heap, (x[0], i, merged, ids[k], x[1]))
            if (p := before[i]) >= 0 and (x := rule.get(ids[p] << 32 | merged)):
                heapq.heappush(heap, (x[0], p, ids[p], merged, x[1]))
        return [i for i in ids if i >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the rule of each pair; len(made) where there is none."""
        key = left.astype(np.int64) << 32 | right
        at = self._slots(key)
        held = self.slot_key[at]
        out = np.where(held == key, self.slot_rank[at], np.int32(len(self.made)))
        on = np.flatnonzero((held != key) & (held >= 0))
        while len(on):
            at[on] = at[on] + 1 & len(self.slot_key) - 1
            held = self.slot_key[at[on]]
            hit = held == key[on]
            out[on[hit]] = self.slot_rank[at[on[hit]]]
            on = on[~hit & (held >= 0)]
        return out

    def _slots(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - len(self.slot_key).bit_length())).astype(np.int64)

    def _place_rules(self) -> None:
        """Rules as arrays: a hash table that goes on at the next slot, and the ranks of all pairs of bytes."""
        none, keys = len(self.made), np.array(list(self.rule), np.int64)
        ranks = np.array([r for r, _ in self.rule.values()], np.int32)
        size = 2 << (2 * len(keys)).bit_length()
        self.slot_key, self.slot_rank = np.full(size, -1, np.int64), np.full(size, none, np.int32)
        at, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.slot_key[at[left]] < 0]
            self.slot_key[at[free]] = keys[free]  # of several keys at a slot one stays
            won = self.slot_key[at[left]] == keys[left]
            self.slot_rank[at[left[won]]] = ranks[left[won]]
            left = left[~won]
            at[left] = at[left] + 1 & size - 1
        self.letters = np.array(self.byte_id, np.int32)
        self.first = self._ranks(np.repeat(self.letters, 256), np.tile(self.letters, 256))

    def merge_together(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many short pre-tokens: in each round every one applies its lowest rule, the leftmost of equals.

        A column is a pre-token between two ends that no rule knows; its ids are linked, so that a merge moves nothing.
        """
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        out, none, end, width = [b""] * len(pieces), len(self.made), len(self.bytes_of), self.dtype.itemsize
        for lo in range(0, len(order), 4096):
            part = order[lo : lo + 4096]
            n, high = len(part), len(pieces[part[-1]]) + 2
            raw = np.frombuffer(b"".join([pieces[i].rjust(len(pieces[i]) + 1, b"\0").ljust(high, b"\0") for i in part]), np.uint8)
            raw = np.ascontiguousarray(raw.reshape(n, high).T)
            place = np.arange(high, dtype=np.int32)[:, None]
            inside = (place > 0) & (place <= np.array([len(pieces[i]) for i in part]))
            ids = np.where(inside, self.letters[raw], np.int32(end)).ravel()
            low = np.full((high, n), none << 5, np.int32)  # rank and place of each pair in one number
            pair = self.first[raw[:-1].astype(np.int32) << 8 | raw[1:]]
            low[:-1] = np.where(inside[:-1] & inside[1:], pair, np.int32(none)) << 5 | place[:-1]
            flat, after, before = low.ravel(), np.arange(n, high * n + n), np.arange(-n, high * n - n)
            while True:
                best = low.min(0)
                go = np.flatnonzero(best < none << 5)
                if not len(go):
                    break
                best = best[go]
                at = (best & 31) * np.int64(n) + go
                merged = self.made[best >> 5]
                gone = after[at]
                right, left = after[gone], before[at]
                ids[at], ids[gone], flat[gone] = merged, end, none << 5
                after[at], before[right] = right, at
                flat[at] = self._ranks(merged, ids[right]) << 5 | best & 31
                flat[left] = self._ranks(ids[left], merged) << 5 | (left // n).astype(np.int32)
            ids = ids.reshape(high, n).T
            real = ids < end
            data, at = ids[real].astype(self.dtype).tobytes(), 0
            for i, size in zip(part, (real.sum(1) * width).tolist()):
                out[i] = data[at : at + size]
                at += size
        return out

    def pack_together(self, texts: list[list[str]]) -> list[bytes]:
        """pack, for the pre-tokens of several texts: those that are new are merged together."""
        memory = self.memory
        new = [p for p in dict.fromkeys(chain.from_iterable(texts)) if p not in memory]
        raw = [p.encode() for p in new]
        short = [len(r) <= self.SHORT for r in raw]
        together = iter(self.merge_together([r for r, s in zip(raw, short) if s]))
        found = {p: next(together) if s else np.array(self.merge(r), self.dtype).tobytes() for p, r, s in zip(new, raw, short)}
        packed = [b"".join([memory.get(p) or found[p] for p in pieces]) for pieces in texts]
        for p, x in found.items():
            if len(p) <= 64:
                self.held += 230 + len(p)
                if self.held >= self.REMEMBER:
                    self.forget()
                memory[p] = x
        return packed

    def encode_together(self, text: str) -> bytes:
        """encode, for texts of many different pre-tokens."""
        return self.pack_together([pre_tokens_of_library(text)])[0]

    def piece(self, piece: str) -> bytes:
        """Packed ids of one pre-token."""
        found = self.memory.get(piece)
        if found is None:
            found = np.array(self.merge(piece.encode()), self.dtype).tobytes()
            if len(piece) <= 64:
                self.held += 230 + len(piece)
                if self.held >= self.REMEMBER:
                    self.forget()
                self.memory[piece] = found
        return found

    def pack(self, pieces: list[str]) -> bytes:
        memory, miss = self.memory, self.piece
        return b"".join([memory.get(p) or miss(p) for p in pieces])

    def encode(self, text: str) -> bytes:
        """Packed ids of a text without special tokens."""
        return self.pack(pre_tokens_of_library(text))

    def ids(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, self.dtype)

    def decode(self, packed: bytes) -> bytes:
        return _strung(self.byte_strings, self.ids(packed))

    def decimals(self, packed: bytes) -> bytes:
        """Decimal ids joined by commas."""
        return _strung(self.decimal_strings, self.ids(packed))[:-1]


def _strung(strings: pa.Array, at: np.ndarray) -> bytes:
    """The strings at these places, one after the other."""
    if not len(at):
        return b""
    _, ends, data = strings.take(pa.array(at)).buffers()
    return data[: int(np.frombuffer(ends, np.int64, len(at) + 1)[-1])].to_pybytes()


_SPLIT = None


def pre_tokens_of_library(text: str) -> list[str]:
    """Pre-tokens of a text. Beyond Latin-1, classes of new code points differ between Unicode versions, so there the
    tokenizers library itself splits."""
    global _SPLIT
    if text.isascii():
        return pre_tokens(text)
    try:
        text.encode("latin-1")
        return pre_tokens(text)
    except UnicodeEncodeError:
        pass
    if _SPLIT is None:
        from tokenizers.pre_tokenizers import ByteLevel

        _SPLIT = ByteLevel(add_prefix_space=False)
    return [text[a:b] for _, (a, b) in _SPLIT.pre_tokenize_str(text)]


_LOADED: dict[bytes, Merges] = {}


def merges(data: bytes) -> Merges:
    """Built once in each worker process."""
    key = hashlib.sha256(data).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Merges(data)
    return _LOADED[key]
