"""Edit-aware token counts.

A document is kept as a sequence of pre-tokens under a segment tree: leaves are blocks of pre-tokens, every node holds
the characters and tokens below it. An edit finds its block by descending the tree, scans the text again only from the
last pre-token that could see the edit to the first boundary where the old and new scans meet, encodes what is new and
adds the difference to the sums on the path to the root.

Where scans meet: a pre-token depends on the text from its start to one character past the character that ends it, and
on nothing before. So pre-tokens that end two characters before an edit are safe, and two scans that share a boundary
behind the edit agree from there on.

Defined results: null texts are empty; null edits are none; positions beyond the text are moved to its end, lengths
are cut there; edits apply in order, each to the result of the one before; rows with a null id keep it and repeated
rows are counted each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.bpe import pre_tokens, vocabulary, vocabulary_bytes
from platewise.llm.common import batch, slices


class TokenTree:
    """Pre-tokens of one text, their token counts, and sums over blocks of them."""

    BLOCK = 64

    def __init__(self, text: str, count):
        self.count, self.encoded = count, 0
        pieces = pre_tokens(text)
        self.blocks = [pieces[i : i + self.BLOCK] for i in range(0, len(pieces), self.BLOCK)] or [[]]
        self.counts = [list(map(count, b)) for b in self.blocks]
        self._build()

    def _build(self) -> None:
        n = 1
        while n < len(self.blocks):
            n *= 2
        self.size = n
        self.chars, self.tokens = [0] * (2 * n), [0] * (2 * n)
        for i, (b, c) in enumerate(zip(self.blocks, self.counts)):
            self.chars[n + i], self.tokens[n + i] = sum(map(len, b)), sum(c)
        for i in range(n - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_pre_tokens(self) -> int:
        return sum(map(len, self.blocks))

    def text(self) -> str:
        return "".join(map("".join, self.blocks))

    def _find(self, pos: int) -> tuple[int, int]:
        """(block, its first character) of the block that holds position pos; the last block if it is the end."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if pos >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def _set(self, block: int) -> None:
        i = self.size + block
        chars = sum(map(len, self.blocks[block])) - self.chars[i]
        tokens = sum(self.counts[block]) - self.tokens[i]
        while i:
            self.chars[i] += chars
            self.tokens[i] += tokens
            i //= 2

    def edit(self, pos: int, delete: int, insert: str) -> None:
        total = self.chars[1]
        pos = min(max(pos, 0), total)
        delete = min(max(delete, 0), total - pos)
        # first pre-token that may change: the first that ends less than two characters before the edit
        b, start = self._find(max(0, pos - 2))
        k = 0
        while k < len(self.blocks[b]) and start + len(self.blocks[b][k]) + 2 <= pos:
            start += len(self.blocks[b][k])
            k += 1
        if k == len(self.blocks[b]) and b + 1 < len(self.blocks):
            b, k = b + 1, 0
        # old text from there on, taken block by block until the scans meet behind the edit
        end_b, end_k, taken, ends = b, k, [], []
        at, stop = start, pos + delete
        need = stop + 64
        while True:
            while end_b < len(self.blocks) and at < need:
                if end_k < len(self.blocks[end_b]):
                    piece = self.blocks[end_b][end_k]
                    at += len(piece)
                    taken.append(piece)
                    ends.append(at)
                    end_k += 1
                if end_k >= len(self.blocks[end_b]) and end_b + 1 <= len(self.blocks):
                    if end_b + 1 == len(self.blocks):
                        break
                    end_b, end_k = end_b + 1, 0
            whole = at >= total
            old = "".join(taken)
            new = old[: pos - start] + insert + old[stop - start :]
            pieces = pre_tokens(new)
            if whole:
                met_new, met_old = len(pieces), len(taken)
                break
            shift = len(insert) - delete
            old_ends = {e + shift: i for i, e in enumerate(ends)}
            place, met_new = start, None
            last_safe = at + shift - 2  # pieces nearer to the end may look beyond it
            for i, p in enumerate(pieces):
                place += len(p)
                if place > last_safe:
                    break
                if place >= stop + shift and place >= pos + len(insert) and place in old_ends:
                    met_new, met_old = i + 1, old_ends[place] + 1
                    break
            if met_new is not None:
                break
            need = at + max(256, at - start)
        fresh = pieces[:met_new]
        self.encoded += len(fresh)
        self._replace(b, k, met_old, fresh, list(map(self.count, fresh)))

    def _replace(self, b: int, k: int, gone: int, pieces: list[str], counts: list[int]) -> None:
        first = b
        block, block_counts = self.blocks[b], self.counts[b]
        here = min(gone, len(block) - k)
        block[k : k + here], block_counts[k : k + here] = pieces, counts
        gone -= here
        while gone:
            b += 1
            here = min(gone, len(self.blocks[b]))
            del self.blocks[b][:here], self.counts[b][:here]
            gone -= here
        if any(len(self.blocks[i]) > 4 * self.BLOCK or not self.blocks[i] for i in range(first, b + 1)):
            whole, sums = [], []
            for x, y in zip(self.blocks, self.counts):
                for i in range(0, len(x), self.BLOCK) if len(x) > 4 * self.BLOCK else (0,) if x else ():
                    size = self.BLOCK if len(x) > 4 * self.BLOCK else len(x)
                    whole.append(x[i : i + size])
                    sums.append(y[i : i + size])
            self.blocks, self.counts = whole or [[]], sums or [[]]
            self._build()
        else:
            for i in range(first, b + 1):
                self._set(i)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_tokens_edited", pa.int64()), ("n_pre_tokens", pa.int64()), ("n_reencoded", pa.int64())])


def edited_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, n_tokens_edited, n_pre_tokens, n_reencoded) of docs (doc_id, text, edits).

    edits: array<struct<pos long, del long, ins string>> in characters.
    """
    data = docs.sparkSession.sparkContext.broadcast(vocabulary_bytes(path))

    def run(batches):
        v = vocabulary(data.value)
        count = v.count
        for b in slices(batches):
            out: list[list[int]] = [[], [], [], []]
            for text, edits in zip(b.column(1), b.column(2).to_pylist()):
                tree = TokenTree(text.as_py() or "", count)
                out[0].append(tree.n_tokens)
                for e in edits or ():
                    if e is not None:
                        tree.edit(e["pos"] or 0, e["del"] or 0, e["ins"] or "")
                out[1].append(tree.n_tokens)
                out[2].append(tree.n_pre_tokens)
                out[3].append(tree.encoded)
            yield batch(_SCHEMA, (b.column(0), *out))
        v.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "edits").mapInArrow(
        run, "doc_id long, n_tokens long, n_tokens_edited long, n_pre_tokens long, n_reencoded long"
    )


#: What the query inserts, in turn.
INSERTS = (" token", "'s", "  ", "\n", "é9")


def scripted_edits(docs: DataFrame, edits: int = 3) -> DataFrame:
    """docs with an edit script that depends on the id and the length alone."""
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    inserts = F.array(*map(F.lit, INSERTS))
    steps = [
        F.struct(
            F.pmod(doc * 7919 + 104_729 * j, size + 1).alias("pos"),
            F.pmod(doc + 3 * j, F.lit(12)).alias("del"),
            F.element_at(inserts, (F.pmod(doc + j, F.lit(len(INSERTS))) + 1).cast("int")).alias("ins"),
        )
        for j in range(edits)
    ]
    return docs.select("doc_id", "text", F.array(*steps).alias("edits"))
