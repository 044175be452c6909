"""Language identification by prediction by partial matching.

Each language has a variable-order context tree over all 256 bytes. A context of up to `order` bytes holds the counts
of the bytes that followed it in that language; a byte it has not seen is reached by an escape to the context that is
one byte shorter (escape probability d / (t + d) for d distinct of t seen bytes, with the seen bytes excluded below),
at last to equal shares of the 256 bytes. Every context of the training texts is a node: no symbol is merged and no
node is cut. The statistics are frozen after training; a text is scored by the exact sum of its bytes' code lengths
under each language, and the shortest wins. Texts are lowered before they are read as UTF-8.

The frozen tree of a level is a sorted list of (context, byte) with code lengths and a sorted list of contexts with
the bits of their escape, so what was never seen costs no space: bits = escape of the context + bits one level below.

Training reads a bounded sample: of every language the `per_lang` documents that come first by a hash of their id,
texts longer than `max_bytes` characters last and cut there, and at most `max_total` bytes over all languages together
(with more languages, fewer texts of each). So the model that is broadcast has at most (order + 1) * max_total nodes,
whatever the corpus. Prediction reads every whole text.

Defined results: a null text, or one without a letter, is `und` with score 0; so is every text if no document teaches
a language. Equal code lengths go to the language that sorts first. Rows with a null id are predicted, never learned;
repeated rows are predicted each, and learned each if they are drawn; further columns, also clashing ones, are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.llm.common import batch, slices

UNDETERMINED = "und"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:256])) or any(map(str.isalpha, text))


def _padded(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with `order` zeros before each text, places of the texts' own bytes)."""
    zeros = b"\0" * order
    x = np.frombuffer(b"".join(zeros + t for t in texts), np.uint8)
    own = np.ones(len(x), np.bool_)
    start = np.cumsum([0, *[len(t) + order for t in texts[:-1]]]) if texts else np.empty(0, np.int64)
    for j in range(order):
        own[start + j] = False
    return x, np.flatnonzero(own)


def _keys(x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k bytes before each place and the byte there, as one number."""
    key = np.zeros(len(at), np.uint64)
    for j in range(k, -1, -1):
        key = key << np.uint64(8) | x[at - j].astype(np.uint64)
    return key


def _place(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, found) of each key."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.bool_)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


_BYTE = np.uint64(255)
_EIGHT = np.uint64(8)


class _Tree:
    """One language: for each level, bits of the seen (context, byte) and of the contexts' escapes."""

    def __init__(self, texts: list[bytes], order: int):
        x, at = _padded(texts, order)
        self.keys, self.bits, self.contexts, self.escape = [], [], [], []
        for k in range(order + 1):
            keys, n = np.unique(_keys(x, at, k), return_counts=True)
            contexts, first = np.unique(keys >> _EIGHT, return_index=True)
            d = np.diff(np.append(first, len(keys)))
            t = np.add.reduceat(n, first) if len(first) else n[:0]
            node = np.repeat(np.arange(len(contexts)), d)
            if k:  # what the seen bytes have one level below
                below = np.exp2(-self.bits[-1][np.searchsorted(self.keys[-1], self._shorter(keys, k))])
            else:
                below = np.full(len(keys), 1.0 / 256.0)
            left = 1.0 - (np.add.reduceat(below, first) if len(first) else below)
            full = d == 256  # nothing to escape to
            self.bits.append(-np.log2(n / np.where(full, t, t + d)[node]))
            with np.errstate(divide="ignore"):
                self.escape.append(np.where(full, np.inf, np.log2(np.maximum(left, 1e-15)) - np.log2(d / (t + d))))
            self.keys.append(keys)
            self.contexts.append(contexts)

    @staticmethod
    def _shorter(keys: np.ndarray, k: int) -> np.ndarray:
        """The same bytes after a context that is one byte shorter."""
        return keys & np.uint64((1 << (8 * k)) - 1)


class ContextTrees:
    """Frozen trees of all languages side by side."""

    def __init__(self, texts: dict[str, list[str]], order: int = 3):
        self.langs, self.order = sorted(texts), order
        trees = [_Tree([t.lower().encode() for t in texts[lang]], order) for lang in self.langs]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for k in range(order + 1 if trees else 0):
            keys = np.unique(np.concatenate([t.keys[k] for t in trees]))
            contexts = np.unique(np.concatenate([t.contexts[k] for t in trees]))
            bits, escape = np.empty((len(keys), len(trees))), np.zeros((len(contexts), len(trees)))
            below = self._bits(k - 1, _Tree._shorter(keys, k)) if k else np.full((len(keys), len(trees)), 8.0)
            for j, tree in enumerate(trees):
                at, known = _place(tree.contexts[k], contexts)
                escape[known, j] = tree.escape[k][at[known]]
                at, known = _place(tree.keys[k], keys)
                bits[known, j] = tree.bits[k][at[known]]
                rest = np.flatnonzero(~known)
                bits[rest, j] = escape[np.searchsorted(contexts, keys[rest] >> _EIGHT), j] + below[rest, j]
            self.levels.append((keys, bits.astype(np.float32), contexts, escape.astype(np.float32)))

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for level in self.levels for x in level)

    def _bits(self, k: int, keys: np.ndarray) -> np.ndarray:
        """Code lengths (a row for each key, a column for each language) of bytes after contexts of k bytes."""
        if k < 0:
            return np.full((len(keys), len(self.langs)), 8.0, np.float32)
        known_keys, bits, contexts, escape = self.levels[k]
        at, known = _place(known_keys, keys)
        if known.all():
            return bits[at]
        out = np.empty((len(keys), len(self.langs)), np.float32)
        out[known] = bits[at[known]]
        rest = np.flatnonzero(~known)
        more = self._bits(k - 1, _Tree._shorter(keys[rest], k))
        at, known = _place(contexts, keys[rest] >> _EIGHT)
        more[known] += escape[at[known]]
        out[rest] = more
        return out

    def code_lengths_of(self, texts: list[str], step: int = 1 << 18) -> np.ndarray:
        """Bits of each whole text under each language; texts are read side by side, `step` bytes at a time."""
        out = np.zeros((len(texts), len(self.langs)))
        if not self.langs or not texts:
            return out
        data = [t.lower().encode() for t in texts]
        x, at = _padded(data, self.order)
        owner = np.repeat(np.arange(len(data)), [len(d) for d in data])
        for i in range(0, len(at), step):
            bits = self._bits(self.order, _keys(x, at[i : i + step], self.order))
            of = owner[i : i + step]
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            out[of[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.float64)
        return out

    def code_lengths(self, text: str, step: int = 1 << 18) -> np.ndarray:
        return self.code_lengths_of([text], step)[0]

    def predict_all(self, texts: list[str | None], group: int = 1 << 20) -> list[tuple[str, float]]:
        """(language, score) of each text; texts go through in groups of some `group` characters."""
        out = [(UNDETERMINED, 0.0)] * len(texts)
        if not self.langs:
            return out
        held: list[int] = []
        size = 0

        def flush() -> None:
            bits = self.code_lengths_of([texts[i] for i in held])
            best = bits.argmin(1)
            less = bits[np.arange(len(held)), best][:, None] - bits
            score = 1.0 / np.exp2(np.maximum(less, -1000.0)).sum(1)
            for i, b, s in zip(held, best.tolist(), score.tolist()):
                out[i] = (self.langs[b], s)

        for i, t in enumerate(texts):
            if t and has_letter(t):
                held.append(i)
                size += len(t)
                if size >= group:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, per_lang: int, max_bytes: int, max_total: int) -> dict[str, list[str]]:
    """Texts to learn from. Only they reach the driver: max_total bytes of UTF-8 at most, times 4 for wide characters."""
    learns = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = learns.select("doc_id", "lang", (F.octet_length("text") > max_bytes).alias("long"))
    order = ["long", F.xxhash64("doc_id"), "doc_id"]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(16))).orderBy(*order)
    langs = max(1, rows.select("lang").distinct().count())
    n = max(1, min(per_lang, max_total // (max_bytes * langs)))
    few = rows.withColumn("k", F.row_number().over(salted)).where(F.col("k") <= n).drop("k")  # 16 n of a language at most
    chosen = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("k") <= n).select("doc_id", "lang").distinct()
    cut = learns.select("doc_id", "lang", F.substring("text", 1, max_bytes).alias("text"))
    out: dict[str, list[str]] = {}
    for lang, text in sorted(cut.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text").collect()):
        out.setdefault(lang, []).append(text)
    return {lang: texts[: 2 * n] for lang, texts in out.items()}


def train(docs: DataFrame, per_lang: int = 300, max_bytes: int = 32_768, max_total: int = 64 << 20, order: int = 3) -> ContextTrees:
    return ContextTrees(sample(docs, per_lang, max_bytes, max_total), order)


def predict(docs: DataFrame, model: ContextTrees) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        trees = shared.value
        for b in slices(batches):
            found = trees.predict_all(b.column(2).to_pylist())
            yield batch(_SCHEMA, (b.column(0), b.column(1), [x for x, _ in found], [y for _, y in found]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: ContextTrees) -> DataFrame:
    """The rows of docs with a language, with all their columns.

    A row is rejected if its text is null or has no letter, whatever the model: language and score decide nothing. So
    rows with letters stay also where no language was learned, though predict calls them undetermined.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    where = docs.columns.index("text")

    def run(batches):
        trees = shared.value
        for b in slices(batches):
            texts = b.column(where).to_pylist()
            stays = [x != UNDETERMINED for x, _ in trees.predict_all(texts)] if trees.langs else [bool(t) and has_letter(t) for t in texts]
            yield b.filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, per_lang: int = 300, max_bytes: int = 32_768, max_total: int = 64 << 20, order: int = 3) -> DataFrame:
    return predict(docs, train(docs, per_lang, max_bytes, max_total, order))
