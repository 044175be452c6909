"""Line deduplication over range-partitioned line hashes.

Every eligible line becomes (128-bit hash of its key, document, positions): one row for each key and document, so a
line repeated within a document is combined before the shuffle. The rows are range-partitioned by (hash, document)
and sorted by hash, then document from the largest down. A stream over each partition meets the document that keeps
the line first and drops the line from those after it. As the range also covers the document, a line held by a third
of all documents spreads over many partitions; only the first and last run of a partition can cross its borders, and
those are settled by a table of at most two rows for each partition.

What comes back is, for each document that loses a line, a compressed bitmap of the lines it keeps, not the text.

Defined results: null and empty texts are one empty line; a key shorter than `min_chars` code points never goes;
documents are told apart by id, and repeated rows of one id count once; rows with a null id are one document that
sorts below all others; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from platewise.llm.common import WS, batch, materialize

_LINES = pa.schema([("hi", pa.int64()), ("lo", pa.int64()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("n_lines", pa.int64()), ("at", pa.binary())])
_LINES_SQL = "hi long, lo long, doc_id long, mark long, n_lines long, at binary"
_DECIDED = pa.schema([("kind", pa.string()), *_LINES])
_DECIDED_SQL = "kind string, " + _LINES_SQL
_MAPS = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("keep", pa.binary())])
_MAPS_SQL = "doc_id long, mark long, n_lines long, n_dropped long, keep binary"


def line_key(line: str) -> str:
    """The key as text; A-Z is lowered when it is encoded."""
    return line.strip(WS)


def hashed_lines(text: str, min_chars: int) -> tuple[int, dict[bytes, list[int]]]:
    lines = text.split("\n")
    found: dict[bytes, list[int]] = {}
    for i, line in enumerate(lines):
        if len(line) >= min_chars and len(key := line.strip(WS)) >= min_chars:
            found.setdefault(xxhash.xxh3_128_digest(key.encode().lower()), []).append(i)
    return len(lines), found


def _line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    def run(batches):
        for b in batches:
            ids, marks = b.column(0).to_pylist(), b.column(1).to_pylist()
            out: list[list] = [[], [], [], [], [], []]
            for doc, mark, text in zip(ids, marks, b.column(2)):
                n, found = hashed_lines(text.as_py() or "", min_chars)
                for h, at in found.items():
                    out[0].append(int.from_bytes(h[:8], "big", signed=True))
                    out[1].append(int.from_bytes(h[8:], "big", signed=True))
                    out[2].append(doc)
                    out[3].append(mark)
                    out[4].append(n)
                    out[5].append(np.array(at, np.uint32).tobytes())
            yield batch(_LINES, out)

    return docs.select("doc_id", "mark", "text").mapInArrow(run, _LINES_SQL)


def stream_decisions(rows: Iterator[tuple], min_docs: int) -> Iterator[tuple]:
    """(kind, *row) over one sorted partition. Rows: (hi, lo, doc_id, mark, n_lines, at).

    kind `drop`: the line goes. `open`: the run touches the partition's border and is settled later. `tail`: only a
    count of the documents (n_lines) and the largest id of a last run of which rows have been dropped already.
    """
    run, first, docs, top, last, held = None, True, 0, None, None, []
    n_runs = 0
    for row in rows:
        if run != row[:2]:
            if run is not None:
                first = False
            run, docs, top, last, held = row[:2], 0, row[2], object(), []
            n_runs += 1
        if first:
            yield ("open", *row)
            continue
        if row[2] != last:
            docs, last = docs + 1, row[2]
        if row[2] == top:
            held.append(row)  # it stays, unless the run is open at the end
        elif docs < min_docs:
            held.append(row)
        else:
            for x in held:
                if x[2] != top:
                    yield ("drop", *x)
            held = []
            yield ("drop", *row)
    if run is not None and not first:
        if docs < min_docs:
            for x in held:
                yield ("open", *x)
        else:
            yield ("tail", *run, top, None, docs, None)


def _decide(lines: DataFrame, min_docs: int) -> DataFrame:
    def run(batches):
        def rows():
            for b in batches:
                yield from zip(*(c.to_pylist() for c in b.columns))

        out: list[tuple] = []
        for x in stream_decisions(rows(), min_docs):
            out.append(x)
            if len(out) == 20_000:
                yield batch(_DECIDED, zip(*out))
                out = []
        if out:
            yield batch(_DECIDED, zip(*out))

    ranged = lines.repartitionByRange("hi", "lo", F.col("doc_id").desc()).sortWithinPartitions("hi", "lo", F.col("doc_id").desc())
    return ranged.mapInArrow(run, _DECIDED_SQL)


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, mark, n_lines, n_dropped, keep) of the documents that lose lines.

    docs: doc_id long, mark long, text; mark tells rows of one id apart (a hash of the text). keep: zlib of packed
    bits, bit i set if line i stays.
    """
    decided = materialize(_decide(_line_rows(docs, min_chars), min_docs))
    edge = decided.where("kind <> 'drop'")
    counts = edge.where("kind = 'open'").select("hi", "lo", "doc_id").distinct().select("hi", "lo", F.lit(1).cast("long").alias("n"), "doc_id")
    counts = counts.unionByName(edge.where("kind = 'tail'").select("hi", "lo", F.col("n_lines").alias("n"), "doc_id"))
    settled = counts.groupBy("hi", "lo").agg(F.sum("n").alias("n"), F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("rows"), F.count("doc_id").alias("ids"))
    # two runs for each partition at most: small whatever the input
    late = edge.where("kind = 'open'").join(F.broadcast(settled.where(F.col("n") >= min_docs)), ["hi", "lo"]).where("not (doc_id <=> top)")
    drops = decided.where("kind = 'drop'").select("doc_id", "mark", "n_lines", "at").unionByName(late.select("doc_id", "mark", "n_lines", "at"))
    lists = drops.groupBy("doc_id", "mark", "n_lines").agg(F.collect_list("at").alias("at"))

    def run(batches):
        for b in batches:
            ids, marks, sizes, ats = (c.to_pylist() for c in b.columns)
            gone, maps = [], []
            for n, at in zip(sizes, ats):
                bits = np.ones(n, np.bool_)
                bits[np.frombuffer(b"".join(at), np.uint32)] = False
                gone.append(int(n - bits.sum()))
                maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
            yield batch(_MAPS, (ids, marks, sizes, gone, maps))

    return lists.mapInArrow(run, _MAPS_SQL)


def read_bitmap(keep: bytes, n_lines: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines).astype(np.bool_)


def with_mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def apply_bitmaps(docs: DataFrame, maps: DataFrame, digest_only: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text or kept_sha256) of all rows of docs (doc_id, mark, text)."""
    maps = maps.select(F.col("doc_id").alias("m_id"), F.col("mark").alias("m_mark"), F.col("n_lines").alias("m_lines"), "keep")
    both = docs.join(maps, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("mark") == F.col("m_mark")), "left")
    name = "kept_sha256" if digest_only else "text"
    schema = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), (name, pa.string())])

    def run(batches):
        for b in batches:
            lines, gone, texts = [], [], []
            for text, n, keep in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist()):
                text = text.as_py()
                if keep is None:
                    lines.append(text.count("\n") + 1)
                    gone.append(0)
                else:
                    stays = read_bitmap(keep, n)
                    lines.append(n)
                    gone.append(int(n - stays.sum()))
                    text = "\n".join([x for x, k in zip(text.split("\n"), stays.tolist()) if k])
                texts.append(hashlib.sha256(text.encode()).hexdigest() if digest_only else text)
            yield batch(schema, (b.column(0).to_pylist(), lines, gone, texts))

    return both.select("doc_id", "text", "m_lines", "keep").mapInArrow(run, f"doc_id long, n_lines long, n_dropped long, {name} string")


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, digest_only: bool = False) -> DataFrame:
    """Documents without the lines that `min_docs` documents share, kept only in the largest id that holds them."""
    rows = with_mark(docs)
    return apply_bitmaps(rows, keep_bitmaps(rows, min_chars, min_docs), digest_only)
