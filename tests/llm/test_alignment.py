"""Token alignment against the tokenizer libraries and a loop over bytes."""

import hashlib
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from platewise.llm import alignment as al
from platewise.llm import queries

A, B = queries.merge_file(), queries.piece_file()


def owners(ends):
    out, at = [], 0
    for i, e in enumerate(ends):
        out += [i] * (e - at)
        at = e
    return out


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(1, 30)), st.sets(st.integers(1, 30)))
def test_merge_equals_loop_over_bytes(a, b):
    a, b = sorted(a | {31}), sorted(b | {31})
    link_a, link_b, group_a, group_b = al.merged(np.array(a), np.array(b))
    assert sorted(zip(link_a, link_b)) == sorted(set(zip(owners(a), owners(b))))
    cut = [e for e in a if e in b]
    assert group_a.tolist() == [sum(c < e for c in cut) for e in a] and group_b.tolist() == [sum(c < e for c in cut) for e in b]


def expected(rows):
    """The contract, byte by byte, with the libraries' own ids."""
    ta = Tokenizer.from_file(A)
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {c: b for b, c in enumerate(__import__("platewise.llm.merges", fromlist=["x"])._byte_letters())}

    def bytes_b(i):
        p = tb.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if tb.is_byte(i) else p.replace("▁", " ").encode()

    found, counts = [], Counter()
    for doc_id, text in rows:
        raw = (" " + (text or "")).encode()
        a, b = ta.encode(" " + (text or ""), add_special_tokens=False).ids, tb.encode(text or "")
        xa, xb = [bytes(letters[c] for c in ta.id_to_token(i)) for i in a], [bytes_b(i) for i in b]
        if not text or b"".join(xa) != raw or b"".join(xb) != raw:
            found.append((doc_id, None))
            continue
        ea, eb = np.cumsum(list(map(len, xa))).tolist(), np.cumsum(list(map(len, xb))).tolist()
        links = [(a[i], b[j]) for i, j in sorted(set(zip(owners(ea), owners(eb))))]
        counts.update(links)
        cut, said = sorted(set(ea) & set(eb)), []
        for lo, hi in zip([0, *cut], cut):
            said.append(",".join(str(i) for i, e in zip(a, ea) if lo < e <= hi) + "|" + ",".join(str(i) for i, e in zip(b, eb) if lo < e <= hi))
        found.append((doc_id, (len(a), len(b), len(said), links, ";".join(said))))
    most = Counter()
    for (_, j), c in counts.items():
        most[j] = max(most[j], c)
    out = []
    for doc_id, x in found:
        if x is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            na, nb, n, links, said = x
            out.append((doc_id, na, nb, n, len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghist", k=rng.randint(1, 9))) for _ in range(60)] + ["naïve", "中文", "don't", "<s>", "<0x41>", "▁", "<|endoftext|>", "\n\n", "  ", "ﬁ", "12", "!"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([1, 5, 60])))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, " "), (103, "the end"), (103, "the end"), (None, "the"), (104, "a\x00b"), (105, "word " * 6000)]


@pytest.mark.parametrize("block_bytes", [al.BLOCK, 300])
def test_operator_equals_contract(spark, frame, rows, block_bytes):
    got = al.align(frame(rows), A, B, block_bytes=block_bytes)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.columns == [*names, "n_best_a"]
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == expected(rows)


def test_groups_and_counts(spark, frame):
    docs = frame([(1, "the end"), (2, "the end"), (3, None)])
    got = {r[0]: r[1] for r in al.groups(docs, A, B).collect()}
    assert [len(got[i]) for i in (1, 2, 3)] == [2, 2, 0] and got[1] == got[2]
    counts = al.pair_counts(docs, A, B).collect()
    assert [r["count"] for r in counts] == [2, 2] and all(r["best_a"] and r["best_b"] for r in counts)


def test_query(spark, tmp_path, frame, rows):
    frame(rows[:20]).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_token_alignment(spark, str(tmp_path)).drop("n_best_a")
    assert sorted(map(tuple, got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str) == expected(rows[:20])
    frame([]).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op13_token_alignment(spark, f"{tmp_path}/none").count() == 0


def test_joint_merges_equal_single_ones():
    rng = random.Random(4)
    m = al.aligner(*(open(p, "rb").read() for p in (A, B))).a
    pieces = [bytes(rng.choices(b"aehinorst \xc3\xa9" if i % 2 else range(256), k=rng.randint(1, 24))) for i in range(5000)] + [b"a" * k for k in range(1, 25)]
    assert [m.ids(x).tolist() for x in m.merge_together(pieces)] == [m.merge(p) for p in pieces]
    assert m.merge_together([]) == []


def test_odd_spacing_equals_contract(spark, frame):
    rng = random.Random(6)
    parts = ["a", "the", "don't", "é", "ﬁ", "中", "12", "!", " ", "  ", "\t", "\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "̀", "▁", "¨", "ŉ", "<s>"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(1, 8))) for _ in range(600)]
    got = al.align(frame(list(enumerate(texts))), A, B, block_bytes=2000).drop("n_best_a")
    assert sorted(map(tuple, got.collect()), key=str) == expected(list(enumerate(texts)))


def test_repeated_words_are_encoded_once(monkeypatch):
    fed = []
    encode = al.Pieces.encode
    monkeypatch.setattr(al.Pieces, "encode", lambda self, texts: fed.extend(texts) or encode(self, texts))
    monkeypatch.setattr(al, "TaskContext", Task)
    run_block(["the end of the word " * 500] * 20)
    assert sum(map(len, fed)) < 1000


class Task:
    @staticmethod
    def get():
        return Task()

    def partitionId(self):
        return 0


def run_block(texts, block_bytes=1 << 30):
    files = type("Files", (), {"value": tuple(open(p, "rb").read() for p in (A, B))})
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    run = al._align(files, block_bytes)
    return sum(len(x) for x in run(iter([rows])))


def test_memory_of_a_block_is_not_that_of_its_links(monkeypatch):
    """An executor ran out of memory beside workers that held a block's links unpacked."""
    monkeypatch.setattr(al, "TaskContext", Task)
    monkeypatch.setattr(al, "SLICE", 1 << 16, raising=False)
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghist", k=rng.randint(1, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(1000)]
    run_block(texts[:2])  # loads the vocabularies
    tracemalloc.start()
    try:
        assert run_block(texts) > 1000
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 16 << 20
