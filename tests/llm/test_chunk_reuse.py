"""Chunked encoding against the tokenizers library."""

import hashlib
import json
import random
from types import SimpleNamespace

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from platewise.llm import chunk_reuse as cr
from platewise.llm import queries
from platewise.llm.merges import Merges, _byte_letters

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXT = st.text(st.sampled_from("ab thes'é ßre'll\n\t\x1c\x85\xa03²中😀ⅧªÅ!_１　́"), max_size=80)


@pytest.fixture(scope="module")
def m():
    return Merges(open(PATH, "rb").read())


@pytest.fixture(scope="module")
def oracle():
    t = Tokenizer.from_file(PATH)
    t.no_padding(), t.no_truncation()
    return t


@settings(max_examples=300, deadline=None)
@given(TEXT | st.text(max_size=40))
def test_merges_equal_library(m, oracle, text):
    text = text.encode("utf-8", "ignore").decode()
    parts = cr.Cutter(m).sections(text)
    got = [i for k, x in enumerate(parts) for i in ([m.special[x]] if k % 2 else m.ids(m.encode(x)).tolist())]
    assert got == oracle.encode(text, add_special_tokens=False).ids


def test_long_pieces(m, oracle):
    rng = random.Random(1)
    for text in ("ab" * 5000, "".join(rng.choices("abcdefgh", k=3000)), " " * 3000 + "x", "\n" * 999, "x" * 25, "".join(rng.choices("theinanr", k=25))):
        assert m.ids(m.encode(text)).tolist() == oracle.encode(text, add_special_tokens=False).ids


@settings(max_examples=500, deadline=None)
@given(TEXT, st.lists(st.integers(0, 80), max_size=12))
def test_joins_are_exact_wherever_texts_are_cut(m, text, at):
    ends = sorted({min(a, len(text)) for a in at} | {len(text)} - {0})
    joiner = cr.Joiner(m)
    for a, b in zip([0, *ends], ends):
        if b > a:
            joiner.add(cr.segment(m, text[a:b]))
    assert joiner.ids() == m.encode(text)


def test_cuts_follow_content():
    rng = random.Random(2)
    same = bytes(rng.choices(b"abcdefgh .", k=20_000))
    a, b = cr.chunks(b"x" * 777 + same), cr.chunks("né " .encode() * 500 + same)
    assert b"".join(a)[777:] == same and len(set(a) & set(b)) >= 0.8 * len(cr.chunks(same))
    assert all(len(c) <= cr.MOST + 3 for c in a + b) and cr.chunks(b"") == []
    wide = ("中" * 9000).encode()
    assert b"".join(cr.chunks(wide)) == wide and all(c.decode() for c in cr.chunks(wide))


def corpus():
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghis'", k=rng.randint(1, 9))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choices(words, k=n)) + rng.choice([".", "\n", "  ", "'"])
    passage = prose(900)
    rows = [(i, prose(rng.choice([1, 30, 400])) + (passage if i % 3 == 0 else "") + prose(5)) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(20)]
    rows += [(200, None), (201, ""), (202, "<|endoftext|>"), (203, f"a<|endoftext|>{passage}<|endoftext|>  <|endoftext|>b"), (204, passage[:1500] + "<|endoftext|>" + passage[100:])]
    rows += [(205, "a" * 40_000), (206, "a" * 50_000 + " b"), (207, " " * 30_000), (208, "é中" * 9000), (209, "naïve 中文 " * 900), (209, "naïve 中文 " * 900), (None, "x"), (None, passage)]
    return rows


def expected(oracle, rows):
    out = []
    for i, t in rows:
        ids = oracle.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((i, len(ids), sha(",".join(map(str, ids))), sha(oracle.decode(ids, skip_special_tokens=False))))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [cr.FILTER_BITS, 64])
def test_operator_equals_library(spark, frame, oracle, bits):
    rows = corpus()
    out = cr.encode(frame(rows), PATH, filter_bits=bits)
    got = out.collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got), key=str) == expected(oracle, rows)
    assert all(len(r["ids"]) == r["n_tokens"] for r in got)
    texts = sorted(map(tuple, cr.decode(out, PATH).collect()), key=str)
    assert texts == sorted([(i, t or "") for i, t in rows], key=str)


def second_scan(m, monkeypatch, texts):
    """What the second scan finishes without any shared chunk: key -> (n_tokens, digests)."""
    monkeypatch.setattr(cr, "merges", lambda data: m)
    monkeypatch.setattr(cr.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    scan = cr._split(SimpleNamespace(value=b""), SimpleNamespace(value=(b"", b"", 64)), False)
    rows = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    out = [r for b in scan(iter([rows])) for r in b.to_pylist()]
    by_key = {r["key"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out if r["kind"] == 1}
    return [by_key[r["key"]] for r in out if r["kind"] == 0]


def test_new_words_of_many_texts_are_merged_together(m, oracle, monkeypatch):
    """No short word is merged by itself, and a block of texts asks once for all of its words."""
    rng, calls = random.Random(5), {"merge": 0, "together": 0}
    texts = [" ".join("".join(rng.choices("etaoinñ中", k=rng.randint(2, 7))) for _ in range(40)) for _ in range(50)]
    one, many = m.merge, m.merge_together
    m.forget()

    def merge(data):
        calls["merge"] += 1
        return one(data)

    def merge_together(pieces):
        calls["together"] += bool(pieces)
        return many(pieces)

    monkeypatch.setattr(m, "merge", merge)
    monkeypatch.setattr(m, "merge_together", merge_together, raising=False)
    got = second_scan(m, monkeypatch, texts)
    assert got == [x[1:] for x in sorted(map(tuple, expected(oracle, enumerate(texts))), key=lambda x: x[0])]
    assert calls == {"merge": 0, "together": 1}


@pytest.mark.parametrize("together", [1, 500, 1 << 20])
def test_blocks_of_the_second_scan(m, oracle, monkeypatch, together):
    monkeypatch.setattr(cr, "TOGETHER", together, raising=False)
    monkeypatch.setattr(m, "REMEMBER", 3000)  # emptied within a block
    m.forget()
    texts = [t for _, t in corpus()[55:95]]
    got = second_scan(m, monkeypatch, texts)
    assert got == [x[1:] for x in sorted(map(tuple, expected(oracle, enumerate(texts))), key=lambda x: x[0])]
    m.forget()


def test_merging_together_without_rules_and_with_few():
    letters = [chr(b) for b in range(0x21, 0x7F)]
    spec = json.loads(open(PATH, "rb").read())
    spec["added_tokens"] = []
    for rules in ([], ["a b", "ab a", "b a", "aba b"]):
        vocab = {c: i for i, c in enumerate(dict.fromkeys(_byte_letters() + [r.replace(" ", "") for r in rules]))}
        spec["model"] |= {"vocab": vocab, "merges": rules}
        small = Merges(json.dumps(spec).encode())
        pieces = ["".join(random.Random(i).choices("ab" if i % 2 else letters, k=1 + i % 24)).encode() for i in range(400)]
        together = small.merge_together(pieces)
        assert [small.ids(x).tolist() for x in together] == [small.merge(p) for p in pieces]
        assert [small.decode(x) for x in together] == pieces
        assert small.decimals(b"") == small.decode(b"") == b""


def test_shared_chunks_are_encoded_once(spark, frame):
    """Of a passage in 20 documents, the ids of its inner chunks are computed in one place."""
    rows = corpus()
    data = spark.sparkContext.broadcast(open(PATH, "rb").read())
    words, _, bits = cr.shared_filter(frame(rows), data)
    assert 0 < len(words) // 8 <= bits >> 6
    assert cr.shared_filter(frame([(1, "alone"), (2, "lone")]), data)[0] == b""


def test_query(spark, tmp_path, frame, oracle):
    rows = corpus()[:30]
    frame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_chunk_reuse(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(oracle, rows)
    frame([]).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op12_chunk_reuse(spark, f"{tmp_path}/none").count() == 0
