"""Deduplication, joins, scoring, decontamination and the pipeline against brute force."""

import collections
import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from platewise.llm import decontaminate, exact_dedup, line_dedup, lm_score, ngram_join
from platewise.llm.components import components


def test_exact_dedup(spark, frame, corpus):
    rows = [*corpus, (300, "café"), (301, "café"), (302, "café "), (303, "café")]
    by = collections.defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(frame(rows)).collect()}
    assert got == {i: (max(by[t or ""]), len(by[t or ""]), i == max(by[t or ""])) for i, t in rows}


def test_exact_dedup_compares_texts_under_equal_digests(spark, frame, corpus):
    weak = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 2))
    docs = frame(corpus)
    strong = {r["doc_id"]: tuple(r)[1:4] for r in exact_dedup.exact_dedup(docs).collect()}
    assert {r["doc_id"]: tuple(r)[1:4] for r in exact_dedup.exact_dedup(docs, digest=weak, salts=3).collect()} == strong
    assert exact_dedup.exact_dedup(docs.where("doc_id < 0")).count() == 0
    nulls = frame([(None, "a"), (None, "b"), (None, "b"), (7, "c"), (None, "c")])
    for digest in (exact_dedup.sha256_digest, lambda text: F.unhex(F.lit("00"))):
        got = sorted(tuple(map(str, r))[:4] for r in exact_dedup.exact_dedup(nulls, digest=digest).collect())
        assert got == sorted([("7", "7", "2", "True"), ("None", "7", "2", "False"), ("None", "None", "1", "True"), *[("None", "None", "2", "True")] * 2])
    repeated = frame([(1, "a"), (1, "a"), (None, "a"), (2, "b")])
    assert sorted((r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup(repeated).collect()) == [(1, 3)] * 3 + [(2, 1)]


def test_distinct_texts_keeps_a_row_of_every_text(spark, frame, corpus):
    rows = [(1, "a"), (1, "b"), (9, "a"), (None, "c"), (None, "c"), (5, None), (4, ""), (1, "b")]
    for digest in (exact_dedup.sha256_digest, lambda text: F.unhex(F.lit("00"))):
        out = exact_dedup.distinct_texts(frame(rows), digest=digest, salts=2)
        assert out.columns == frame(rows).columns
        assert sorted((str(r["doc_id"]), r["text"]) for r in out.collect()) == sorted([("9", "a"), ("1", "b"), ("None", "c"), ("5", None)], key=lambda x: (x[0], str(x[1])))
    last = {}
    for i, t in corpus:
        last[t or ""] = max(i, last.get(t or "", -1))
    assert {r["doc_id"] for r in exact_dedup.distinct_texts(frame(corpus)).collect()} == set(last.values())
    assert exact_dedup.distinct_texts(frame(corpus).where("doc_id < 0")).count() == 0


def _roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def _sets(rows, n=3):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    return out


def test_ngram_join(spark, frame, corpus):
    sets = _sets(corpus)
    for num, den in ((90, 100), (70, 100)):
        links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
        want = _roots(list(sets), links)
        for first in (2, 9):
            got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(frame(corpus), num=num, den=den, star_from=first, frequent=50).collect()}
            assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_ngram_join_large_group_and_defined_cases(spark, frame):
    rng = random.Random(1)
    base = [f"b{i}" for i in range(160)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            w[rng.randrange(160)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    sets = _sets(rows)
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    want = _roots(list(sets), links)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(frame(rows)).collect()}
    assert got == want and len(set(want.values())) > 1
    odd = frame([(None, "a b c"), (5, "a b c"), (3, "A b  c"), (3, "A b  c"), (7, ""), (8, None), (9, "a b"), (4, "a b")])
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(odd).collect())
    assert got == sorted([("None", 1, None), ("5", 1, 3), ("3", 1, 3), ("3", 1, 3), ("7", 0, 7), ("8", 0, 8), ("9", 1, 4), ("4", 1, 4)])
    assert ngram_join.ngram_components(odd.where("doc_id > 99")).count() == 0


def test_prefix_and_parity_bounds_hold():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, max(1, int(len(a) * 0.95)), replace=False), rng.integers(0, 1 << 62, int(rng.integers(0, 6))).astype(np.uint64)]))
        common = len(np.intersect1d(a, b))
        hot = np.sort(rng.choice(a, len(a) // 3, replace=False))
        if 100 * common >= 90 * (len(a) + len(b) - common):
            shared = np.intersect1d(ngram_join.prefix(a, hot, 90, 100), ngram_join.prefix(b, hot, 90, 100))
            assert len(shared) >= ngram_join.needed(min(len(a), len(b)))
        apart = sum(bin(int(x) & (1 << 64) - 1 ^ int(y) & (1 << 64) - 1).count("1") for x, y in zip(ngram_join.parity(a), ngram_join.parity(b)))
        assert apart <= len(a) + len(b) - 2 * common


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)]
    ids = {x for e in links for x in e if e[0] != e[1]}
    want = _roots(ids, links)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def _line_dedup(rows, least=40, docs=5):
    holders = collections.defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().lower()
    size = lambda x: len(x.strip(" \t\n\x0b\x0c\r"))
    for i, t in rows:
        for x in (t or "").split("\n"):
            if size(x) >= least:
                holders[key(x)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (size(x) >= least and len(holders[key(x)]) >= docs and i != max(holders[key(x)]))]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(spark, frame):
    rng = random.Random(6)
    common = [f"common line {k} that is long enough to be counted É{k}" for k in range(6)]
    rows = []
    for i in range(150):
        lines = [rng.choice(common) if rng.random() < 0.5 else f"own line {rng.randrange(10**6)} " + "x" * rng.randrange(50) for _ in range(rng.randint(0, 8))]
        lines = [f"\t{x.upper() if rng.random() < 0.3 and 'É' not in x else x} " for x in lines]
        rows.append((i, "\n".join(lines)))
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, common[0] * 50)]
    for partitions in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.line_dedup(frame(rows)).collect()}
        assert got == _line_dedup(rows)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_line_dedup_hot_line_over_many_partitions(spark, frame):
    line = "the same line in every document of the table, over and over"
    rows = [(i, f"{line}\nown {i}\n{line}") for i in range(400)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    got = {r["doc_id"]: (r["n_dropped"], r["text"]) for r in line_dedup.line_dedup(frame(rows)).collect()}
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == {i: (0, f"{line}\nown {i}\n{line}") if i == 399 else (2, f"own {i}") for i in range(400)}


def test_line_dedup_defined_cases(spark, frame):
    line = "a line of more than forty code points in it, surely"
    odd = frame([(1, line), (1, line), (2, line), (3, line), (4, line), (None, line)])
    got = sorted((str(r["doc_id"]), r["n_dropped"]) for r in line_dedup.line_dedup(odd).collect())
    assert got == [("1", 1), ("1", 1), ("2", 1), ("3", 1), ("4", 0), ("None", 1)]
    four = odd.where("doc_id is not null")
    assert {r["n_dropped"] for r in line_dedup.line_dedup(four).collect()} == {0}
    assert line_dedup.line_dedup(odd.where("doc_id > 9")).count() == 0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for top in (5, 300, 1 << 40, (1 << 64) - 1):
        values = np.unique(rng.integers(0, top, 500, dtype=np.uint64))
        low, a, b = lm_score.EliasFano.parts(values)
        ef = lm_score.EliasFano(len(values), low, a, b)
        assert (ef.get(np.arange(len(values))) == values).all()
        assert (ef.find(values) == np.arange(len(values))).all()
        missing = np.setdiff1d(rng.integers(0, top, 200, dtype=np.uint64), values)
        assert (ef.find(missing) == -1).all()
    same = np.sort(rng.integers(0, 9, 700)).astype(np.uint64)
    ef = lm_score.EliasFano(700, *lm_score.EliasFano.parts(same))
    assert (ef.get(np.arange(700)) == same).all() and ef.low.nbytes + ef.high.nbytes < 300
    empty = lm_score.EliasFano(0, *lm_score.EliasFano.parts(np.empty(0, np.uint64)))
    assert empty.find(np.array([0, 7], np.uint64)).tolist() == [-1, -1]


def test_elias_fano_finds_the_successor_within_a_range_only():
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 3000, 900)).astype(np.uint64)
    ef = lm_score.EliasFano(len(values), *lm_score.EliasFano.parts(values))
    keys = rng.integers(0, 3200, 500).astype(np.uint64)
    first = rng.integers(0, len(values), 500)
    stop = np.minimum(len(values), first + rng.integers(0, 400, 500))
    at = np.searchsorted(values, keys)
    want = [int(i) if a <= i < b and values[i] == k else -1 for k, i, a, b in zip(keys, at, first, stop)]
    assert ef.find(keys, first, stop).tolist() == want


def test_trie_keeps_its_levels_packed(tmp_path):
    words = np.array([3, 9, 2**63 + 5], np.uint64)  # numbers 2, 3 and 4 after a head of two
    pairs = np.array([0 * 5 + 3, 1 * 5 + 0, 2 * 5 + 2, 4 * 5 + 1, 4 * 5 + 4])
    packed = lm_score.Trie.pack(2, words, np.array([7, 0, 300]), pairs, np.array([1, 2, 3, 4, 5]))
    (tmp_path / "t").write_bytes(packed)
    for trie in (lm_score.Trie.open(str(tmp_path / "t")), lm_score.Trie.mapped(packed)):
        w = trie.word(np.array([3, 4, 2**63 + 5], np.uint64))
        assert w.tolist() == [2, -1, 4] and trie.count(w).tolist() == [7, 0, 300]
        found = trie.pair(np.array([0, 1, 2, 4, 4, 3, -1, 0]), np.array([3, 0, 2, 1, 4, 0, 1, -1]))
        assert found.tolist() == [0, 1, 2, 3, 4, -1, -1, -1] and trie.code(found).tolist() == [1, 2, 3, 4, 5, 0, 0, 0]
        assert not trie.pairs.low.flags.owndata and not trie.codes.flags.owndata  # views of the map
    rng = np.random.default_rng(0)
    many = np.unique(rng.integers(0, 1 << 34, 40_000)).astype(np.int64)
    parts = lm_score.EliasFano.parts(many)
    assert parts[1].nbytes + parts[2].nbytes < len(many) * (2 + np.log2((1 << 34) / len(many)) + 1) / 8 * 1.05


def test_codes_are_exact_counts_first():
    counts = np.array([0, 1, 2, 4096, 4097, 10**6, 10**9])
    back = lm_score.counts_of(lm_score.quantise(counts))
    assert (back[:4] == counts[:4]).all() and np.allclose(back, counts, rtol=2.0**-11)


def _lm(rows, mu=2.0, power=0.9):
    docs = {i: (t or "").encode().lower().split() + [None] for i, t in rows}
    train = [docs[i] for i, _ in rows if zlib.crc32(str(i).encode()) % 10]
    c = collections.Counter(w for d in train for w in d)
    pairs = collections.Counter((v, w) for d in train for v, w in zip(["<"] + d[:-1], d))
    n, space = sum(c.values()), sum(c.values()) + 0.1 * (len(c) + 1)
    c["<"] = len(train)
    out = {}
    for i, d in docs.items():
        base = score = 0.0
        for v, w in zip(["<"] + d[:-1], d):
            p0 = (c[w] + 0.1) / space
            base += math.log10(p0)
            m = mu * max(c[v], 1) ** power
            score += math.log10((pairs[v, w] + m * p0) / (c[v] + m)) if c[v] else math.log10(p0)
        out[i] = (len(d), sum(c[w] > 0 for w in d), n, base, score)
    return out


def _same_scores(got, want):
    got = {r["doc_id"]: r for r in got}
    assert got.keys() == want.keys()
    for i, (n, known, total, base, score) in want.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-12) and math.isclose(r["score"], score, rel_tol=1e-12)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 10 == 0)


def test_lm_score(spark, frame, corpus):
    want = _lm(corpus)
    for head, shards, block in ((60_000, 64, 600_000), (0, 1, 10**6), (5, 3, 40), (100, 200, 300)):
        got = lm_score.score_documents(frame(corpus), head_words=head, least_shards=shards, block_tokens=block).collect()
        _same_scores(got, want)


def test_lm_score_of_one_very_long_text(spark, frame, corpus):
    rng = random.Random(1)
    words = [f"w{rng.randrange(700)}" for _ in range(9000)]
    rows = [*corpus[:30], (1001, " ".join(words)), (1002, " ".join(words[2000:4000]) + "\n" + "z" * 5000)]
    _same_scores(lm_score.score_documents(frame(rows), block_tokens=200, head_words=20).collect(), _lm(rows))


def test_lm_score_of_every_word_beyond_any_limit(spark, frame):
    rng = random.Random(9)
    vocabulary = [f"v{k}" for k in range(3000)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=200))) for i in range(60)]
    _same_scores(lm_score.score_documents(frame(rows), head_words=10, least_shards=5).collect(), _lm(rows))


def test_lm_model_is_frozen(spark, frame, corpus, tmp_path):
    learnt, others = corpus[:80], [(i, t) for i, t in corpus[80:]]
    model = lm_score.train(frame(learnt), path=f"file:{tmp_path}/model", head_words=30)
    again = lm_score.Model.load(spark, model.path)
    assert (again.tokens, again.words, again.shards) == (model.tokens, model.words, model.shards)
    both = {r["doc_id"]: r["score"] for r in lm_score.score(frame(learnt), again).collect()}
    want = {r["doc_id"]: r["score"] for r in lm_score.score_documents(frame(learnt)).collect()}
    assert both.keys() == want.keys() and all(math.isclose(both[i], want[i], rel_tol=1e-12) for i in want)
    scored = {r["doc_id"]: r["score"] for r in lm_score.score(frame([*learnt, *others]), again).collect()}
    assert all(math.isclose(scored[i], want[i], rel_tol=1e-12) for i in want) and len(scored) == len(corpus)


def test_lm_score_beats_the_unigrams_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm_score.score_documents(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.avg((F.col("score") > F.col("base_score")).cast("int"))).first()
    assert r[0] > r[1] and r[2] > 0.9


def test_lm_score_defined_cases(spark, frame):
    odd = frame([(1, "a b"), (1, "a b"), (None, "a"), (2, None), (3, "")])
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in lm_score.score_documents(odd).collect())
    assert got == [("1", 3), ("1", 3), ("2", 1), ("3", 1), ("None", 2)]
    assert lm_score.score_documents(odd.where("doc_id > 9")).count() == 0
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = lm_score.score_documents(frame([(held, "a b")])).first()
    assert (r["train_tokens"], r["n_known"], r["base_score"], r["score"]) == (0, 0, 0.0, 0.0)


def _align(item, words):
    best, prev = 0, [0] * (len(words) + 1)
    for a in item:
        row = [0]
        for j, b in enumerate(words):
            row.append(max(0, prev[j] + (2 if a == b else -1), prev[j + 1] - 1, row[j] - 1))
        best, prev = max(best, *row), row
    return best


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 25))
        assert decontaminate.smith_waterman(a, b)[0] == _align(a.tolist(), b.tolist())


def test_decontamination(spark, frame):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    items = [(k, " ".join(word() for _ in range(rng.randint(12, 60)))) for k in range(20)]
    rows, want = [], set()
    for i in range(200):
        w = [word() for _ in range(rng.randint(5, 200))]
        if i % 4 == 0:
            k, text = items[rng.randrange(20)]
            copy = text.split()
            for _ in range(len(copy) // 5):
                j = rng.randrange(len(copy))
                copy[j : j + 1] = rng.choice([[word()], [], [copy[j], word()]])
            if i % 8 == 0:
                copy = [x.upper() + "," for x in copy]
            at = rng.randrange(len(w))
            w[at:at] = copy
            want.add((i, k))
        rows.append((i, " ".join(w)))
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "...")], "item_id long, text string").selectExpr("*", "1 as doc_id")
    for size in (20_000, 7):
        got = decontaminate.contaminated(frame(rows), bench, slice_items=size).collect()
        assert {(r["doc_id"], r["item_id"]) for r in got} == want
    docs = frame([*rows, (900, None), (901, "")])
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in want} | {900, 901}
    assert decontaminate.contaminated(docs, bench.where("item_id > 999")).count() == 0
    assert decontaminate.contaminated(docs.where("doc_id < 0"), bench).count() == 0


def test_decontamination_of_edited_copies_beside_verbatim_ones(spark, frame):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    items = {k: [word() for _ in range(40)] for k in range(12)}
    texts, want = [], set()
    for k, item in items.items():
        copies = [item] * rng.randint(1, 5)
        for _ in range(3):
            copy = list(item)
            for j in rng.sample(range(40), 13):
                copy[j] = word()
            copies.append(copy)
        for copy in copies:
            share = _align(item, copy) / (2 * len(item))
            if share >= 0.4 and any(copy[j : j + 3] == item[j : j + 3] for j in range(38)):
                want.add((len(texts), k))
            texts.append([word() for _ in range(50)] + copy + [word() for _ in range(50)])
    docs = frame([(i, " ".join(w)) for i, w in enumerate(texts)])
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == want
    assert {r["doc_id"] for r in decontaminate.clean_documents(docs, bench).collect()} == set(range(len(texts))) - {i for i, _ in want}


def test_decontamination_equals_alignment_of_all_pairs(spark, frame):
    rng = random.Random(21)
    words = ["".join(rng.choices("abcdefghijklmno", k=5)) for _ in range(400)]
    items = [(k, rng.choices(words, k=rng.randint(12, 30))) for k in range(8)]
    rows = []
    for i in range(60):
        w = rng.choices(words, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            copy = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, len(copy))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            at = rng.randint(0, len(w))
            w[at:at] = copy[rng.randint(0, 6) :]
        rows.append((i, w))
    rows.append((100, rng.choices(words, k=30_000) + items[0][1] + rng.choices(words, k=10)))  # a very long text
    grams = lambda w: {tuple(w[j : j + 3]) for j in range(len(w) - 2)}
    code = {x: j for j, x in enumerate(words)}
    score = lambda item, w: _align(item, w) if len(w) < 1000 else decontaminate.smith_waterman(np.array([code[x] for x in item]), np.array([code[x] for x in w]))[0]
    want = {(i, k) for i, w in rows for k, item in items if grams(w) & grams(item) and score(item, w) >= 0.4 * 2 * len(item)}
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")
    got = decontaminate.contaminated(frame([(i, " ".join(w)) for i, w in rows]), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want) > 20


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline

    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in source.collect()]
    extra = [(900_000 + i, t, None, None, None) for i, t in enumerate([None, "123", rows[0][1], rows[1][1] + " more", bench.first()["text"]])]
    extra += [(rows[2][0], "another text under an id that is taken", None, None, None), (None, rows[3][1] + " of a row without id", None, None, None), (None, "two rows", None, None, None), (None, "two rows", None, None, None)]
    both = source.unionByName(spark.createDataFrame(extra, source.schema))
    both.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))

    left = [(i, t) for i, t in [*rows, *[(e[0], e[1]) for e in extra]] if t and any(map(str.isalpha, t))]
    low, high = (lambda i: -1 if i is None else i), (lambda i: 10**9 if i is None else i)
    last = {t: i for i, t in sorted(left, key=lambda x: low(x[0]))}
    left = sorted([(i, t) for t, i in last.items()], key=lambda x: high(x[0]))  # by place from here on
    sets = _sets([(k, t) for k, (_, t) in enumerate(left)], 5)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = _roots(list(sets), links)
    left = [x for k, x in enumerate(left) if root[k] == k]
    plain = lambda t: [y for y in ("".join(filter(str.isalnum, w.lower())) for w in t.split()) if y]
    items = [" ".join(plain(r["text"])) for r in bench.collect()]
    left = [(i, t) for i, t in left if not any(f" {x} " in f" {' '.join(plain(t))} " for x in items)]
    assert sorted(high(r["doc_id"]) for r in got.select("doc_id").collect()) == sorted(high(i) for i, _ in left)
    assert all(len(r["ids"]) == r["n_tokens"] for r in got.collect())


def test_language_stage_keeps_letters_without_any_label(spark, frame):
    import corpus_pipeline

    docs = frame([(1, "some words"), (2, None), (3, ""), (4, "123"), (None, "é")]).withColumn("lang", F.lit(None).cast("string"))
    assert {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, "").collect()} == {1, None}


def test_stages_keep_the_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns and out.count() == 0


