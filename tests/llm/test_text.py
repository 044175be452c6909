"""Byte-level BPE, edit-aware counts, language ID, HTML text and archive revisits."""

import base64
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from platewise.llm import bpe, html_text, langid, token_counts, warc

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocab():
    return bpe.Vocabulary(open(PATH, "rb").read())


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pattern_is_the_published_one():
    assert bpe.PATTERN == public_tokenizers.PATTERN


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab thes'é ß\n\t\x1c\x85\xa03²中😀ⅧªÅ!_١　́"), max_size=60) | st.text(max_size=40))
def test_encoding_equals_library(vocab, oracle, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = vocab.encode(text)
    assert ids == oracle.encode_ordinary(text)
    assert vocab.decode(ids) == text.encode()


def test_long_runs_and_special_strings(vocab, oracle):
    for text in ("ab" * 5000, "<|endoftext|>", " " * 3000 + "x", "\n" * 999):
        assert vocab.encode(text) == oracle.encode_ordinary(text)


def test_perfect_hash_finds_members_only():
    keys = [str(i * 7919).encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert [h.find(k) for k in keys] == list(range(5000))
    assert h.find(b"none") == -1 and bpe.PerfectHash([]).find(b"x") == -1
    assert sorted(h.slot_value) == list(range(5000))


def test_round_trip_query(spark, frame, oracle):
    rows = [(1, "the end"), (2, None), (3, ""), (4, "the end"), (4, "x " * 9000), (None, "é"), (5, "<|endoftext|> hi")]
    docs = frame(rows)
    got = sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.round_trip(docs, PATH).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for _, t in rows:
        ids = oracle.encode_ordinary(t or "")
        want.append((len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == sorted(want)
    back = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert sorted(bytes(r["data"]) for r in back.collect()) == sorted((t or "").encode() for _, t in rows)
    assert bpe.round_trip(docs.where("doc_id > 99"), PATH).count() == 0


def test_edit_counts_equal_counting_again(vocab):
    rng = random.Random(2)
    alphabet = ["a", "b", " ", "  ", "\n", "'s", "'", "1", "é", "!", "the", "\t"]
    for k in range(400):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 900 if k % 4 == 0 else 30)))
        tree = token_counts.TokenTree(text, vocab.count)
        for _ in range(4):
            pos, gone, new = rng.randint(0, len(text) + 2), rng.randint(0, rng.choice([3, 300])), "".join(rng.choices(alphabet, k=rng.randint(0, 4)))
            tree.edit(pos, gone, new)
            at = min(pos, len(text))
            text = text[:at] + new + text[at + gone :]
            assert tree.text() == text
            assert tree.n_tokens == len(vocab.encode(text))
            assert tree.tokens[1] == sum(map(sum, tree.counts))


def test_edit_touches_only_its_surroundings(vocab):
    text = "some words of a text " * 2000
    tree = token_counts.TokenTree(text, vocab.count)
    tree.edit(20_000, 5, "new")
    assert tree.encoded < 60 and tree.n_tokens == len(vocab.encode(text[:20_000] + "new" + text[20_005:]))


def test_edited_counts_frame(spark, frame, vocab):
    docs = token_counts.scripted_edits(frame([(1, "the end of it"), (2, None), (3, ""), (None, "a b"), (3, "")]))
    for r in docs.join(token_counts.edited_counts(docs, PATH), "doc_id").collect():
        text = r["text"] or ""
        assert r["n_tokens"] == len(vocab.encode(text))
        for e in r["edits"]:
            text = text[: e["pos"]] + e["ins"] + text[e["pos"] + e["del"] :] if e["pos"] <= len(text) else text + e["ins"]
        assert r["n_tokens_edited"] == len(vocab.encode(text))
    none = docs.withColumn("edits", docs["edits"].cast("array<struct<pos:bigint,del:bigint,ins:string>>")).where("doc_id = 99")
    assert token_counts.edited_counts(none, PATH).count() == 0


def _ppm(training, order):
    """Code length of a text by the plain recursion of prediction by partial matching, one byte at a time."""
    follow = {}
    for t in training:
        data = b"\0" * order + t.lower().encode()
        for i in range(order, len(data)):
            for k in range(order + 1):
                node = follow.setdefault(data[i - k : i], {})
                node[data[i]] = node.get(data[i], 0) + 1

    def p(context, byte):
        if context is None:
            return 1 / 256
        shorter = context[1:] if context else None
        node = follow.get(context)
        if not node:
            return p(shorter, byte)
        t, d = sum(node.values()), len(node)
        if byte in node:
            return node[byte] / (t if d == 256 else t + d)
        return d / (t + d) * p(shorter, byte) / (1 - sum(p(shorter, x) for x in node))

    def bits(text):
        data = b"\0" * order + text.lower().encode()
        return -sum(math.log2(p(data[i - order : i], data[i])) for i in range(order, len(data)))

    return p, bits


@pytest.mark.parametrize("order", [0, 1, 3])
def test_language_model_equals_the_plain_recursion(order):
    training = {"en": ["the cat sat on the mat", "a hat"], "fr": ["le chat est sur le tapis", "été à l'île"], "zh": ["猫坐在垫子上"]}
    trees = langid.ContextTrees(training, order)
    texts = ["the mat", "Le Tapis, là-bas!", "q\0\0z", "猫", "зима", "x" * 50, "\x7f the île"]
    together = trees.code_lengths_of(texts, step=7)
    for text, row in zip(texts, together):
        want = [_ppm(training[lang], order)[1](text) for lang in trees.langs]
        assert np.allclose(row, want, rtol=1e-4) and np.allclose(trees.code_lengths(text), want, rtol=1e-4)
    p, _ = _ppm(training["fr"], order)
    contexts = [b"le "[3 - order :], b"\0\0\0"[:order], b"zzz"[:order]]
    for c in contexts:
        assert math.isclose(sum(p(c, b) for b in range(256)), 1.0, rel_tol=1e-9)


def test_language_query_equals_the_plain_recursion(spark, frame):
    rng = random.Random(4)
    letters = {"en": "abcde é", "fr": "bcdef é", "zh": "猫坐在垫 ab"}
    rows = [(i, lang, "".join(rng.choices(letters[lang], k=rng.randint(0, 60)))) for i, lang in enumerate(list(letters) * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    train = {}
    for i, lang, t in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            train.setdefault(lang, []).append(t)
    models = {lang: _ppm(train[lang], 3)[1] for lang in sorted(train)}
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    for i, _, t in rows:
        if not any(map(str.isalpha, t)):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        bits = {lang: bits(t) for lang, bits in models.items()}
        best = min(bits, key=bits.get)
        assert got[i]["lang_pred"] == best
        assert math.isclose(got[i]["score"], 1 / sum(2 ** (bits[best] - b) for b in bits.values()), rel_tol=1e-3)


def test_language_sample_is_bounded_and_cuts_long_texts(spark):
    docs = spark.createDataFrame([(i, "xy"[i % 2], "w" * (5 if i % 2 else 900)) for i in range(40)], "doc_id long, lang string, text string")
    taken = langid.sample(docs, 4, 100, 1 << 20)
    assert {lang: [len(t) for t in texts] for lang, texts in taken.items()} == {"x": [100] * 4, "y": [5] * 4}
    assert {len(x) for x in langid.sample(docs, 300, 100, 400).values()} == {2}


def test_language_model_prefers_its_language():
    trees = langid.ContextTrees({"en": ["the cat sat on the mat"] * 3, "fr": ["le chat est sur le tapis"] * 3})
    assert trees.predict("the mat")[0] == "en" and trees.predict("le tapis")[0] == "fr"
    assert trees.predict(None) == ("und", 0.0) and trees.predict("123 ...") == ("und", 0.0)
    long = "the cat " * 200_000
    assert abs(trees.code_lengths(long, 1000) - trees.code_lengths(long)).max() < 1.0


def test_language_id_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = docs.select("doc_id", "lang").join(langid.identify(docs), "doc_id")
    held = got.where("held_out")
    assert held.count() > 100 and held.where("lang = lang_pred").count() >= 0.98 * held.count()


def test_language_id_defined_cases(spark, frame):
    docs = frame([(1, "hello there"), (2, None), (3, ""), (4, "12"), (None, "hello"), (1, "hello there")])
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(docs).collect()}
    assert got == {(1, "en"), (2, "und"), (3, "und"), (4, "und"), (None, "en")}
    none = docs.where("doc_id > 99")
    assert langid.identify(none).count() == 0
    nothing = docs.selectExpr("doc_id", "text", "cast(null as string) lang", "source")
    assert {r["lang_pred"] for r in langid.identify(nothing).collect()} == {"und"}
    assert langid.keep_identified(docs, langid.train(docs)).columns == docs.columns


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{a:b}</style><script>var t="</p>";x(0);</script></head><body>
<header class="top">Site</header><nav><ul><li><a href=/>Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- ad -->
<div class="ad">Buy this now and be happy for a long time</div><aside>Side text</aside><article><h1>Title&amp;One</h1><p><b>First  para<br>line</b>
<p>Second &lt;b&gt; &eacute;.</p><div class="comments"><p>A reader says</p></div><form>Name <input name=a></form><p>Third</p></article>
<footer>&copy; x</footer></body></html>"""


def test_html_keeps_the_article_only():
    assert html_text.extract(PAGE) == "Title&One\n\nFirst para line\n\nSecond <b> é.\n\nThird"


def test_html_without_article_takes_the_long_region():
    para = "<p>" + "word " * 40 + "</p>"
    page = f"<body><div id='menu'><a href=x>Home</a></div><div>{para * 3}</div><p></p><div><a href=1>one link</a></div><div><a href=2>two</a></div><div><a>x</a></div><div>tiny</div></body>"
    assert html_text.extract(page) == "\n\n".join(["word " * 39 + "word"] * 3)


def test_html_names_that_only_look_like_boilerplate_keep_their_text():
    para = "Words of the story that go on for a while and then some more. " * 3
    for start, end in (('<div class="search-results">', "</div>"), ("<article>", "</article>"), ("<main>", "</main>"), ("", "")):
        page = f'<body><nav><a href=x>Home</a></nav>{start}<p class="share-price">{para}one</p><p id="tag">{para}two</p><div class="related-work"><p>{para}three</p></div>{end}<footer>x</footer></body>'
        assert [t.rsplit(" ", 1)[1] for t in html_text.extract(page).split("\n\n")] == ["one", "two", "three"]
    for name in ("ad", "ad-slot-2", "cookieNotice", "site-header", "reader comments", "share-buttons"):
        assert html_text._suspect_name(name), name
    for name in ("share-price", "search-results", "tag", "article-header", "main-content", "adobe", "menuetto"):
        assert not html_text._suspect_name(name), name


def test_html_windows_decide_between_marks_and_text(monkeypatch):
    para = "<p>" + "word " * 60 + "</p>"
    cards = "".join(f"<article><a href=/{k}>Story {k}</a> soon</article>" for k in range(4))
    assert html_text.extract(f"<body>{cards}<div>{para * 4}</div></body>") == "\n\n".join(["word " * 59 + "word"] * 4)
    short = "<article><h1>Title</h1><p>A short article it is.</p><form>Name</form><p>End.</p></article><div>Some words beside it</div>"
    assert html_text.extract(short) == "Title\n\nA short article it is.\n\nEnd."
    only = f'<body><div class="widget">{para * 2}</div></body>'  # a suspect container with all the text there is
    assert html_text.extract(only).count("word") == 120
    stray = f"<body><div>{para}</div><nav>x</nav><nav>y</nav><nav>z</nav><div>far away</div></body>"
    assert html_text.extract(stray) == "word " * 59 + "word"
    monkeypatch.setattr(html_text, "regions", lambda lengths, window: [(0, len(lengths))])  # without surge and dive
    assert html_text.extract(stray) != "word " * 59 + "word"


def test_html_unclosed_elements_hide_nothing_more():
    assert html_text.extract("<p>before</p><noscript><p>inside") == "before\n\ninside"
    assert html_text.extract("<p>a text</p><iframe src=x><p>b text") == "a text\n\nb text"
    assert html_text.extract("<p>one text</p>" + "<button>" * 20_000 + "<p>two text") == "one text\n\ntwo text"
    assert html_text.extract("<p>text</p><script>var x") == "text"


def test_html_very_long_page():
    page = "<article>" + "<p>some words of it</p>" * 40_000 + "</article>"
    assert html_text.extract(page) == "\n\n".join(["some words of it"] * 40_000)


def _windows(sizes, window):
    """Regions by their definition: text lines belong together if no window between them is empty."""
    text = [i for i, x in enumerate(sizes) if x]
    found = []
    for i in text:
        if found and i - found[-1][1] <= window:
            found[-1][1] = i
        else:
            found.append([i, i])
    return [(a, b + 1) for a, b in found]


def test_html_pages_equal_brute_force(spark):
    rng = random.Random(12)
    rows, want = [], {}
    for page in range(150):
        lines = []  # (html, text or None, length)
        for k in range(rng.randint(1, 25)):
            kind = rng.choice(["text", "text", "text", "link", "nav", "form"])
            words = " ".join(f"w{page}x{k}x{j}" for j in range(rng.choice([1, 2, 8, 30])))
            lines.append({"text": (f"<div>{words}</div>", words, len(words)), "link": (f"<div><a href=#>{words}</a></div>", words, 0), "nav": (f"<nav>{words}</nav>", None, 0), "form": (f"<form>{words}</form>", None, 0)}[kind])
        sizes = [n for _, _, n in lines]
        found = _windows(sizes, 3)
        peaks = [max(sum(sizes[i : min(i + 3, b)]) for i in range(a, max(a + 1, b - 2))) for a, b in found]
        kept = [lines[i][1] for (a, b), p in zip(found, peaks) if p >= 0.2 * max(peaks) for i in range(a, b) if lines[i][1]]
        rows.append((page, "u", "<body>" + "".join(h for h, _, _ in lines) + "</body>"))
        want[page] = "\n\n".join(kept)
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_html_defined_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "v", "<p>x"), (3, "v", "<p>x"), (None, "w", "<p unclosed"), (4, "z", "a < b &amp; c <i>d</i>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "0 as text", "'q' as n_chars")
    got = sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in html_text.extract_pages(pages).collect())
    assert ("1", "", 0) in got and ("2", "", 0) in got and got.count(("3", "x", 1)) == 2 and ("4", "a < b & c d", 11) in got
    assert html_text.extract_pages(pages.where("page_id > 9")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("<>/pab='\"! -&;"), max_size=80))
def test_html_never_fails(text):
    html_text.extract(text)


def test_surge_and_dive():
    assert html_text.regions([0, 5, 0, 0, 7, 0, 0, 0, 2], 3) == [(1, 5), (8, 9)]
    assert html_text.regions([], 3) == [] and html_text.regions([0, 0], 3) == []


def _records(spark, rows):
    return spark.createDataFrame(rows, "record_id long, kind string, url string, ts long, headers map<string,string>").selectExpr("*", "1 as bucket", "2 as full")


def test_revisits(spark):
    h = lambda **k: {a.replace("_", "-"): b for a, b in k.items()}
    rows = [
        (1, "response", "http://www.a.com/x/?b=2&a=1&utm_source=z#f", 10, h(etag='"1"', content_type="text/html", date="d1")),
        (2, "response", "https://A.com/x?a=1&b=2", 90_000, h(etag='"2"', last_modified="m", content_type="text/html")),
        (3, "revisit", "a.com/x?a=1&b=2", 20, h(etag='W/"1"', content_type="bad", date="d2")),
        (4, "revisit", "http://a.com:80/x?b=2&a=1", 5_000_000, h(last_modified="m", date="d3")),
        (5, "revisit", "http://a.com/x?a=1&b=2", 5_000_001, h(etag='"1"')),
        (6, "revisit", "http://b.com", 50, h(etag='"1"')),
        (7, "revisit", None, 50, None),
        (8, "revisit", "http://a.com/x?a=1&b=2", 10, None),
        (9, "response", "http://c.com", 1, None),
        (10, "revisit", "http://c.com/", 1, None),
    ]
    got = {r["record_id"]: r for r in warc.resolve_revisits(_records(spark, rows)).collect()}
    assert (got[3]["refers_to"], got[3]["headers"]) == (1, {"etag": 'W/"1"', "content-type": "text/html", "date": "d2"})
    assert got[4]["refers_to"] == 2 and got[4]["headers"]["date"] == "d3" and got[4]["headers"]["content-type"] == "text/html"
    assert got[5]["outcome"] == "changed" and got[5]["refers_to"] is None and got[5]["headers"] == {"etag": '"1"'}
    assert got[6]["outcome"] == got[7]["outcome"] == "orphan"
    assert got[8]["outcome"] == "changed"  # no validator against a response that has one
    assert got[10]["refers_to"] == 9
    assert warc.resolve_revisits(_records(spark, rows).where("record_id > 99")).count() == 0


def test_revisits_do_not_depend_on_buckets(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["response", "revisit"]), f"http://a.com/{rng.randrange(3)}", rng.randrange(500), {"etag": str(rng.randrange(2))}) for i in range(300)]
    want = {}
    for i, kind, url, ts, h in rows:
        if kind == "revisit":
            old = [(t, j) for j, k, u, t, _ in rows if k == "response" and u == url and (t, j) < (ts, i)]
            best = max(old, default=None)
            want[i] = best[1] if best and rows[best[1]][4] == h else None
    for size in (1, 7, 10_000):
        got = {r["record_id"]: r["refers_to"] for r in warc.resolve_revisits(_records(spark, rows), size).collect()}
        assert got == want
