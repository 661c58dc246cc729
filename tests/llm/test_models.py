import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from lossframe.llm import bpe, html_text, language, quality, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")


def held(doc_id, mod, part):
    return zlib.crc32(str(doc_id).encode()) % mod == part


# Language ID

def brute_bits(texts_by_lang, text):
    """Code lengths by dictionaries of counts, symbol by symbol."""
    out = []
    for texts in texts_by_lang:
        counts = defaultdict(lambda: defaultdict(int))
        for t in texts:
            s = language.symbols(t).tolist()
            for i in range(3, len(s)):
                for k in range(4):
                    counts[tuple(s[i - k:i])][s[i]] += 1
        bits, s = 0.0, language.symbols(text).tolist()
        for i in range(3, len(s)):
            p = 1.0
            for k in range(3, -1, -1):
                c = counts.get(tuple(s[i - k:i]))
                if not c:
                    continue
                n, d = sum(c.values()), len(c)
                if c.get(s[i]):
                    p *= c[s[i]] / (n + d)
                    break
                p *= d / (n + d)
            else:
                p /= 256
            bits -= math.log2(p)
        out.append(bits)
    return out


@pytest.mark.parametrize("slab", [1 << 20, 7])
def test_ppm_code_lengths(monkeypatch, slab):
    monkeypatch.setattr(language, "_SLAB", slab)
    texts = [["the cat sat on the mat", "a dog and the cat!"], ["der Hund und die Katze", "ein Tag für Ümläute"]]
    rows = defaultdict(int)
    for i, group in enumerate(texts):
        for t in group:
            for g in language._grams(language.symbols(t), language._SYMBOLS):
                rows[i, int(g)] += 1
    lang, gram = np.array(list(rows)).T
    model = language.Ppm(["en", "de"], lang, gram, np.array(list(rows.values()), float))
    asked = ["the hat", "die Hüte", "zzz 日本", "", "...", "CAT and Hund"]
    assert np.allclose(model.bits(asked), [brute_bits(texts, t) for t in asked], rtol=1e-5)


def test_ppm_keeps_all_contexts_of_many_symbols_and_languages():
    rng = np.random.default_rng(3)
    points = [*range(0x61, 0x7b), *range(0x80, 0x800, 5), *range(0x800, 0xd800, 500), *range(0xe000, 0x110000, 5000)]
    letters = "".join(map(chr, points))  # all bytes that UTF-8 has
    texts = [["".join(rng.choice(list(letters + " "), 400)) for _ in range(3)] for _ in range(10)]
    rows = defaultdict(int)
    for i, group in enumerate(texts):
        for t in group:
            for g in language._grams(language.symbols(t), language._SYMBOLS):
                rows[i, int(g)] += 1
    lang, gram = np.array(list(rows)).T
    model = language.Ppm([str(i) for i in range(10)], lang, gram, np.array(list(rows.values()), float))
    asked = [texts[7][1][:100], "".join(rng.choice(list(letters), 60)), "日本 abc"]
    assert np.allclose(model.bits(asked), [brute_bits(texts, t) for t in asked], rtol=1e-5)


def test_every_language_is_learned(frame):
    """Many languages, and one whose long text has more strings than all others together."""
    rng = np.random.default_rng(4)
    long = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), 2_000_000))
    rows = [(3 * i, long, "big") for i in range(1, 5)]
    own = {f"l{n:03}": "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 24)) for n in range(300)}
    rows += [(1000 * n + i, f"{w} {w[::-1]} {w[12:]}{w[:12]}", x) for n, (x, w) in enumerate(own.items(), 1) for i in range(4)]
    docs = frame(rows, "doc_id long, text string, lang string")
    model = language.trained(docs)
    learned = {r[2] for r in rows if not held(r[0], 3, 1)}
    assert set(model.langs) == learned and len(learned) > 256
    asked = [x for x in own if x in learned]
    best = model.bits([own[x] for x in asked]).argmin(axis=1)
    assert [model.langs[i] for i in best] == asked


def test_language_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = language.op5_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id").collect()
    asked = [r for r in got if r.held_out]
    assert all(r.held_out == held(r.doc_id, 3, 1) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == r.lang for r in asked) >= 0.98 * len(asked)


def test_language_odd_rows(odd, empty):
    model = language.trained(odd)
    got = language.identified(odd, model).collect()
    assert len(got) == odd.count()
    for r in got:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.doc.text or ""))
        assert (r.score == 0) == (r.lang_pred == "und")
    assert language.known_language(odd).columns == odd.columns
    assert language.trained(empty) is None and language.known_language(empty).count() == 0
    assert {r.lang_pred for r in language.identified(odd, None).collect()} == {"und"}


# Main text

def test_main_text_of_known_parts():
    model = html_text.TreeModel().fit(html_text.templates(200))
    right = whole = total = 0
    for page, y in html_text.templates(60, seed=99):
        full, _, _ = model.beliefs(page, page.features())
        same = [(full[i] > 0) == y[i] for i in range(len(y)) if not page.tag[i] and page.text[i].strip()]
        right, total, whole = right + sum(same), total + len(same), whole + all(same)
    assert right >= 0.95 * total and whole >= 40


def test_messages_give_exact_marginals():
    """Against the sum over all labellings of a small page."""
    model = html_text.TreeModel().fit(html_text.templates(20), epochs=2)
    page = html_text.Page("<div class=ad>x</div><p>y <b>z</b></p>")
    features = page.features()
    full, _, _ = model.beliefs(page, features)
    n = len(page.tag)
    unary = [sum(model.weight.get(f, 0.0) for f in fs) for fs in features]
    z, on = 0.0, [0.0] * n
    for code in range(2**n):
        y = [code >> i & 1 for i in range(n)]
        w = math.exp(sum(u for u, v in zip(unary, y) if v) + sum(model.pair[page.kinds()[i]][y[page.parent[i]]][y[i]] for i in range(1, n)))
        z += w
        for i in range(n):
            on[i] += w * y[i]
    assert np.allclose([1 / (1 + math.exp(-x)) for x in full], [x / z for x in on], atol=1e-6)


def test_page_parts_and_references():
    page = html_text.Page("<p>a&amp;b &eacute;&#233;\n  c<br>d<p>e<script>x<p></script>f<!-- g --><ul><li>h<li>i</ul>j<td>k&am")
    assert page.joined([True] * len(page.tag)) == "a&b éé c\nd\nef\nh\ni\nj\nk&am"


def test_quoted_values_of_any_length():
    for quote in "\"'":
        for n in (10, 4_096, 5_000, 300_000):
            page = html_text.Page(f"<p>a</p><div data-x={quote}{'a' * n} 1 > 0 <b> class=x hidden{quote} class={quote}comments{quote}>reply</div>")
            assert page.joined([True] * len(page.tag)) == "a\nreply"
            assert page.names[page.tag.index("div")] == ("comments",) and "b" not in page.tag
    page = html_text.Page("<p don't>a</p><p>it's b</p><p id=x\"y class=z>c</p><p class=\"open>d</p><p>e")
    assert page.joined([True] * len(page.tag)) == "a\nit's b\nc\nd\ne"
    page = html_text.Page("<a b='" * 50_000 + "<a b=\"" * 50_000 + "<a b" * 50_000)
    assert len(page.tag) >= 2


def test_all_words_of_names_are_evidence():
    page = html_text.Page('<div class="d-flex flex-column align-items-center justify-content-between px-3 py-2 mt-4 comments" role="navigation">x</div>')
    assert {"content", "comments", "navigation"} <= set(page.names[1])
    assert {"econtent", "ejunk"} <= set(page.features()[1])


def test_formulas_and_fallbacks_are_text():
    page = html_text.Page("<p>if <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then<xmp>a <b> &amp; c</xmp>"
                          "<object data=f><p>no film</p></object><canvas>a chart</canvas><script>s</script><object>open")
    assert page.joined([True] * len(page.tag)) == "if x=2 then\na <b> &amp; c\nno film\na chartopen"
    page = html_text.Page("<xmp>open <i>")
    assert page.joined([True] * len(page.tag)) == "open <i>"
    model = html_text.TreeModel().fit(html_text.templates(200))
    said = "The sum of all the parts is, as was shown above, equal to the whole of it, and so nothing is lost here."
    got = model.main_text(f"<body><nav class=menu><ul><li><a href=/>home</a></ul></nav><article><h1>Sums</h1><p>{said}</p><p>{said} So "
                          f"<math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds. {said}</p><xmp>{said}</xmp><p><object>{said}</object><p>{said}</article></body>")
    assert "So x=2 holds." in got and got.count(said) == 6
    got = model.main_text(f"<article><h1>Sums</h1><p>{said} {said}</p><p>{said}</p></article><footer><object><ul><li><a href=/>legal</a></ul></object></footer>")
    assert got == f"Sums\n{said} {said}\n{said}"


def test_main_text_of_pages(spark, frame):
    got = html_text.op6_html_text(spark, "/root/testdata/sf0.001").collect()
    assert got and all(r.n_chars == len(r.text) for r in got)
    shown = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    texts = {r.page_id: r.text for r in got}
    assert all("track(" not in t and "margin:0" not in t and "©" not in t for t in texts.values())
    assert sum(len(texts[r.page_id]) > 0 for r in shown) > 0.9 * len(shown)
    odd = frame([(1, None, None, "t"), (None, "u", "", "t"), (2, "u", "<" * 5000 + "<div>" * 5000, None), (2, "u", "plain words here", "t")],
                "page_id long, url string, html string, text string")
    model = html_text.trained(odd)
    assert html_text.extracted(odd, model).count() == 4 and html_text.extracted(odd.limit(0), model).count() == 0


# BPE

TEXT = st.text(st.one_of(st.sampled_from("aabcdethinsorelm 's'll1 9.\n\t<|endoftext|>"), st.characters(blacklist_categories=("Cs",))), max_size=60)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return " ".join(map(str, ids)), len(ids), library.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_bpe_equals_library(library, text):
    assert bpe._bpe(PATH).encoded(text) == expected(library, text)


def test_bpe_of_documents(spark, library):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += [None, "", "<|startoftext|>a<|endoftext|>", "x" * 5000, "日本語 ᏣᎳᎩ Σς İ ſ", *map(chr, range(1, 0x300))]
    own = bpe._bpe(PATH)
    assert all(own.encoded(t) == expected(library, t) for t in texts)


def test_bpe_forgets_and_goes_on(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE", 3)
    own = bpe.Bpe(PATH)
    for t in ["a b c d e f g a b", "hello world again and again", "a b c"]:
        assert own.encoded(t) == expected(library, t)


def test_bpe_odd_rows(odd, empty, library):
    ids = bpe.encode(odd, PATH)
    said = {r.doc_id: r.text for r in bpe.decode(ids, PATH).collect()}
    assert all(said[r.doc_id] == expected(library, r.text)[2] for r in odd.filter("doc_id is not null").collect())
    assert bpe.digests(odd, PATH).count() == odd.count() and bpe.digests(empty, PATH).count() == 0


# Toxicity

def test_gradients_by_differences():
    net, rng = toxicity.BiGru(), np.random.default_rng(0)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    gates = rng.standard_normal((3, 5, 2, 3 * toxicity.HIDDEN))
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0]], bool)
    d = np.array([0.3, -0.7, 0.5])
    _, kept = net.forward(gates, mask, keep=True)
    g, dgates = net.gradients(kept, mask, d)
    for name, at in (("u", (0, 1, 2)), ("u", (1, 3, 20)), ("att", (4, 2)), ("v", (1,)), ("out", (9,)), ("bias", (0,))):
        old, out = net.p[name][at], []
        for e in (1e-3, -1e-3):
            net.p[name][at] = old + e
            out.append(net.forward(gates, mask) @ d)
        net.p[name][at] = old
        assert math.isclose((out[0] - out[1]) / 2e-3, g[name][at], rel_tol=0.05, abs_tol=2e-3), name
    for at in ((0, 2, 0, 3), (1, 1, 1, 18), (2, 0, 0, 9)):
        out = []
        for e in (1e-3, -1e-3):
            moved = gates.copy()
            moved[at] += e
            out.append(net.forward(moved, mask) @ d)
        assert math.isclose((out[0] - out[1]) / 2e-3, dgates[at], rel_tol=0.05, abs_tol=2e-3)


def test_windows_cover_the_text():
    for n in (0, 1, 31, 32, 33, 48, 49, 1000):
        seen = {i for a in toxicity.windows(n) for i in range(a, min(n, a + toxicity.WINDOW))}
        assert seen == set(range(n))


def test_toxicity_learns_and_odd_rows(odd, empty, frame):
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("aeionrst"), 4)) for _ in range(200)]
    text = lambda bad: " ".join(["bad" + str(rng.integers(5)) if bad and i == 20 else rng.choice(vocabulary) for i in range(rng.integers(30, 120))])
    y = np.array([i % 4 == 0 for i in range(400)], float)
    net = toxicity.fitted([text(v) for v in y], y)
    asked = [i % 2 == 0 for i in range(100)]
    scorer = toxicity.Scorer(net)
    right = (scorer.scores([text(v) for v in asked]) >= 0.5) == np.array(asked)
    assert right.mean() >= 0.95
    got = toxicity.scored(odd, net).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert scorer.scores([None, "", "..."]).max() < 0.5
    assert toxicity.scored(empty, net).count() == 0
    labels = frame([(1, None, None), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.trained(odd, labels) == 0.0 and toxicity.trained(odd, labels.limit(0)) == 0.0


# Quality

def test_quality_held_out(spark):
    d = "/root/testdata/sf0.1"
    got = quality.op10_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.97 * len(got)


def test_quality_column_equals_numpy(spark, odd, empty, frame):
    rng = np.random.default_rng(0)
    x = rng.random((300, 3))
    model = quality.fitted(x, ((x[:, 0] > 0.4) & (x[:, 2] < 0.7)).astype(float), ["a", "b", "c"])
    got = frame(x.tolist(), "a double, b double, c double").select(model.column().alias("score"), "a").toPandas().sort_values("a")["score"]
    assert np.allclose(got, model.scores(x[np.argsort(x[:, 0])]))
    labels = frame([(1, None, None), (2, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.scored(odd, quality.trained(odd, labels)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.scored(empty, quality.trained(empty, labels)).count() == 0
    assert quality.scored(odd, quality.trained(odd, labels.limit(0))).select("score").distinct().collect()[0].score == 0.5
