"""Toxicity scores against a plain forward pass, quality statistics against plain Python, and the label sample's bound."""

import math
import re
import unicodedata

import numpy as np
import pytest
import xxhash

from lossframe.llm import quality, toxicity
from lossframe.llm.toxicity import DIM, HIDDEN, STRIDE, TRIGRAMS, WINDOW, WORDS


# Toxicity

def plain_words(text):
    out, at = [], b""
    for c in (text or "").encode():
        c = c + 32 if 65 <= c <= 90 else c
        if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128:
            at += bytes([c])
        elif at:
            out.append(at)
            at = b""
    return out + [at] if at else out


def plain_logit(p, tokens):
    """One window, word by word and gate by gate."""
    sig = lambda x: 1 / (1 + math.exp(-x))
    vectors = []
    for w in tokens:
        framed = b"<" + w + b">"
        grams = [framed[i:i + 3] for i in range(len(framed) - 2)]
        ids = [((g[0] << 16 | g[1] << 8 | g[2]) * 2654435761 % 2**32 >> 16) % TRIGRAMS for g in grams]
        tri = [sum(p["tri"][i][d] for i in ids) / len(ids) for d in range(DIM)]
        vectors.append([*p["word"][xxhash.xxh32_intdigest(w) % WORDS], *tri])
    states = [[None, None] for _ in tokens]
    for k, order in ((0, range(len(tokens))), (1, reversed(range(len(tokens))))):
        s = [0.0] * HIDDEN
        for t in order:
            g = [p["b"][k][j] + sum(vectors[t][d] * p["w"][k][d][j] for d in range(2 * DIM)) for j in range(3 * HIDDEN)]
            dot = lambda v, j: sum(v[i] * p["u"][k][i][j] for i in range(HIDDEN))
            z = [sig(g[j] + dot(s, j)) for j in range(HIDDEN)]
            r = [sig(g[HIDDEN + j] + dot(s, HIDDEN + j)) for j in range(HIDDEN)]
            rs = [r[j] * s[j] for j in range(HIDDEN)]
            c = [math.tanh(g[2 * HIDDEN + j] + dot(rs, 2 * HIDDEN + j)) for j in range(HIDDEN)]
            s = [s[j] + z[j] * (c[j] - s[j]) for j in range(HIDDEN)]
            states[t][k] = s
    both = [a + b for a, b in states]
    e = [sum(p["v"][j] * math.tanh(sum(h[i] * p["att"][i][j] for i in range(2 * HIDDEN))) for j in range(HIDDEN)) for h in both]
    weight = [math.exp(x - max(e)) for x in e]
    pool = [sum(w * h[i] for w, h in zip(weight, both)) / sum(weight) for i in range(2 * HIDDEN)]
    return sum(pool[i] * p["out"][i] for i in range(2 * HIDDEN)) + p["bias"][0]


def plain_score(net, text):
    p = {k: v.astype(float).tolist() for k, v in net.p.items()}
    w = plain_words(text)
    starts = [*range(0, max(1, len(w) - WINDOW + 1), STRIDE)]
    if len(w) > WINDOW and starts[-1] + WINDOW < len(w):
        starts.append(len(w) - WINDOW)
    top = max(plain_logit(p, w[a:a + WINDOW]) for a in starts) if w else net.empty
    return 1 / (1 + math.exp(-(net.scale * top + net.shift)))


def test_scores_equal_a_plain_forward_pass():
    rng = np.random.default_rng(2)
    net = toxicity.BiGru()
    net.p["b"] = rng.standard_normal(net.p["b"].shape).astype(np.float32)
    net.p["bias"] = np.array([0.3], np.float32)
    net.scale, net.shift, net.empty = 0.7, -0.2, -1.1
    vocabulary = ["the", "Cat's", "ÉTÉ", "a", "日本", "x9", "word-play", "sun"]
    texts = [None, "", "...", "a", *(" ".join(rng.choice(vocabulary, n)) for n in (3, 20, 31, 32, 33, 60, 90))]
    got = toxicity.Scorer(net).scores(texts)
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-4)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    rows = toxicity.op9_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out and toxic is not null").collect()
    toxic = [r for r in rows if r.toxic == 1]
    assert len(toxic) > 20 and sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in rows if r.toxic == 0) <= 0.02 * len(rows)


# Quality

def letter_or_number(c):
    return unicodedata.category(c)[0] in "LN"


def plain_statistics(text):
    t = text or ""
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w]
    n, chars = len(words), len(t)
    share = lambda x, of: x / of if of else 0.0
    space = " \t\n\x0b\f\r"
    lines = [x for x in t.split("\n") if x]
    runs = lambda p: len(re.findall(p, t))
    echoes, i = 0, 0
    while i + 1 < n:  # a word that the next one repeats; matches don't overlap
        if words[i] == words[i + 1]:
            echoes += 1
        i += 1
    return {
        "chars": chars, "words": n, "word_length": share(chars, n),
        "symbols": share(sum(not letter_or_number(c) and c not in space and c not in ".," for c in t), chars),
        "capitals": share(runs("[A-Z]+[!A-Z]"), n) if False else share(capitals(t), n),
        "digits": share(runs("[0-9]+"), n), "stops": share(sum(c in ".,!?" for c in t), n),
        "sentences": share(sum(c in ".!?" and (i + 1 == chars or t[i + 1] in space) for i, c in enumerate(t)), n),
        "echoes": share(echoes, n), "one_letter": share(sum(len(w) == 1 for w in words), n),
        "line_words": share(n, len(lines)), "new_lines": share(len(set(lines)), len(lines)),
    }


def capitals(t):
    """Runs of capitals with an exclamation mark right behind; the run takes all its capitals."""
    return len(re.findall(r"(?<![A-Z])[A-Z]+!", t))


TEXTS = [None, "", " \n", "One two two three. Four!  FIVE! six, 77 8a9\nline two\nline two\n\nend", "É é ß 日本 x", "a a a b b", "WOW!NO!OH", "#$% (x) [y]",
         "word " * 300, "no stop at the end", "tab\there\x0bnow\x0cand\rso", "Hi!? Yes.No 3.5, 1,000", "the the", "x\n" * 50]


def test_statistics_equal_plain_python(frame):
    df = frame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    stats = quality.statistics(df["text"])
    for r in df.select("doc_id", *[c.alias(n) for n, c in stats.items()]).collect():
        want = plain_statistics(TEXTS[r.doc_id])
        for name, v in want.items():
            assert r[name] == pytest.approx(v), (name, TEXTS[r.doc_id])


# The label sample

def test_sample_is_bounded_with_repeated_rows(frame):
    docs = frame([(i % 5, f"text {i}", "x") for i in range(40)] + [(None, "t", "x"), (7, None, "x")], "doc_id long, text string, y string")
    labels = frame([(i % 8, i % 2, 1) for i in range(64)] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    for most in (1, 4, 100):
        rows = quality.sample(docs, labels, "quality", 3, 1, most).collect()
        ids = [r.doc_id for r in rows]
        assert len(ids) == len(set(ids)) <= most
        assert all(r.text == min(f"text {i}" for i in range(40) if i % 5 == r.doc_id) for r in rows if r.doc_id != 7)
        assert all(r.y == (r.doc_id % 2) for r in rows)
    assert len(quality.sample(docs, labels, "quality", 3, 1, 100).collect()) >= 3
