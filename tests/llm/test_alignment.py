import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from lossframe.llm import alignment as al

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def linked(sides, text):
    """(ids of A, ids of B, links, groups) by one walk over the bytes of both sides."""
    a, b = sides.encoded(text) if text else ([], [])
    owner = [[i for i, x in enumerate(ids) for _ in size[x]] for ids, size in ((a, sides.bytes_a), (b, sides.bytes_b))]
    links = sorted({(i, j) for i, j in zip(*owner)})
    groups, at = [], 0
    for k in range(len(owner[0])):
        if k + 1 == len(owner[0]) or owner[0][k] != owner[0][k + 1] and owner[1][k] != owner[1][k + 1]:
            own = [sorted(set(o[at:k + 1])) for o in owner]
            groups.append(([a[i] for i in own[0]], [b[j] for j in own[1]]))
            at = k + 1
    return a, b, [(a[i], b[j]) for i, j in links], groups


def brute(sides, texts):
    cut = [linked(sides, t) for t in texts]
    count = Counter(p for _, _, links, _ in cut for p in set(links))
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for a, b, links, groups in cut:
        spelt = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(spelt.encode()).hexdigest() if spelt else ""))
    return out, count, top


PARTS = ["the ", "a", "ing", " ", "  ", "\n", "é", "日本", "🤦", "123", "don't ", "Straße ", "▁", "\x00", "<|endoftext|>", "</s>", "qzx", "..."]


@pytest.fixture(scope="module")
def sides():
    return al.Sides(*PATHS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    some = ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(300)]
    return [None, "", " ", "the ", *some, *["the same short text"] * 200, "the long text, der lange Text " * 3000]


@pytest.mark.parametrize("docs, chars, runs", [(2048, 4_000_000, 64), (7, 200, 3)])
def test_alignment_equals_brute_force(frame, monkeypatch, sides, texts, docs, chars, runs):
    """Also with small blocks, so that each part takes many merges of many runs."""
    monkeypatch.setattr(al, "BLOCK_DOCS", docs)
    monkeypatch.setattr(al, "BLOCK_CHARS", chars)
    monkeypatch.setattr(al, "MERGED_RUNS", runs)
    df = frame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, keys string, block long")
    got = sorted(al.alignment(df, *PATHS).collect())
    want, count, top = brute(sides, texts)
    assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got] == want
    pairs = {(r.a, r.b): (r.n, r.best) for r in al.pair_counts(df, *PATHS).collect()}
    assert pairs == {p: (n, n == top[p[0]]) for p, n in count.items()}


def test_groups(frame, sides, texts):
    df = frame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in al.groups(df, *PATHS).collect():
        assert [(g.a, g.b) for g in r.groups] == linked(sides, texts[r.doc_id])[3]


def test_texts_that_are_not_spelt(sides):
    assert sides.encoded("a▁b") == ([], []) and sides.encoded("a<|endoftext|>b")[0]
    assert 50256 not in sides.encoded("<|endoftext|>")[0]


def test_frames(odd, empty):
    rows = al.alignment(odd, *PATHS).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.n_a == 0:
            assert tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "")
    repeated = [tuple(r) for r in rows if r.doc_id == 3]
    assert len(repeated) == 3 and len(set(repeated)) == 1
    assert al.alignment(empty, *PATHS).collect() == [] and al.pair_counts(empty, *PATHS).collect() == []


def test_counts_beyond_doubles(spark, sides, texts, frame, monkeypatch):
    """What a record adds is exact for counts of any size."""
    df = frame([(1, "the cat and the dog"), (2, "the cat")], "doc_id long, text string")
    runs = al.spilled(df, *PATHS)
    big = 3 ** 33
    counts = al.merged(runs, 1).selectExpr("part", "pair", f"n + {big}L as n")
    import numpy as np
    import zstandard
    total = sum(int(np.frombuffer(zstandard.decompress(bytes(r.keys)), np.int64).reshape(2, -1)[1].sum()) for r in al.contributions(runs, al.ranked(counts), 1).collect())
    want, _, _ = brute(sides, ["the cat and the dog", "the cat"])
    assert total == sum(w[5] for w in want) + big * sum(w[3] for w in want)
