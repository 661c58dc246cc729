import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from lossframe.llm import simhash


def brute_fingerprint(text, n=4):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance):
    """{id: least id reachable} for {id: fingerprint}."""
    ids = sorted(fps)
    a = np.array([fps[i] for i in ids], np.uint64)
    up = list(range(len(ids)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= distance) + i + 1:
            x, y = root(i), root(int(j))
            up[max(x, y)] = min(x, y)
    return {x: ids[root(i)] for i, x in enumerate(ids)}


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "a b c", "A b C d", "É b c d e", "x " * 1000, "a\x0bb\x1cc\xa0d e f g h"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % 2**64 == brute_fingerprint(text)


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(str(i * i % 977) for i in range(5000))
    monkeypatch.setattr(simhash, "_CHUNK", 37)
    assert simhash.fingerprint(text) % 2**64 == brute_fingerprint(text)


@pytest.mark.parametrize("distance", range(1, 9))
def test_some_shared_key_for_every_link(distance):
    """Every pair within the distance has a start whose chain is viable and a key of that start in common."""
    rng, ring = random.Random(distance), simhash.Ring(distance)

    def bits(x, p, a, b):
        r, n = ring.edge[p], 64
        rot = ((x << r) | (x >> (n - r))) % 2**64 if r else x
        o, w = ring.bits(p, a, b)
        return rot >> (64 - o - w) & ((1 << w) - 1)

    for _ in range(300):
        x = y = rng.getrandbits(64)
        for b in rng.sample(range(64), distance):
            y ^= 1 << b
        starts = [p for p in range(ring.m) if ring.viable(np.array([x ^ y], np.uint64), np.array([p]))[0]]
        assert any(bits(x, p, 0, 3) == bits(y, p, 0, 3) and (bits(x, p, 3, 5) == bits(y, p, 3, 5) or bits(x, p, 5, 7) == bits(y, p, 5, 7)) for p in starts)


@pytest.mark.parametrize("block", [1024, 24])
def test_components_equal_brute_force(frame, monkeypatch, block):
    rng = random.Random(4)
    monkeypatch.setattr(simhash, "BLOCK", block)
    flip = lambda x, k: x ^ sum(1 << b for b in rng.sample(range(64), k))
    fps = {rng.getrandbits(64) for _ in range(100)}
    for _ in range(2):
        base = cur = rng.getrandbits(64)
        for _ in range(80):
            fps.add(flip(base, rng.randint(0, 4)))
            cur = flip(cur, rng.randint(1, 6))  # a chain, with breaks
            fps.add(cur)
    fps = list(fps)
    signed = lambda x: x - 2**64 if x >> 63 else x
    rows = frame([(i, i, signed(x)) for i, x in enumerate(fps)], "row_id long, doc_id long, fp long")
    got = {r.fp: r.first.doc_id for r in simhash.groups(rows, 4).collect()}
    assert {i: got[signed(x)] for i, x in enumerate(fps)} == brute_components(dict(enumerate(fps)), 4)


def test_odd_rows(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((d, f"{brute_fingerprint(t):016x}") for d, t in rows)
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in got)
    assert all(r.doc_id == r.component_id for r in got if r.kept)
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_distance_out_of_range():
    with pytest.raises(ValueError):
        simhash.Ring(0)
