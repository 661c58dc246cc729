import re
from collections import Counter
from itertools import permutations
from math import factorial

import duckdb
import pytest

from lossframe.llm import filter_audit as fa


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def failed(docs):
    """Masks as sets of letters, by plain loops."""
    out = []
    for doc_id, text, *_ in docs:
        text = text or ""
        w = words(text)
        found = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)),
                 "E": doc_id is not None and any(o[0] is not None and o[0] < doc_id and (o[1] or "") == text for o in docs)}
        out.append({k for k, v in found.items() if v})
    return out


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    rows = [(d[2] or "", f, d[0] in good, d[0] in toxic) for d, f in zip(docs, failed(docs))]
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        total = Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, name in enumerate(order, 1):
                gone = [r for r in left if name in r[1]]
                before = len([r for r in own if name in r[1]]) - len(gone)
                left = [r for r in left if name not in r[1]]
                alone = sum(r[1] == {name} for r in own)
                out[part, "".join(order), k] = (len(left), len(gone), before, alone, sum(r[2] for r in gone), sum(r[3] for r in gone))
                total[name] += len(gone)
        for (p, order, k), v in out.items():
            if p == part:
                out[p, order, k] = (*v[:6], total[order[k - 1]])
    return out


LONG = " ".join(f"word{i}" for i in range(70))
SCHEMA = "doc_id long, text string, source string, digest string, part string, good int, least long"


def rows_of(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_audit_equals_brute_force(spark, frame, monkeypatch, broadcast):
    monkeypatch.setattr("lossframe.llm.common.BROADCAST_ROWS", broadcast)
    texts = [LONG, LONG, LONG + " #", "SHOUT " * 60, "a few", None, "", "the same " * 40, LONG + "\x0b\x0c x", LONG + "\x1fa b", "É" * 20 + "A", LONG + "Z" * 30,
             "É " + LONG, "x y " * 50, "y " * 99_999]
    docs = [(i * 7 % 31, t, [None, "", "s1", "s2"][i % 4]) for i, t in enumerate(texts * 2)]
    docs += [docs[0], docs[0], (None, LONG, "s1"), (None, None, None)]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 31, 2)] + [(0, 1, 1), (0, 0, 0), (3, None, 1), (None, 1, 1), (99, 1, 1)]
    df = frame([(*d, "d", "p", 5, 6) for d in docs], SCHEMA)
    lab = frame([(*x, "clash", "p") for x in labels], "doc_id long, quality int, toxic int, text string, part string")
    got = rows_of(fa.audit(fa.masks(df, lab)))
    assert got == brute(docs, labels)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    con.register("labels", lab.toPandas())
    # SQL compares null ids with nothing, as the operator does
    said = con.execute(fa.ORACLE).df()
    assert {tuple(r[:3]): tuple(r[3:]) for r in said.itertuples(index=False)} == got


def test_empty_tables(frame):
    labels = frame([], "doc_id long, quality int, toxic int")
    assert fa.audit(fa.masks(frame([], SCHEMA), labels)).collect() == []
    got = rows_of(fa.audit(fa.masks(frame([(1, LONG, "s", "d", "p", 1, 1)], SCHEMA), labels)))
    assert len(got) == 600 and set(got.values()) == {(1, 0, 0, 0, 0, 0, 0)}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_neighbour_swaps_meet_all_orders(n):
    order = list(range(n))
    seen = [tuple(order)]
    for k in fa.neighbour_swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        seen.append(tuple(order))
    assert len(seen) == len(set(seen)) == factorial(n)


def test_swaps_keep_the_diagram():
    """After any swaps the paths tell the same weights, and equal parts are held once."""
    weights = {m: (m % 7, m % 3, 1) for m in range(32) if m % 5}
    diagram = fa.Diagram("ABCDE", weights)
    for k in (0, 3, 1, 2, 0, 1, 3, 2):
        diagram.swap(k)
        for mask, w in weights.items():
            node = diagram.root
            for name in diagram.order:
                node = diagram.branch[node][mask >> (4 - "ABCDE".index(name)) & 1]
            assert diagram.weight[node] == w
        for level in diagram.levels:
            assert len(set(level.values())) == len(level)
    assert fa.Diagram("AB", {}).steps() == [("A", (), ()), ("B", (), ())]
