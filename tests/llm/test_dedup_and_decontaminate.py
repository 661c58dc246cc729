import hashlib
import re
from collections import Counter, defaultdict

import pytest

from lossframe.llm import decontaminate, exact_dedup

WORDS = [a + b for a in "ab cd ef gh ij kl mn op".split() for b in "a e i o u".split()]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, n=13):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[i:i + k])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (g := tuple(w[i:i + k])) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[g] - {"None"}
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(w)))
    return Counter(out)


@pytest.fixture(scope="module")
def contaminated(frame):
    passage = "One two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    docs = [(1, passage), (2, "x " * 400 + passage), (3, passage.upper() + "! " + passage), (4, "alpha beta"), (5, "no ALPHA, beta's here"), (6, None),
            (7, ""), (8, "one two three four five six seven eight nine ten eleven twelve"), (9, "é one " + passage + " É"), (9, "other"), (9, "other")]
    items = [(10, passage), (2, "zero " + passage.lower()), (3, "alpha beta"), (4, None), (5, "--"), (10, passage), (None, "solo")]
    return docs, items, frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")


def rows(df):
    return Counter(map(tuple, df.select("doc.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()))


@pytest.mark.parametrize("most", [50_000, 0])
def test_decontaminate_equals_brute_force(contaminated, monkeypatch, most):
    docs, items, d, b = contaminated
    monkeypatch.setattr(decontaminate, "MAX_GRAMS", most)  # 0: by a shuffled join
    assert rows(decontaminate.report(d, b)) == brute(docs, items)  # the item without an id hits and is not counted
    kept = decontaminate.clean_documents(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in brute(docs, items).elements() if not r[5])


def test_decontaminate_of_a_large_benchmark(frame, monkeypatch):
    """More windows than the plan holds, an item text that thousands of items share, and a window in a third of the documents."""
    import random
    rng = random.Random(4)
    said = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    items = [(i, said(rng.choice((1, 2, 5, 13, 20, 40)))) for i in range(3000)] + [(10_000 + i, "a passage that very many of the items share with each other and more") for i in range(3000)]
    docs = [(i, said(rng.randint(0, 60))) for i in range(300)]
    docs += [(1000 + i, said(20) + " " + rng.choice(items)[1] + " " + said(9)) for i in range(150)] + [(2000 + i, "so: " + items[-1][1].upper()) for i in range(150)]
    d, b = frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")
    want = brute(docs, items)
    monkeypatch.setattr(decontaminate, "MAX_GRAMS", 1000)
    assert rows(decontaminate.report(d, b)) == want
    monkeypatch.setattr("lossframe.llm.common.BROADCAST_ROWS", 0)
    assert rows(decontaminate.report(d, b)) == want


def test_decontaminate_cuts_spans(contaminated):
    docs, _, d, b = contaminated
    got = {r.doc_id: r.text for r in decontaminate.clean_spans(d, b).collect()}
    assert got[1] == "" and got[4] == "" and got[5] == "no's here" and got[6] is None and got[9] == "other"
    assert got[2] == ("x " * 400).rstrip() and got[3] == ""


def test_decontaminate_odd_rows(odd, empty, contaminated):
    _, items, _, b = contaminated
    assert decontaminate.clean_documents(odd, b).columns == odd.columns
    assert decontaminate.clean_documents(odd, b).count() == odd.count()
    assert decontaminate.report(empty, b).count() == 0
    assert not decontaminate.report(odd, b.limit(0)).filter("n_hit > 0 or contaminated").count()


def copies(docs):
    groups = defaultdict(list)
    for doc_id, text in docs:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return Counter(out)


@pytest.mark.parametrize("files,chars", [(None, 64), (1, 64), (None, 1), (None, 0)])
def test_exact_dedup_equals_brute_force(odd, files, chars):
    """In one batch and in several; with digests that collide, the texts decide."""
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = exact_dedup.duplicates(odd.repartition(5), files, chars).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == copies(docs)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_keeps_columns(odd, empty, monkeypatch):
    monkeypatch.setattr(exact_dedup, "ROWS_PER_SALT", 1)
    kept = exact_dedup.deduplicated(odd)
    assert kept.columns == odd.columns
    assert kept.count() == len({k[3] for k in copies([(r.doc_id, r.text) for r in odd.collect()])})
    assert kept.filter("doc_id = 3 and `row_id` = 7 and digest = 'd'").count() == 1
    assert exact_dedup.duplicates(empty).count() == 0
