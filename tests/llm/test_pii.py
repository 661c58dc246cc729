import random
import re

from lossframe.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 14 <= len(digits) <= 19 and luhn(digits) \
                    or kind == "phone" and 10 <= len(digits) <= 15:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def listed(df):
    found = pii.spans(df)
    rows = pii.with_added(found, pii.trained(found))
    return rows.select("doc.text", pii.listed("base").alias("base"), pii.listed("spans").alias("spans")).collect()


def test_base_spans_equal_brute_force(frame):
    rng = random.Random(3)
    parts = ["a", "B", "7", "1", "4", ".", "@", "-", " ", "+", "(", ")", "_", "%", "é", "🙂", "\n", "255", "10", ".1", "co", "4111111111111111", "+1 (4"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(1500)]
    texts += ["1" * 30_000, "1 " * 20_000, "a@" + "b." * 20_000, "a" * 50_000, "1." * 4_000, "a@b.co " * 300, "x@y.co_z@w.fr"]
    for r in listed(frame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")):
        assert r.base == brute(r.text), r.text[:100]
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))


def test_odd_rows_and_redaction(odd, empty):
    rows = listed(odd)
    assert len(rows) == odd.count() and all(r.base == brute(r.text) for r in rows)
    cut = pii.redacted(odd)
    assert cut.columns == odd.columns
    got = {r.doc_id: r.text for r in cut.collect()}
    assert got[9] == "[EMAIL] [IP] [PHONE]" and got[3] == "Hello the world" and got[0] is None
    assert listed(empty) == []


def test_reliabilities_find_the_odd_labeler():
    """Four labelers agree with the truth nine times in ten, the fifth is noise."""
    rng = random.Random(1)
    counts, truth = {}, {}
    for _ in range(4000):
        y = rng.random() < 0.4
        v = tuple((1 if y else -1) * (1 if rng.random() < 0.9 else -1) for _ in range(4)) + (rng.choice((-1, 1)),)
        counts[v] = counts.get(v, 0) + 1
        truth[v] = truth.get(v, 0) + y
    p, share = pii.reliabilities(counts)
    assert sum(abs(p[v] * n - truth[v]) for v, n in counts.items()) < 0.05 * 4000
    assert abs(share[4][1][1] - share[4][1][0]) < 0.1 and share[0][1][1] - share[0][1][0] > 0.7


def test_added_spans(frame):
    texts = [f"call me at +1 (415) 555-26{i:02d} or mail joe{i}@mail.example.com now" for i in range(40)]
    texts += [f"version 1.{i}.0 of 20{i:02d} costs 1234" for i in range(20)] + ["mail bob (at) example (dot) com please"]
    for r in listed(frame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")):
        assert r.spans.startswith(r.base) or r.base in r.spans
        if r.text.startswith("version"):
            assert r.spans == ""


def merged(base, taken):
    """Base spans, and the taken ones that overlap none of them nor one kept before, by plain loops."""
    meets = lambda a, b: a[0] < b[2] and b[0] < a[2]
    kept = []
    for x in sorted(taken):
        if not any(meets(x, b) for b in base) and not any(meets(x, k) for k in kept):
            kept.append(x)
    return sorted(base + kept)


def test_added_spans_equal_brute_force(frame):
    rng = random.Random(8)
    parts = ["(415) 555-2671", "joe (at) mail (dot) com", "joe@mail.com", "10[.]0[.]0[.]7", "10.0.0.7", "4111 1111 1111 1111", "4111.1111.1111.1111", "+1 415 555 2671",
             "0041 79 555 26 71", " ", " ", " call ", " card: ", ", ", "x", "7", "\n"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 30))) for _ in range(400)] + ["".join(rng.choices(parts, k=900)) for _ in range(3)]
    found = pii.spans(frame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    # weights that take many candidates of all kinds, so that they meet
    for weight in ({(k, ""): 1.0 for k in range(4)}, {(0, ""): 1.0, (1, ""): -1.0, (2, ""): 0.25, (2, "x.votes[0] = 1"): -1.0, (3, ""): 0.5}):
        rows = pii.with_added(found, weight).join(found.selectExpr("doc.doc_id as id", "cands"), pii.F.expr("doc.doc_id = id")).collect()
        assert len(rows) == len(texts)
        added = 0
        for r in rows:
            score = lambda c: weight.get((c.k, ""), 0) + (weight.get((c.k, "x.votes[0] = 1"), 0) if c.votes[0] == 1 else 0)
            base = [(b.start, b.k, b.end) for b in r.base]
            want = merged(base, [(c.start, c.k, c.end) for c in r.cands if score(c) > 0])
            assert [(x.start, x.k, x.end) for x in r.spans] == want, r.doc.text
            added += len(want) - len(base)
        assert added > 100


def test_candidates_are_where_they_are_said_to_be(frame):
    texts = ["é (415) 555-2671, joe [at] mail [dot] com; " * 70 + "10(.)0(.)0(.)9 " + "4111.1111.1111.1111 " * 70]
    r, = pii.spans(frame([(1, texts[0])], "doc_id long, text string")).collect()
    said = [(pii.KINDS[c.k], texts[0][c.start:c.end]) for c in r.cands]
    assert said == [("email", "joe [at] mail [dot] com")] * 70 + [("ip", "10(.)0(.)0(.)9")] + [("card", "4111.1111.1111.1111")] * 70 + [("phone", "(415) 555-2671")] * 70


def test_a_text_of_100_000_spans(frame):
    import time
    took = []
    for n in (3_125, 50_000):
        text = "a@b.co 10.0.0.1 " * n + "(415) 555-2671"
        df = frame([(1, text)], "doc_id long, text string")
        t = time.perf_counter()
        found = pii.spans(df)
        r, = pii.with_added(found, {(3, ""): 1.0, (0, ""): 1.0, (1, ""): 1.0}).collect()
        took.append(time.perf_counter() - t)
        assert len(r.base) == 2 * n and len(r.spans) == 2 * n + 1 and r.spans[-1].end == len(text) and r.spans[2 * n - 1].end == 16 * n - 1
    assert took[1] < 24 * took[0]
    said, = pii.redacted(df).collect()
    assert said.text.startswith("[EMAIL] [IP] " * 50_000)


def test_context_and_borders_vote(frame):
    texts = []
    for i in range(300):
        number = f"(415) 555-{i:04d}"
        texts.append(f"My phone is still {number}, call." if i % 3 else f"see order {number} soon")
        texts.append(f"reach me, {number} is my new mobile" if i % 3 == 1 else f"nothing said {number} here")
        texts.append(f"10 415-555-{i:04d} 22" if i % 2 else f"ref {number}.")
    found = pii.spans(frame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    votes = {(t.doc.text[:8], c.votes[2], c.votes[3]) for t in found.collect() for c in t.cands if c.k == 3}
    assert {v for _, v, _ in votes} == {-1, 0, 1} and {v for _, _, v in votes} >= {0, 1}
    assert ("My phone", 1, 1) in votes and ("see orde", -1, 1) in votes and ("nothing ", 0, 1) in votes and ("reach me", 1, 1) in votes
    rows = {(kind, name, vote): (other, personal) for kind, name, vote, other, personal in pii.reliability_rows(found)}
    gain = {name: sum(abs(rows["phone", name, v][1] - rows["phone", name, v][0]) for v in (-1, 0, 1)) for name in pii.LABELERS}
    assert gain["context"] > 0.2 and len({round(g, 2) for g in gain.values()}) >= 3


def test_query_columns(spark, sf):
    df = pii.op7_pii(spark, sf)
    assert df.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "has_pii"]
    for r in df.collect():
        assert r.n_spans == len(list(filter(None, r.spans.split(",")))) >= r.n_email + r.n_ip + r.n_card + r.n_phone and r.has_pii == (r.n_spans > 0)
