"""Personal data by weak supervision.

Base spans are fixed patterns of emails, ip addresses, card and phone numbers,
leftmost and non-overlapping for each kind, with the kinds' checks. Wider
patterns propose candidates, the base forms among them. Five labelers vote on
each candidate (1, -1, or 0 for no opinion): the base pattern, a gazetteer
(endings of domains, issuers' and countries' prefixes, reserved addresses),
words of its sentence before and after it, its borders (other signs, other
numbers), and its shape. Expectation-maximisation over the counts of vote
patterns estimates each labeler's reliability and each pattern's probability;
those probabilities train the final span classifier, a logistic regression on
the votes and on features of the span, which is compiled into a Spark
expression. A candidate that it accepts and that overlaps no base span and no
candidate accepted before it is added; base spans always stay.

All of it is Spark's own functions. Only counts by vote pattern and feature
reach the driver, at most ``MAX_PATTERNS`` rows. Positions are code points,
found by adding up the lengths of matches and of the gaps between them.

Cases: a null text counts as empty and has no spans; without candidates no
span is added; patterns run in linear time and without recursion on long
texts; repeated rows each get a row; an empty table gives no rows; given
columns pass through ``redacted`` untouched, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lossframe.llm.common import table, written

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "gazetteer", "context", "border", "shape")
MAX_PATTERNS = 50_000
#: Characters before and after a candidate that the context and border labelers read.
_LEFT, _RIGHT = 48, 32

_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
# Possessive forms of the contract's patterns: same matches, no backtracking into a run.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++(?:@|\x20?[\[({{]at[\])}}]\x20?){_LABEL}++(?:(?:\.|\x20?[\[({{]dot[\])}}]\x20?){_LABEL}++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}+){3}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[\x20._/-]{1,2}[0-9]{4}[\x20._/-]{1,2}[0-9]{4}[\x20._/-]{1,2}[0-9]{1,7})(?![0-9])",
    "phone": r"(?<![0-9+.-])(?:\+[0-9][\x20().0-9-]+[0-9]|00[1-9][\x20().0-9-]{7,20}[0-9]|\([0-9]{2,4}\)\x20?[0-9]{3,4}[\x20.-][0-9]{3,4}"
             r"|[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4})(?![0-9])",
}
_SPANS = "array<struct<start:int,end:int,said:string,left:string,right:string>>"


def _matches(t: Column, kind: str, pattern: str) -> Column:
    some = F.instr(t, "@") > 0 if pattern == BASE["email"] else t.rlike(r"@|[\[({]at[\])}]") if kind == "email" else t.rlike("[0-9]")
    return F.when(some, F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1))).otherwise(F.expr("cast(array() as array<string>)"))


def _placed(n: str) -> str:
    """SQL: spans of the matches ``m_<n>`` from the gaps between them, with the text at their borders.

    Starts are running sums of ``len_<n>``, the lengths of gap and match, first over blocks of 64 matches, then inside each.
    """
    return f"""flatten(transform(aggregate(sequence(0, (size(m_{n}) - 1) div 64), named_struct('at', 0, 'out', cast(array() as array<int>)),
            (a, b) -> named_struct('at', a.at + aggregate(slice(len_{n}, cast(b * 64 + 1 as int), 64), 0, (s, v) -> s + v), 'out', array_append(a.out, a.at)),
            a -> a.out),
        (o, b) -> aggregate(sequence(b * 64, least(b * 64 + 63, size(m_{n}) - 1)), named_struct('at', o, 'out', cast(array() as {_SPANS})),
            (a, i) -> named_struct('at', a.at + len_{n}[i], 'out', array_append(a.out, named_struct(
                'start', a.at + length(gaps_{n}[i]), 'end', a.at + len_{n}[i], 'said', m_{n}[i],
                'left', right(gaps_{n}[i], {_LEFT}), 'right', left(gaps_{n}[i + 1], {_RIGHT})))),
            a -> a.out)))"""


def _luhn(digits: str) -> str:
    """SQL: the digits pass Luhn's check."""
    return (f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + if((length({digits}) - i) % 2 = 0, cast(substr({digits}, i, 1) as int), "
            f"cast(substr({digits}, i, 1) as int) * 2 - if(cast(substr({digits}, i, 1) as int) > 4, 9, 0))) % 10 = 0")


def _valid(kind: str, x: str) -> str:
    """SQL: the kind's check of the matched text ``x``."""
    digits = f"regexp_replace({x}, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": f"forall(split({x}, '[.]'), p -> length(ltrim('0', p)) = 0 or length(ltrim('0', p)) <= 3 and cast(ltrim('0', p) as int) <= 255)",
        "card": f"length({digits}) between 14 and 19 and {_luhn(digits)}",
        "phone": f"length({digits}) between 10 and 15",
    }[kind]


def _votes(kind: str, x: str) -> list[str]:
    """SQL of the five labelers' votes on candidate ``x``."""
    said, left, right = f"{x}.said", f"{x}.left", f"{x}.right"
    plain = f"regexp_replace(regexp_replace({said}, ' ?[\\\\[({{{{]at[\\\\])}}}}] ?', '@'), ' ?[\\\\[({{{{]?(dot|[.])[\\\\])}}}}] ?', '.')".replace("{{", "{").replace("}}", "}")
    digits = f"regexp_replace({said}, '[^0-9]', '')"
    # Joined to a letter or sign it is part of something else; next to another number it may be one of a row of figures.
    tight = (f"if({left} rlike '[\\\\p{{L}}0-9_/=#&]$' or {right} rlike '^[\\\\p{{L}}0-9_/=&]', -1, "
             f"if({left} rlike '[0-9][\\\\s,;|]{{1,2}}$' or {right} rlike '^[\\\\s,;|]{{1,2}}[0-9]', 0, 1))")
    # A word against it right before it counts most; else one for it in the same sentence, before or after.
    cue = lambda words, against="never": (
        f"if({left} rlike '(?i)\\\\b({against})[^\\\\p{{L}}0-9]*$', -1, if({left} rlike '(?i)\\\\b({words})\\\\b[^.!?\\\\n]*$' "
        f"or {right} rlike '(?i)^[^.!?\\\\n]*\\\\b({words})\\\\b', 1, 0))")
    base = BASE[kind].replace("\\G|", "").replace("\\", "\\\\")
    strict = f"if({said} rlike '^(?:{base})$' and {_valid(kind, said)}, 1, -1)"
    ip = f"split(regexp_replace({said}, '[\\\\[\\\\]()]', ''), '[.]')"
    return {
        "email": [strict, f"if(lower({plain}) rlike '[.](com|org|net|edu|gov|info|io|[a-z]{{2}})$', 1, -1)",
                  cue("e-?mail|mail|contact|write|reach|address|inbox|correo|courriel", "user|repo|package|git|clone|import"), tight, f"if(split({plain}, '@')[0] rlike '[A-Za-z0-9].*' and length({said}) <= 254, 1, -1)"],
        "ip": [strict, f"if(get({ip}, 0) in ('0', '127', '255'), -1, 0)", cue("ip|server|host|addr|address|login|network|router|client", "version|ver|v|release|section|rev"), tight,
               f"if(forall({ip}, p -> p = '0' or p not like '0%') and forall({ip}, p -> length(p) <= 3 and cast(p as int) <= 255), 1, -1)"],
        "card": [strict, f"if({digits} rlike '^(4|5[1-5]|2[2-7]|3[0-9]|6)', 1, -1)", cue("card|visa|mastercard|amex|credit|karte|carte|tarjeta", "order|id|ref|no|number|isbn"),
                 tight, f"if(length({digits}) between 13 and 19 and {_luhn(digits)}, 1, -1)"],
        "phone": [strict, f"if({said} rlike '^([+]|00)[1-9]', 1, 0)", cue("tel|phone|call|fax|mobile|cell|telefon|appel", "order|id|ref|date|isbn|version"), tight,
                  f"if(length({digits}) between 9 and 15 and length({said}) <= 2 * length({digits}), 1, -1)"],
    }[kind]


def spans(docs: DataFrame) -> DataFrame:
    """The written documents as ``doc``, with ``base`` spans (start, k, end) and ``cands`` (k, start, end, votes, digits)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).withColumn("t", F.coalesce("doc.text", F.lit("")))
    sets = [(f"{name}_{k}", k, p) for name, group in (("base", BASE), ("wide", WIDE)) for k, p in group.items()]
    # Columns of their own, not structs, so that no step is computed again inside the next one's lambdas.
    rows = rows.select("doc", "t", *[_matches(F.col("t"), k, p).alias(f"m_{n}") for n, k, p in sets])
    rows = rows.select("doc", *[f"m_{n}" for n, _, _ in sets], *[F.when(F.size(f"m_{n}") > 0, F.split("t", p)).alias(f"gaps_{n}") for n, _, p in sets])
    rows = rows.select("*", *[F.expr(f"transform(if(size(m_{n}) > 0, m_{n}, null), (x, i) -> length(gaps_{n}[i]) + length(x))").alias(f"len_{n}")
                              for n, _, _ in sets])
    none = F.expr(f"cast(array() as {_SPANS})")
    rows = rows.select("doc", *[F.when(F.size(f"m_{n}") > 0, F.expr(_placed(n))).otherwise(none).alias(n) for n, _, _ in sets])
    base = [F.expr(f"transform(filter(base_{k}, x -> {_valid(k, 'x.said')}), x -> named_struct('start', x.start, 'k', {i}, 'end', x.end))") for i, k in enumerate(KINDS)]
    cand = [F.expr(f"transform(wide_{k}, x -> named_struct('k', {i}, 'start', x.start, 'end', x.end, 'votes', array({', '.join(_votes(k, 'x'))}), "
                   f"'digits', least(20, length(regexp_replace(x.said, '[^0-9]', '')))))") for i, k in enumerate(KINDS)]
    return written(rows.select("doc", F.array_sort(F.concat(*base)).alias("base"), F.concat(*cand).alias("cands")), "pii-spans")


def reliabilities(counts: dict[tuple, float], rounds: int = 50) -> tuple[dict[tuple, float], list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation for one kind: the probability of each vote pattern, and for each labeler P(vote | other), P(vote | personal)."""
    p = {v: 1 / (1 + math.exp(-sum(v))) for v in counts}  # starts from the majority
    share: list[dict[int, tuple[float, float]]] = []
    for _ in range(rounds):
        yes, no = (sum(n * (p[v] if c else 1 - p[v]) for v, n in counts.items()) for c in (1, 0))
        share = []
        for j in range(len(LABELERS)):
            sums = {vote: [1.0, 1.0] for vote in (-1, 0, 1)}
            for v, n in counts.items():
                sums[v[j]][1] += n * p[v]
                sums[v[j]][0] += n * (1 - p[v])
            share.append({vote: (s[0] / (no + 3), s[1] / (yes + 3)) for vote, s in sums.items()})
        prior = math.log((yes + 1) / (no + 1))
        p = {v: 1 / (1 + math.exp(-max(-30.0, min(30.0, prior + sum(math.log(share[j][x][1] / share[j][x][0]) for j, x in enumerate(v)))))) for v in counts}
    return p, share


def reliability_rows(found: DataFrame) -> list[tuple[str, str, int, float, float]]:
    """(kind, labeler, vote, P(vote | other), P(vote | personal)) as estimated from the candidates of ``spans``."""
    by_kind: dict[int, dict[tuple, float]] = {}
    for k, votes, _, n in _vote_counts(found):
        own = by_kind.setdefault(k, {})
        own[votes] = own.get(votes, 0.0) + n
    return [(KINDS[k], LABELERS[j], vote, *p) for k, counts in sorted(by_kind.items()) for j, share in enumerate(reliabilities(counts)[1]) for vote, p in sorted(share.items())]


def _features(k: int, votes: tuple, digits: int) -> list[tuple[int, str]]:
    return [(k, ""), (k, f"size(x.votes) > 0 and x.digits between {digits - digits % 3} and {digits - digits % 3 + 2}"),
            *((k, f"x.votes[{j}] = {v}") for j, v in enumerate(votes))]


def classifier(rows: list[tuple[int, tuple, int, float]], rounds: int = 400) -> dict[tuple[int, str], float]:
    """Logistic weights of (kind, condition) from counted (kind, votes, digits, n), with the probabilities of EM as labels."""
    weight: dict[tuple[int, str], float] = {}
    for k in range(len(KINDS)):
        own = [(votes, digits, n) for kind, votes, digits, n in rows if kind == k]
        if not own:
            continue
        counts: dict[tuple, float] = {}
        for votes, _, n in own:
            counts[votes] = counts.get(votes, 0.0) + n
        p, _ = reliabilities(counts)
        total = sum(n for _, _, n in own)
        data = [(_features(k, votes, digits), p[votes], n / total) for votes, digits, n in own]
        for _ in range(rounds):
            grad: dict[tuple[int, str], float] = {}
            for fs, y, n in data:
                d = n * (y - 1 / (1 + math.exp(-sum(weight.get(f, 0.0) for f in fs))))
                for f in fs:
                    grad[f] = grad.get(f, 0.0) + d
            for f, d in grad.items():
                weight[f] = weight.get(f, 0.0) + 0.5 * (d - 1e-4 * weight.get(f, 0.0))
    return weight


def _vote_counts(found: DataFrame) -> list[tuple[int, tuple, int, float]]:
    """(kind, votes, digits, candidates), the most frequent first, ``MAX_PATTERNS`` at most."""
    counts = (found.select(F.explode("cands").alias("x")).groupBy("x.k", "x.votes", "x.digits").agg(F.count("*").alias("n"))
              .orderBy(F.desc("n"), "k", "votes", "digits").limit(MAX_PATTERNS).collect())
    return [(r["k"], tuple(r["votes"]), r["digits"], float(r["n"])) for r in counts]


def trained(found: DataFrame) -> dict[tuple[int, str], float]:
    """The classifier for the candidates of ``spans``."""
    return classifier(_vote_counts(found))


_EDGE = "struct<start:int,k:int,end:int,own:int>"


def _swept(items: str, start: int, keep: str, after: str) -> str:
    """SQL: the x of the column ``items`` that pass ``keep``, walked in their order with a number ``at``, which ``after`` moves on.

    First ``at`` alone, noted at every 64th x, then 64 at a time, as a growing array is copied at each step; by position, as a
    slice of an array looks at all of it.
    """
    of = lambda sql, at: sql.replace("at.", at).replace("x.", f"{items}[i].")
    block = f"sequence(b * 64, least(b * 64 + 63, size({items}) - 1))"
    return f"""if(size({items}) = 0, cast(array() as array<{_EDGE}>), flatten(transform(
        aggregate(sequence(0, (size({items}) - 1) div 64), named_struct('at', {start}, 'out', cast(array() as array<int>)),
            (a, b) -> named_struct('at', aggregate({block}, a.at, (c, i) -> {of(after, 'c')}), 'out', array_append(a.out, a.at)), a -> a.out),
        (o, b) -> aggregate({block}, named_struct('at', o, 'out', cast(array() as array<{_EDGE}>)),
            (a, i) -> named_struct('at', {of(after, 'a.at')}, 'out', if({of(keep, 'a.at')}, array_append(a.out, {items}[i]), a.out)), a -> a.out))))"""


def with_added(found: DataFrame, weight: dict[tuple[int, str], float]) -> DataFrame:
    """doc, base, and ``spans``: the base spans and the accepted candidates, by start, then kind.

    A candidate that overlaps a base span, or one accepted before it in this order, is left out. Two walks over the
    sorted spans find that: from the end, with the start of the next base span, and from the start, with the furthest end.
    """
    score = " ".join(f"+ if(x.k = {k}{' and ' + when if when else ''}, {w!r}D, 0D)" for (k, when), w in weight.items())
    if not score:
        return found.select("doc", "base", F.col("base").alias("spans"))
    edge = "named_struct('start', x.start, 'k', x.k, 'end', x.end, 'own', {})"
    rows = found.withColumn("taken", F.expr(f"filter(cands, x -> 0D {score} > 0D)"))
    rows = rows.withColumn("edges", F.expr(f"if(size(taken) = 0, cast(array() as array<{_EDGE}>), reverse(array_sort(concat(transform(base, x -> {edge.format(0)}), "
                                           f"transform(taken, x -> {edge.format(1)})))))"))
    last = 2**31 - 1
    rows = rows.withColumn("clear", F.expr("reverse(" + _swept("edges", last, "x.own = 0 or x.end <= at.", "if(x.own = 0, least(at., x.start), at.)") + ")"))
    rows = rows.withColumn("all", F.expr(_swept("clear", 0, "x.own = 0 or x.start >= at.", "if(x.own = 0 or x.start >= at., greatest(at., x.end), at.)")))
    return rows.select("doc", "base", F.expr("if(size(taken) = 0, base, transform(all, x -> named_struct('start', x.start, 'k', x.k, 'end', x.end)))").alias("spans"))


def listed(c: str) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({c}, x -> concat(element_at({names}, x.k + 1), ':', x.start, ':', x.end)), ',')")


def redacted(docs: DataFrame) -> DataFrame:
    """The given rows with each span of ``text`` replaced by its kind in brackets, columns as given.

    Of overlapping spans the first one's kind stands. The text is cut at every 64th span, then each stretch at its own spans,
    as a position in a text is found by counting from its start.
    """
    found = spans(docs)
    rows = with_added(found, trained(found)).withColumn("edges", F.expr(
        f"transform(spans, x -> cast(named_struct('start', x.start, 'k', x.k, 'end', x.end, 'own', 1) as {_EDGE}))"))
    rows = rows.withColumn("clear", F.expr(_swept("edges", 0, "x.start >= at.", "if(x.start >= at., x.end, at.)")))
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    before = "if({0} = 0, 0, clear[{0} - 1].end)"
    rows = rows.withColumn("stretches", F.expr(f"""transform(sequence(0, (size(clear) - 1) div 64), b -> named_struct(
        'from', {before.format('(b * 64)')}, 'first', b * 64, 'last', least(b * 64 + 63, size(clear) - 1),
        'said', substr(doc.text, {before.format('(b * 64)')} + 1, clear[least(b * 64 + 63, size(clear) - 1)].end - {before.format('(b * 64)')})))"""))
    cut = F.expr(f"""concat(array_join(flatten(transform(stretches, s -> transform(sequence(s.first, s.last), i -> concat(
        substr(s.said, {before.format('i')} - s.from + 1, clear[i].start - {before.format('i')}), element_at({names}, clear[i].k + 1))))), ''),
        substr(doc.text, element_at(clear, -1).end + 1))""")
    return rows.select(*[(F.when(F.size("clear") > 0, cut).otherwise(F.col("doc.text")) if c == "text" else F.col("doc").getField(c)).alias(c)
                         for c in docs.columns])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = with_added(found, trained(found))
    count = lambda i: F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")
    return rows.select("doc.doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                       F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"),
                       F.size("spans").cast("long").alias("n_spans"), (F.size("spans") > 0).alias("has_pii"))
