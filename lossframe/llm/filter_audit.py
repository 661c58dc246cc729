"""What each filter of a chain removes, in every order of the filters, by decision diagrams.

Spark turns each document into a mask of the filters it fails and counts masks
by part; at most 2^n counts of a part are left, however many documents it has.
For each part a decision diagram is built: a level for each filter, from each
node a pass and a fail branch, equal sub-diagrams shared, empty ones left out,
and at each node the weight (documents, good, toxic) of all masks below it. Two
neighbouring filters change places by a swap of their levels, which changes only
the nodes of those two; one swap leads from each order to the next, so all
orders are met with n! - 1 swaps. In an order, the path of passes from the root
gives each step: the weight of the fail branch is removed there, that of the
pass branch is kept. The step of a filter that stands first tells all that
fail it, that of a filter that stands last all that fail it alone.

The parts are rows of their own and are worked on in parallel.

Equality of texts goes by their SHA-256. A text counts as a repeat if a smaller
doc_id has the same text anywhere in the table; rows with the same doc_id are no
repeats of each other, and a null doc_id neither repeats nor is repeated.

Cases: a null text counts as empty, a null source as the empty part, a document
without a row in ``labels`` as neither good nor toxic; of several such rows any
with 1 counts; repeated rows count each; a text of any length is read whole; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lossframe.llm.common import small_side, table, written

_SPACE = r"[\x20\x09-\x0D]+"


def text_conditions(text: Column) -> dict[str, Column]:
    """Failure conditions on one text: A few words, B few different words, C many capitals, D odd signs."""
    words = F.filter(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 50,
        "B": 100 * distinct.cast("long") < 65 * n.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def repeats(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, digest, ...) with ``again``: whether a smaller doc_id has the same digest.

    The least doc_id of a digest is found with partial sums before the shuffle;
    only digests with two doc_ids or more are joined back, as a written table,
    so that Spark splits the rows of a hot digest.
    """
    least = written(rows.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
                    .filter("least < most").select("digest", "least"), "audit-repeats")
    return rows.join(small_side(least, least.count()), "digest", "left").withColumn("again", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask of the filters A to E they fail, A in the highest bit."""
    text = docs.select("doc_id", F.coalesce("source", F.lit("")).cast("string").alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    fails = list(text_conditions(F.col("text")).values())
    bits = sum((f.cast("int") * 2 ** (len(fails) - i) for i, f in enumerate(fails)), F.lit(0))
    rows = repeats(written(text.select("doc_id", "part", bits.alias("bits"), F.unhex(F.sha2("text", 256)).alias("digest")), "audit-rows"))
    marked = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"), F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("toxic"))
    of = rows.select("doc_id", "part", (F.col("bits") + F.col("again").cast("int")).alias("mask")).join(marked, "doc_id", "left")
    return of.groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


class Diagram:
    """Decision diagram of weighted masks; nodes are (pass branch, fail branch), 0 is the empty diagram."""

    def __init__(self, order: str, weights: dict[int, tuple[int, ...]]):
        """``weights`` by mask, whose highest bit is the first filter of ``order``."""
        self.order = list(order)
        self.weight: list[tuple[int, ...]] = [tuple(0 for _ in next(iter(weights.values()), ()))]
        self.branch: list[tuple[int, int]] = [(0, 0)]
        self.levels: list[dict[tuple[int, int], int]] = [{} for _ in order]
        ends: dict[tuple[int, ...], int] = {}  # equal weights share a leaf
        below = {m: self._new(ends, w, w, (0, 0)) for m, w in weights.items() if any(w)}
        for level in reversed(range(len(order))):
            below = {m: self._node(level, below.get(2 * m, 0), below.get(2 * m + 1, 0)) for m in {m >> 1 for m in below}}
        self.root = below.get(0, 0)

    def _new(self, known: dict, key: tuple, weight: tuple[int, ...], branch: tuple[int, int]) -> int:
        if key not in known:
            known[key] = len(self.weight)
            self.weight.append(weight)
            self.branch.append(branch)
        return known[key]

    def _node(self, level: int, passes: int, fails: int) -> int:
        if not passes and not fails:
            return 0
        return self._new(self.levels[level], (passes, fails), tuple(map(sum, zip(self.weight[passes], self.weight[fails]))), (passes, fails))

    def swap(self, level: int) -> None:
        """Let the filters of ``level`` and the next change places; nodes keep their numbers and what they stand for."""
        upper = self.levels[level].values()
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]
        self.levels[level], self.levels[level + 1] = {}, {}
        for node in upper:
            (pp, pf), (fp, ff) = (self.branch[b] for b in self.branch[node])
            both = self._node(level + 1, pp, fp), self._node(level + 1, pf, ff)
            self.branch[node] = both
            self.levels[level][both] = node

    def steps(self) -> list[tuple[str, tuple[int, ...], tuple[int, ...]]]:
        """(filter, kept, removed) along the path of passes."""
        out, node = [], self.root
        for name in self.order:
            node, fails = self.branch[node]
            out.append((name, self.weight[node], self.weight[fails]))
        return out


def neighbour_swaps(n: int) -> Iterator[int]:
    """Places to swap with the next one, so that all orders of n things are met, each once."""
    if n < 2:
        return
    up, inner = False, neighbour_swaps(n - 1)
    while True:
        yield from range(n - 1) if up else range(n - 2, -1, -1)
        step = next(inner, None)
        if step is None:
            return
        up = not up
        yield step + up  # the last thing stands in front after a walk to the left


def audited(part: str, names: str, weights: dict[int, tuple[int, int, int]]) -> list[tuple]:
    """A row for each order and step of one part."""
    diagram, paths = Diagram(names, weights), {}
    for swap in (None, *neighbour_swaps(len(names))):
        if swap is not None:
            diagram.swap(swap)
        paths["".join(diagram.order)] = diagram.steps()
    alone, first, total = {}, {}, dict.fromkeys(names, 0)
    for steps in paths.values():
        first[steps[0][0]], alone[steps[-1][0]] = steps[0][2][0], steps[-1][2][0]
        for name, _, removed in steps:
            total[name] += removed[0]
    return [(part, "".join(order), k, kept[0], gone[0], first[name] - gone[0], alone[name], gone[1], gone[2], total[name])
            for order in permutations(names) for k, (name, kept, gone) in enumerate(paths["".join(order)], 1)]


COLUMNS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(counted: DataFrame, names: str = "ABCDE") -> DataFrame:
    """Steps of all orders of the filters ``names`` for each part of (part, mask, n, good, toxic)."""

    def orders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads = [c.split()[0] for c in COLUMNS.split(", ")]
        for batch in batches:
            for part, found in zip(batch["part"], batch["masks"]):
                yield pd.DataFrame(audited(part, names, {x["mask"]: (x["n"], x["good"], x["toxic"]) for x in found}), columns=heads)

    # at most 2^n masks of a part come together
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    return parts.mapInPandas(orders, COLUMNS)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


_ORDERS = """select a || b || c || d || e as filter_order, [a, b, c, d, e] as names
    from (values ('A'), ('B'), ('C'), ('D'), ('E')) t1(a), (values ('A'), ('B'), ('C'), ('D'), ('E')) t2(b), (values ('A'), ('B'), ('C'), ('D'), ('E')) t3(c),
         (values ('A'), ('B'), ('C'), ('D'), ('E')) t4(d), (values ('A'), ('B'), ('C'), ('D'), ('E')) t5(e)
    where len(list_distinct([a, b, c, d, e])) = 5"""
ORACLE = f"""
with texts as (
    select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents
), cut as (
    select *, list_filter(string_split_regex(text, '{_SPACE}'), lambda w: w <> '') as words from texts
), least as (
    select text, min(doc_id) as least from texts group by text
), marked as (
    select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id
), failed as (
    select c.part, coalesce(m.good, 0) as good, coalesce(m.toxic, 0) as toxic,
        case when len(words) < 50 then 'A' else '' end
        || case when 100 * len(list_distinct(words)) < 65 * len(words) then 'B' else '' end
        || case when 100 * length(regexp_replace(c.text, '[^A-Z]', '', 'g')) > 5 * length(c.text) then 'C' else '' end
        || case when regexp_matches(c.text, '[#$%&*|]') then 'D' else '' end
        || case when c.doc_id > l.least then 'E' else '' end as fails
    from cut c join least l on c.text = l.text left join marked m on c.doc_id = m.doc_id
), counted as (
    select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from failed group by part, fails
), orders as ({_ORDERS}
), steps as (
    select filter_order, k as step, names[k] as name, names[1:k - 1] as before from orders, (select unnest([1, 2, 3, 4, 5])::int as k)
), judged as (
    select c.part, s.filter_order, s.step, s.name, c.n, c.good, c.toxic, contains(c.fails, s.name) as hit, c.fails = s.name as alone,
        len(list_filter(s.before, lambda b: contains(c.fails, b))) > 0 as gone
    from counted c cross join steps s
), summed as (
    select part, filter_order, step, name,
        sum(case when not hit and not gone then n else 0 end) as kept, sum(case when hit and not gone then n else 0 end) as removed,
        sum(case when hit and gone then n else 0 end) as redundant, sum(case when alone then n else 0 end) as unique_fails,
        sum(case when hit and not gone then good else 0 end) as good_lost, sum(case when hit and not gone then toxic else 0 end) as toxic_lost
    from judged group by part, filter_order, step, name
)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
    good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, name))::bigint as shapley
from summed
"""
