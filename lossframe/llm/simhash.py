"""SimHash near-duplicates found by pigeonring filtering.

A document's fingerprint has a bit set where over half of its shingles'
XXH64 hashes (seed 42) have it set. Fingerprints link at ``distance`` or fewer
differing bits. Only distinct fingerprints are compared, so copies of one text
meet once.

Pigeonring: cut the 64 bits into a ring of ``m = 4 * distance`` segments. If
two fingerprints differ in at most ``distance`` bits, some segment starts a
chain in which, for every length l, the first l segments differ in at most
``l * distance / m`` bits. So the first three segments of that chain are equal
and the next four differ in one bit at most, hence two of them, the first or
the last pair, are equal too. Each fingerprint is filed under both such keys
for each start; two that share a key are candidates, go through the chain's
budgets and then the full Hamming check.

Large buckets: a bucket of over ``BLOCK`` fingerprints is cut into blocks.
First each block is searched by itself. With the components so far, only
fingerprints outside a bucket's largest component still need comparing with
the rest, which is done block against block: no task sees more than two
blocks, and inside one only a spanning forest of the links is returned.

Cases: a null or blank text has fingerprint 0, linked like any other; a text
of fewer than four words has one shingle; a null doc_id counts as larger than
any other; rows with one doc_id are rows of their own in ``groups``; an empty
table gives no rows; given columns pass through ``one_of_each`` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from lossframe.llm.common import slices, small_side, table, written
from lossframe.llm.components import components

BLOCK = 1024
#: Shingles hashed at a time.
_CHUNK = 1 << 16
_SMALL = 16


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The fingerprint as a signed long."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and the white space of ASCII alone
    if not words:
        return 0
    size = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(size + 1) - size - 1
    k = min(shingle, len(words))
    joined, n = b" ".join(words), len(words) - k + 1
    ends = (starts + size)[k - 1:]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for at in range(0, n, _CHUNK):
        hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[at:min(n, at + _CHUNK)].tolist(), ends[at:at + _CHUNK].tolist())])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """The written documents: (row_id, doc_id, fp) and the given columns as ``doc``."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in slices(texts):
            yield pd.Series([fingerprint(t, shingle) for t in part], dtype="int64")

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return written(rows.withColumn("fp", of("doc.text")), "simhash-rows")


class Ring:
    """Segments and budgets for one bit distance, 1 to 8."""

    def __init__(self, distance: int):
        if not 1 <= distance <= 8:
            raise ValueError("distance must be 1 to 8")
        self.distance, self.m = distance, max(8, 4 * distance)
        self.edge = [64 * i // self.m for i in range(2 * self.m + 1)]

    def bits(self, start: int, first: int, last: int) -> tuple[int, int]:
        """(offset, width) of segments first..last-1 of the chain, in the word rotated to its start."""
        return self.edge[start + first] - self.edge[start], self.edge[start + last] - self.edge[start + first]

    def keys(self) -> list[str]:
        """SQL of the keys of column ``fp``: start and half above the segments' bits."""
        out = []
        for p in range(self.m):
            r = self.edge[p]
            rot = f"(shiftleft(fp, {r}) | shiftrightunsigned(fp, {64 - r}))" if r else "fp"
            cut = lambda a, b: (lambda o, w: (f"(shiftrightunsigned({rot}, {64 - o - w}) & {(1 << w) - 1})", w))(*self.bits(p, a, b))
            head, _ = cut(0, 3)
            for half, (a, b) in enumerate(((3, 5), (5, 7))):
                tail, w = cut(a, b)
                out.append(f"(shiftleft({2 * p + half}L, 56) | shiftleft({head}, {w}) | {tail})")
        return out

    def viable(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which differences ``x`` keep the chain's budgets from ``start`` on, and the whole distance."""
        ok = np.bitwise_count(x) <= self.distance
        if ok.any():
            some, p = x[ok], np.broadcast_to(start, x.shape)[ok]
            edge = np.array(self.edge, np.uint64)
            r = edge[p]
            rot = np.where(r > 0, (some << r) | (some >> ((64 - r) % 64)), some)
            good = np.ones(len(some), bool)
            for n in range(1, self.m):
                budget = n * self.distance // self.m
                if budget < (n + 1) * self.distance // self.m:  # the longest chain with this budget
                    good &= np.bitwise_count(rot >> (64 - (edge[p + n] - r))) <= budget
            ok[np.flatnonzero(ok)[~good]] = False
        return ok


def _forest(fps: np.ndarray, start: np.ndarray, ring: Ring) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest of one cell, by breadth-first search."""
    out, rest, queue = [], np.arange(len(fps)), []
    while len(rest) or queue:
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        at = queue.pop()
        if len(rest):
            near = ring.viable(fps[rest] ^ fps[at], start[rest])
            if near.any():
                found = rest[near]
                out.append((fps[found], np.full(len(found), fps[at])))
                queue.extend(found)
                rest = rest[~near]
    return out


def _cell_links(key: np.ndarray, cell: np.ndarray, fp: np.ndarray, ring: Ring) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links inside the cells of sorted rows: all of small cells, a spanning forest of others."""
    n = len(fp)
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
    size = np.diff(np.r_[first, n])
    start = (key >> 57).astype(np.int64)
    out = []
    of = np.repeat(np.arange(len(first)), size)
    few = np.repeat(size <= _SMALL, size)
    for step in range(1, _SMALL):
        a = np.flatnonzero(few[:-step] & (of[:-step] == of[step:])) if n > step else np.empty(0, int)
        if not len(a):
            break
        a = a[ring.viable(fp[a] ^ fp[a + step], start[a])]
        out.append((fp[a], fp[a + step]))
    for i in np.flatnonzero(size > _SMALL):
        s = slice(first[i], first[i] + size[i])
        out += _forest(fp[s], start[s], ring)
    return out


def _links(cells: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) inside each cell of (key, cell, fp)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring = Ring(distance)
        held = [np.empty(0, np.int64)] * 3

        def links(cols):
            found = _cell_links(cols[0], cols[1], cols[2].view(np.uint64), ring)
            a, b = (np.concatenate([f[i] for f in found]).view(np.int64) if found else np.empty(0, np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            cols = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            if not len(cols[0]):
                continue
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # the last cell may go on
            held = [c[cut:] for c in cols]
            if cut:
                yield links([c[:cut] for c in cols])
        if len(held[0]):
            yield links(held)

    rows = cells.select("key", F.col("cell").cast("long").alias("cell"), "fp").repartition("key", "cell").sortWithinPartitions("key", "cell", "fp")
    return rows.mapInArrow(search, "a long, b long")


def _block(n: str) -> str:
    return f"cast(pmod(xxhash64(fp, key), ceil({n} / {BLOCK})) as long)"


def linked(fps: DataFrame, distance: int) -> DataFrame:
    """(node, label) for every fingerprint of the written table ``fps`` (fp) that has a link."""
    keyed = fps.select("fp", F.explode(F.array(*map(F.expr, Ring(distance).keys()))).alias("key"))
    hot = written(keyed.groupBy("key").count().filter(f"count > {BLOCK}"), "simhash-hot")
    many = hot.count()
    if not many:
        return components(_links(keyed.withColumn("cell", F.lit(0)), distance))
    first = keyed.join(small_side(hot, many), "key", "left").withColumn(
        "cell", F.expr(f"if(count is null, 0, {_block('count')})"))
    links = written(_links(first, distance), "simhash-links")
    label = components(links)
    # In a hot bucket, what lies outside its largest component meets every block of the bucket.
    rows = keyed.join(small_side(hot, many), "key").join(label.withColumnRenamed("node", "fp"), "fp", "left").select(
        "key", "fp", F.coalesce("label", "fp").alias("label"))
    rows = written(rows, "simhash-hot-rows")
    most = rows.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", "count").alias("most"), F.sum("count").alias("n"), F.max("count").alias("top"))
    most = written(most.withColumn("rest", F.expr("n - top")).filter("rest > 0"), "simhash-most")
    if most.isEmpty():
        return label
    open_ = rows.join(small_side(most, most.count()), "key").withColumn("out", F.expr("label <> most"))
    blocks, outer = f"cast(ceil(n / {BLOCK}) as long)", f"cast(ceil(rest / {BLOCK}) as long)"
    own_outer = f"cast(pmod(xxhash64(fp, key, 1), {outer}) as long)"
    # Cell (u, g): outer block u with block g; every row is in its block g for all u, outer rows also in all g for their u.
    asked = open_.select("key", "fp", F.explode(F.expr(f"transform(sequence(0L, {outer} - 1), u -> u * {blocks} + {_block('n')})")).alias("cell"))
    asks = open_.filter("out").select("key", "fp", F.explode(F.expr(
        f"transform(sequence(0L, {blocks} - 1), g -> {own_outer} * {blocks} + g)")).alias("cell"))
    again = _links(asked.union(asks).distinct(), distance)
    return components(links.union(again))


def groups(rows: DataFrame, distance: int) -> DataFrame:
    """(fp, first) of every fingerprint in written ``rows``: the least (no_id, doc_id, row_id) of its component."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")).alias("first")
    fps = written(rows.groupBy("fp").agg(first), "simhash-fps")
    label = linked(fps.select("fp"), distance)
    named = written(fps.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label")), "simhash-named")
    least = written(named.groupBy("label").agg(F.min("first").alias("least")), "simhash-least")
    return written(named.select("fp", "label").join(least, "label").select("fp", F.col("least").alias("first")), "simhash-groups")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row for each given row: doc_id, fingerprint, component_id, kept (the one row of its component that stays)."""
    rows = fingerprints(docs.select("doc_id", "text"), shingle)
    return rows.select("row_id", "doc_id", "fp").join(groups(rows, distance), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"),
        (F.col("row_id") == F.col("first.row_id")).alias("kept"))


def one_of_each(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """The given rows with one document of each component, columns as given."""
    rows = fingerprints(docs, shingle)
    gone = written(rows.select("row_id", "fp").join(groups(rows, distance), "fp").filter("row_id <> first.row_id").select("row_id"), "simhash-gone")
    left = rows.join(small_side(gone, gone.count()), "row_id", "left_anti")
    return left.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
