"""Alignment of two tokenizers over a corpus, with external spill counting of the linked pairs.

Both tokenizers cut the same bytes. Offsets where tokens of both end cut a text
into groups, and each stretch between neighbouring ends of either side lies in
one token of each side: that is a link. How many documents hold an id pair linked
is counted out of memory:

1. Tasks turn blocks of documents into pair-document records, radix-partition
   them by the low bits of the first side's id, sort each part by that id, then
   the other, and keep it as a run compressed with zstd, in a table in the
   shared folder.
2. For each radix part the runs' heads are merged by a heap, k at a time, and
   equal pairs summed. As many merges share a part as its runs need, so neither
   a part nor a frequent id grows into one task.
3. The counts of a part, in the order of the first side's ids, give each id's
   highest count in one walk.
4. The runs are read once more in that same order, against the counts; what each
   record adds goes back to its document, summed by block.

Encoders of public libraries cut the texts, the first side's by the merge ranks
that its ids are, with special tokens taken as plain text; the first side gets a space in front, as the second one adds its own.
Token bytes come from the vocabulary files: byte letters on the first side; on
the second the piece in UTF-8 with U+2581 as space, and byte pieces as bytes.

Cases: null and empty texts, and texts whose tokens don't spell space+text
exactly on both sides (such as those with U+2581), have no tokens: zeros and an
empty groups digest. Each row counts as a document, repeated rows and null ids
too. Texts are taken whole; a block has at least one document, however long. An
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from lossframe.llm.bpe import _byte_letters
from lossframe.llm.common import table, written

#: Radix parts, as bits of the first side's id, and bits of either id.
PART_BITS, ID_BITS = 6, 20
#: Documents of a block and the letters after which it ends.
BLOCK_DOCS, BLOCK_CHARS = 2048, 4_000_000
#: Runs that one merge takes, on average.
MERGED_RUNS = 64
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_FIGURES = ("n_a", "n_b", "n_groups", "n_links")


class Sides:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        model = json.load(open(path_a, encoding="utf-8"))
        if model["normalizer"] or model["pre_tokenizer"] != _BYTE_LEVEL:
            raise ValueError("only byte-level files without normalisation and with the usual word pattern are covered")
        byte_of = {c: b for b, c in _byte_letters().items()}
        vocab = {bytes(byte_of[c] for c in token): i for token, i in model["model"]["vocab"].items()}
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = token
        merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["model"]["merges"]]
        made = [vocab[bytes(byte_of[c] for c in a + b)] for a, b in merges]
        if any(a >= b for a, b in zip(made, made[1:])) or len(made) + 256 != len(vocab):
            raise ValueError("only files whose ids are in the order of their merges are covered")
        # The ids are merge ranks, so the faster encoder for ranks gives the same ids.
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i)
                        else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << ID_BITS:
            raise ValueError(f"ids of at most {ID_BITS} bits are covered")
        self.size_a, self.size_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b))
        # The four ways an id is written: inside its side or as the last of it.
        n, m = len(self.bytes_a), len(self.bytes_b)
        self.written = [b"%d%b" % (i, end) for end, k in ((b",", n), (b"|", n), (b",", m), (b";", m)) for i in range(k)]

    def encoded(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of both sides; none if either side does not spell the text."""
        said = f" {text}".encode()
        a = self.a.encode_ordinary(f" {text}")
        if b"".join(map(self.bytes_a.__getitem__, a)) != said:
            return [], []
        b = self.b.encode(text, num_threads=1)
        return (a, b) if b"".join(map(self.bytes_b.__getitem__, b)) == said else ([], [])


_LOADED: dict[tuple[str, str], Sides] = {}


def _sides(path_a: str, path_b: str) -> Sides:
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Sides(path_a, path_b)
        gc.freeze()
    return _LOADED[path_a, path_b]


class Block:
    """Tokens of some documents end to end: ``a``, ``b`` ids, and what follows from their byte ends."""

    def __init__(self, sides: Sides, texts: list[str | None]):
        cut = [sides.encoded(t) if t else ([], []) for t in texts]
        self.sides = sides
        self.n_a, self.n_b = (np.array([len(x[k]) for x in cut], dtype=np.int64) for k in (0, 1))
        self.a, self.b = (np.array([i for x in cut for i in x[k]], dtype=np.int64) for k in (0, 1))
        ends_a, ends_b = np.cumsum(sides.size_a[self.a]), np.cumsum(sides.size_b[self.b])
        # Documents end in both sides, so offsets run on from one to the next.
        self.doc_a = np.repeat(np.arange(len(texts)), self.n_a)
        # Marks at all ends, 1 for the first side, 2 for the second; each stretch up to a mark is a link.
        marks = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, dtype=np.int8)
        marks[ends_a] = 1
        marks[ends_b] += 2
        of = marks[np.flatnonzero(marks)]
        for name, bit in (("link_a", 1), ("link_b", 2)):
            own = of & bit > 0
            setattr(self, name, np.cumsum(own) - own)
        self.link_doc = self.doc_a[self.link_a]
        self.last_a, self.last_b = marks[ends_a] == 3, marks[ends_b] == 3
        self.group_a, self.group_b = (np.cumsum(last) - last for last in (self.last_a, self.last_b))
        self.n_groups = np.bincount(self.doc_a[self.last_a], minlength=len(texts))
        self.n_links = np.bincount(self.link_doc, minlength=len(texts))

    def spelt_groups(self) -> Iterator[bytes]:
        """For each document ``a1,a2|b1;a3|b2,b3``: its groups' ids in order."""
        n, m = len(self.sides.bytes_a), len(self.sides.bytes_b)
        groups = int(self.n_groups.sum())
        a_of, b_of = np.bincount(self.group_a, minlength=groups), np.bincount(self.group_b, minlength=groups)
        order = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        order[np.arange(len(self.a)) + (np.cumsum(b_of) - b_of)[self.group_a]] = self.a + n * self.last_a
        order[np.arange(len(self.b)) + np.cumsum(a_of)[self.group_b]] = 2 * n + self.b + m * self.last_b
        stop = np.cumsum(self.n_a + self.n_b)
        for lo, hi in zip((stop - self.n_a - self.n_b).tolist(), stop.tolist()):
            yield b"".join([self.sides.written[k] for k in order[lo:hi].tolist()])[:-1]

    def runs(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(radix part, pairs with their documents' number, documents with their links): a sorted run for each part."""
        a, b = self.a[self.link_a], self.b[self.link_b]
        low = (1 << PART_BITS) - 1
        key = (((a & low) << (ID_BITS - PART_BITS) | a >> PART_BITS) << ID_BITS | b) << 11 | self.link_doc
        key.sort()
        record, links = _counted(key)
        pair, docs = _counted(record >> 11)
        part = pair >> (2 * ID_BITS - PART_BITS)
        at = np.searchsorted(part, np.arange((1 << PART_BITS) + 1))
        rows = np.append(0, np.cumsum(docs))
        press = zstandard.ZstdCompressor(level=1).compress
        for k in range(1 << PART_BITS):
            lo, hi = at[k], at[k + 1]
            if lo < hi:
                own = slice(rows[lo], rows[hi])
                yield (k, press(np.column_stack([pair[lo:hi], docs[lo:hi]]).tobytes()),
                       press((record[own] & 2047).astype(np.uint16).tobytes() + links[own].astype(np.uint32).tobytes()))


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of a sorted array, and how often each stands."""
    first = np.flatnonzero(np.append(x[:1] == x[:1], x[1:] != x[:-1]))
    return x[first], np.diff(np.append(first, len(x)))


def _blocks(texts: list[str | None]) -> Iterator[slice]:
    start = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= BLOCK_CHARS or i + 1 - start == BLOCK_DOCS:
            yield slice(start, i + 1)
            start, chars = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def spilled(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The written runs: (block, part, keys, records), and for each block a row of part -1 with its documents' figures in ``docs``."""
    doc = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), *(StructField(c, LongType()) for c in _FIGURES), StructField("groups_sha256", StringType())])
    schema = StructType([StructField("block", LongType()), StructField("part", IntegerType()), StructField("keys", BinaryType()),
                         StructField("records", BinaryType()), StructField("docs", ArrayType(doc))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides, number = _sides(path_a, path_b), TaskContext.get().partitionId() << 32
        for batch in batches:
            for own in _blocks(batch.column("text").to_pylist()):
                size = own.stop - own.start
                block = Block(sides, batch.column("text").slice(own.start, size).to_pylist())
                runs = list(block.runs())
                sha = [hashlib.sha256(g).hexdigest() if g else "" for g in block.spelt_groups()]
                ids = batch.column("doc_id").slice(own.start, size)
                figures = [pa.array(getattr(block, c), pa.int64()) for c in _FIGURES]
                rows = pa.StructArray.from_arrays([ids, *figures, pa.array(sha, pa.string())], names=doc.names)
                offsets = pa.array([0, size] + [size] * len(runs), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array([number] * (len(runs) + 1), pa.int64()), pa.array([-1, *(r[0] for r in runs)], pa.int32()),
                    pa.array([None, *(r[1] for r in runs)], pa.binary()), pa.array([None, *(r[2] for r in runs)], pa.binary()),
                    pa.ListArray.from_arrays(offsets, rows)], names=schema.names)
                number += 1

    return written(docs.select("doc_id", "text").mapInArrow(cut, schema), "alignment-runs")


def _heads(run: bytes) -> Iterator[tuple[int, int]]:
    """(pair, documents) of a run, decompressed bit by bit."""
    reader = zstandard.ZstdDecompressor().stream_reader(run)
    while some := reader.read(1 << 15):
        yield from np.frombuffer(some, np.int64).reshape(-1, 2).tolist()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i] for c in batch.schema.names}


def merged(runs: DataFrame, merges: int) -> DataFrame:
    """(part, pair, n): documents of each pair, from a heap merge of the runs' heads; ``merges`` for each part."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in groupby(_rows(batches), key=lambda r: (r["part"].as_py(), r["share"].as_py())):
            heap = heapq.merge(*[_heads(r["keys"].as_py()) for r in own], key=lambda head: head[0])
            pairs, counts = [], []
            for pair, same in groupby(heap, key=lambda head: head[0]):
                pairs.append(pair)
                counts.append(sum(n for _, n in same))
                if len(pairs) == 1 << 16:
                    yield _counts(part[0], pairs, counts)
                    pairs, counts = [], []
            if pairs:
                yield _counts(part[0], pairs, counts)

    shared = runs.filter("part >= 0").select("part", _share("block", merges).alias("share"), "keys")
    partial = shared.repartition("part", "share").sortWithinPartitions("part", "share").mapInArrow(merge, "part int, pair long, n long")
    return partial.groupBy("part", "pair").agg(F.sum("n").alias("n"))


def _counts(part: int, pairs: list[int], counts: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part] * len(pairs), pa.int32()), pa.array(pairs, pa.int64()), pa.array(counts, pa.int64())], names=["part", "pair", "n"])


def _share(block: str, merges: int):
    return F.pmod(F.xxhash64(block), F.lit(merges)).cast("int")


def ranked(counts: DataFrame) -> DataFrame:
    """(part, keys): the counts of each part as one compressed table of (pair, n, best), in the order of the pairs.

    Its rows are bounded by the vocabularies: ids of the part times ids of the other side.
    """

    def pack(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("pair")
        pair, n = own["pair"].to_numpy(), own["n"].to_numpy()
        side = pair >> ID_BITS
        first = np.flatnonzero(np.append(True, side[1:] != side[:-1]))
        best = n == np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(n))))
        return pd.DataFrame({"part": [own["part"].iat[0]], "keys": [zstandard.compress(np.stack([pair, n, best.astype(np.int64)]).tobytes(), 1)]})

    return counts.groupBy("part").applyInPandas(pack, "part int, keys binary")


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(a, b, n, best): in how many documents each pair of ids is linked, and whether no partner of ``a`` has more."""
    from pyspark.sql import Window

    runs = spilled(docs, path_a, path_b)
    counts = merged(runs, _merges(runs))
    low, rest = ID_BITS - PART_BITS, F.shiftright("pair", ID_BITS)
    a = F.shiftleft(rest.bitwiseAND((1 << low) - 1), PART_BITS).bitwiseOR(F.shiftright(rest, low))
    # partners of an id are bounded by the other vocabulary
    return counts.select(a.cast("int").alias("a"), F.col("pair").bitwiseAND((1 << ID_BITS) - 1).cast("int").alias("b"), "n").withColumn(
        "best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


def _merges(runs: DataFrame) -> int:
    return max(1, -(-runs.filter("part = -1").count() // MERGED_RUNS))


def contributions(runs: DataFrame, tables: DataFrame, merges: int) -> DataFrame:
    """(block, part, keys): for each run, what its records add to each document of the block: best links, counts."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None
        for r in _rows(batches):
            if r["block"].as_py() is None:  # the counts come before the runs of their part
                known = np.frombuffer(zstandard.decompress(r["keys"].as_py()), np.int64).reshape(3, -1)
                continue
            pair, docs = np.frombuffer(zstandard.decompress(r["keys"].as_py()), np.int64).reshape(-1, 2).T
            raw = zstandard.decompress(r["records"].as_py())
            size = len(raw) // 6
            doc, links = np.frombuffer(raw, np.uint16, size), np.frombuffer(raw, np.uint32, size, 2 * size)
            at = np.searchsorted(known[0], pair)
            n, best = np.repeat(known[1][at], docs), np.repeat(known[2][at], docs)
            # sums in doubles stay exact when counts are taken in halves
            add = lambda what: np.bincount(doc, what * links.astype(np.float64)).astype(np.int64)
            sums = np.stack([add(best), add(n & 0xFFFFFF) + (add(n >> 24) << 24)])
            yield pa.RecordBatch.from_arrays([pa.array([r["block"].as_py()], pa.int64()), pa.array([r["part"].as_py()], pa.int32()),
                                              pa.array([zstandard.compress(sums.tobytes(), 1)], pa.binary())], names=["block", "part", "keys"])

    shared = runs.filter("part >= 0").select("part", _share("block", merges).alias("share"), "block", "keys", "records")
    each = tables.select("part", F.explode(F.sequence(F.lit(0), F.lit(merges - 1))).alias("share"), F.lit(None).cast("long").alias("block"), "keys", F.lit(None).cast("binary").alias("records"))
    both = shared.unionByName(each).repartition("part", "share").sortWithinPartitions("part", "share", F.col("block").asc_nulls_first())
    return both.mapInArrow(back, "block long, part int, keys binary")


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    runs = spilled(docs, path_a, path_b)
    merges = _merges(runs)
    tables = written(ranked(merged(runs, merges)), "alignment-counts")
    added = contributions(runs, tables, merges)
    doc = runs.schema["docs"].dataType.elementType
    schema = StructType([*doc.fields[:-1], StructField("n_best", LongType()), StructField("count_sum", LongType()), doc.fields[-1]])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in groupby(_rows(batches), key=lambda r: r["block"].as_py()):
            rows = next(own)["docs"].values  # the documents come before what is added to them
            sums = np.zeros((2, len(rows)), dtype=np.int64)
            for r in own:
                more = np.frombuffer(zstandard.decompress(r["keys"].as_py()), np.int64).reshape(2, -1)
                sums[:, :more.shape[1]] += more
            columns = dict(zip(doc.names, rows.flatten())) | {"n_best": pa.array(sums[0]), "count_sum": pa.array(sums[1])}
            yield pa.RecordBatch.from_arrays([columns[c] for c in schema.names], names=schema.names)

    heads = runs.filter("part = -1").select("block", "part", "keys", "docs")
    both = heads.unionByName(added, allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", "part").mapInArrow(summed, schema)


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each document: doc_id, groups, an array of (a, b) id arrays in order."""
    doc = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("spelt", StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = _sides(path_a, path_b)
        for batch in batches:
            for own in _blocks(texts := batch.column("text").to_pylist()):
                spelt = [g.decode() for g in Block(sides, texts[own]).spelt_groups()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(own.start, own.stop - own.start), pa.array(spelt, pa.string())], names=doc.names)

    ids = lambda side: F.split(side, ",").cast("array<int>")
    each = lambda g: F.struct(ids(F.split_part(g, F.lit("|"), F.lit(1))).alias("a"), ids(F.split_part(g, F.lit("|"), F.lit(2))).alias("b"))
    said = docs.select("doc_id", "text").mapInArrow(cut, doc)
    return said.select("doc_id", F.transform(F.filter(F.split("spelt", ";"), lambda g: g != ""), each).alias("groups"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
