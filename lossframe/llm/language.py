"""Language ID by prediction by partial matching.

Each language has a variable-order context tree over bytes: ASCII letters in
lower case, bytes above 127 as they are, every run of other bytes as one
space. Under frozen counts a symbol's probability in a context of three
symbols is count / (n + d) if it was seen there, else the escape probability
d / (n + d) times its probability in the next shorter context (n symbols seen
there, d of them distinct), down to an even share of 256 bytes; a context that
the language never saw hands on at no cost. The text's code length is the
exact sum over all its symbols, and the language with the least one wins.

The frozen trees are sparse: the escape's code length for each context and
language that saw it, the symbol's for each context, symbol and language. So
all contexts of the sample stay, for any number of languages. Scoring looks up
the distinct four-symbol strings of a slab of texts, then adds up by text.

The trees learn from a sample of labelled documents: about ``docs_per_lang``
whole texts of each language, chosen by a hash, all if there are fewer. The
counts are summed by Spark and all are kept, for every language, so the sample
alone bounds the driver's and the broadcast trees' size.

Cases: a null text, or one without a letter, is ``und`` with score 0, and so
is every text if nothing can be learned; ties go to the language that sorts
first; repeated rows each get a row; an empty table gives no rows; long texts
are scored whole, in slabs; given columns pass through ``identified``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from lossframe.llm.common import crc_mod, slices, table

DOCS_PER_LANG = 1000
#: Symbols scored at once, which bounds the arrays that a worker holds.
_SLAB = 1 << 18
_SYMBOLS = 27 + 128

_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a"):ord("z") + 1] = _CLASS[ord("A"):ord("Z") + 1] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, _SYMBOLS)


def symbols(text: str) -> np.ndarray:
    """Symbols of the text after three spaces, each run of spaces as one."""
    s = _CLASS[np.frombuffer(text.encode(), np.uint8)]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    return np.concatenate([np.zeros(3, np.uint8), s[keep]])


def _grams(s: np.ndarray, size: int) -> np.ndarray:
    """Code of the four symbols that end at each place from the fourth on."""
    s = s.astype(np.int64)
    return ((s[:-3] * size + s[1:-2]) * size + s[2:-1]) * size + s[3:]


class Entries:
    """Keys with, for each, the languages that have it and a value in each of them."""

    def __init__(self, key: np.ndarray, lang: np.ndarray, value: np.ndarray):
        """The arrays are sorted by key, each pair of key and language once."""
        self.keys, starts = np.unique(key, return_index=True)
        self.starts = np.append(starts, len(key))
        self.lang, self.value = lang.astype(np.int32), value.astype(np.float32)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``keys``, language, value) of all entries of the asked keys."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        rows = np.flatnonzero(self.keys[at] == keys)
        at = at[rows]
        n = self.starts[at + 1] - self.starts[at]
        entry = np.arange(n.sum()) + np.repeat(self.starts[at] - (np.cumsum(n) - n), n)
        return np.repeat(rows, n), self.lang[entry], self.value[entry]


class Ppm:
    """Frozen trees: ``grams`` are the four symbols, with the language's number and the count."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray):
        self.langs = langs
        n = len(langs)
        #: For contexts of 0 to 3 symbols: code lengths of escapes by context, and of seen symbols by context and symbol.
        self.orders: list[tuple[Entries, Entries]] = []
        for k in range(4 if len(gram) else 0):
            pair, of = np.unique(gram % _SYMBOLS**(k + 1) * n + lang, return_inverse=True)
            seen = np.bincount(of, count)
            key, own = pair // n, pair % n
            context, of = np.unique(key // _SYMBOLS * n + own, return_inverse=True)
            total, distinct = np.bincount(of, seen), np.bincount(of)
            self.orders.append((Entries(context // n, context % n, np.log2((total + distinct) / distinct)),
                                Entries(key, own, np.log2((total + distinct)[of] / seen))))

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Code length of the last symbol of each gram in each language."""
        out = np.full((len(grams), len(self.langs)), 8.0)
        for k, (escapes, symbols_) in enumerate(self.orders):
            row, lang, bits = escapes.of(grams % _SYMBOLS**(k + 1) // _SYMBOLS)
            out[row, lang] += bits
            row, lang, bits = symbols_.of(grams % _SYMBOLS**(k + 1))
            out[row, lang] = bits
        return out

    def bits(self, texts: list[str]) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(texts), len(self.langs)))
        slab = max(1, min(_SLAB, 8 * _SLAB // len(self.langs)))  # bounds the costs held
        held, rows, total = [], [], 0
        for i, text in enumerate(texts):
            s = symbols(text)
            for at in range(0, max(1, len(s) - 3), slab):  # each slab starts with the three symbols before it
                part = s[at:at + slab + 3]
                held.append(_grams(part, _SYMBOLS))
                rows.append(i)
                total += len(held[-1])
                if total >= slab:
                    self._add(out, held, rows)
                    held, rows, total = [], [], 0
        self._add(out, held, rows)
        return out

    def _add(self, out: np.ndarray, held: list[np.ndarray], rows: list[int]) -> None:
        if not sum(map(len, held)):
            return
        grams, at = np.unique(np.concatenate(held), return_inverse=True)
        first = rows[0]  # rows rise
        row = np.repeat(np.array(rows) - first, [len(h) for h in held])
        cost = self.costs(grams)
        for i in range(len(self.langs)):
            sums = np.bincount(row, cost[at, i])
            out[first:first + len(sums), i] += sums


def trained(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, held_out: int = 1) -> Ppm | None:
    """Trees of the documents with a language whose crc32(doc_id) mod 3 is not ``held_out``."""
    known = docs.filter(F.col("lang").isNotNull() & (crc_mod(F.col("doc_id"), 3) != held_out))
    sizes = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(docs_per_lang) / F.count("*")).alias("rate"))
    langs = sorted(r["lang"] for r in sizes.select("lang").collect())
    if not langs:
        return None
    chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < F.col("rate") * (1 << 20)
    sample = known.filter(F.col("text").isNotNull()).join(F.broadcast(sizes), "lang").filter(chosen).select("lang", "text")

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in slices(parts):
            for lang, texts in part.groupby("lang")["text"]:
                found = [_grams(symbols(t), _SYMBOLS) for t in texts]
                gram, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": gram, "n": n})

    counts = sample.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = counts.toArrow()
    lang = rows["lang"].combine_chunks().dictionary_encode()
    place = {x: i for i, x in enumerate(langs)}
    number = np.array([place[x] for x in lang.dictionary.to_pylist()], np.int64)
    return Ppm(langs, number[lang.indices.to_numpy()], rows["gram"].to_numpy(), rows["n"].to_numpy().astype(np.float64))


def identified(docs: DataFrame, model: Ppm | None) -> DataFrame:
    """The given columns as ``doc``, with lang_pred and score."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    und = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if model is None:
        return rows.select("doc", und.alias("p")).select("doc", "p.*")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ppm = shared.value
        for part in slices(parts):
            known = part.notna().to_numpy()
            bits = ppm.bits(part[known].tolist())
            best = bits.argmin(axis=1)
            odds = np.exp2(bits.min(axis=1, keepdims=True) - bits)
            out = pd.DataFrame({"lang_pred": ["und"] * len(part), "score": 0.0})
            out.loc[known, "lang_pred"] = np.array(ppm.langs, object)[best]
            out.loc[known, "score"] = 1 / odds.sum(axis=1)
            yield out

    predict = predict.asNondeterministic()  # else a filter on its result would run it twice
    lettered = F.when(F.col("doc.text").rlike(r"\p{L}"), F.col("doc.text"))
    return rows.select("doc", predict(lettered).alias("p")).select("doc", "p.*")


def known_language(docs: DataFrame) -> DataFrame:
    """The given rows whose language could be told, columns as given."""
    rows = identified(docs, trained(docs)).filter("lang_pred <> 'und'")
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = identified(docs.select("doc_id", "text"), trained(docs))
    return rows.select("doc.doc_id", (crc_mod(F.col("doc.doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
