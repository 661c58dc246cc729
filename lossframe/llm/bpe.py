"""BPE encoding and decoding by dynamic programming over prefixes.

For each prefix of a word there is one last token of its BPE encoding. It is
found among the vocabulary entries that end the prefix: the automaton of all
entries, whose suffix links lead from the longest match to the shorter ones,
lists them, longest first, and the one whose pair with the last token of the
prefix before it stays unmerged is stored with its length, the back-pointer.
Following the pointers back from the whole word gives exactly the ids that
merging by rank would.

Text goes through the file's own steps first: special tokens, NFC, white
space to one space, lower case, the word pattern, bytes as letters. Decoding
joins the tokens of the ids, by one space as the file names no decoder. The
file is read by every worker from ``path``, which is a parameter.

Cases: a null or blank text has no ids and decodes to the empty text; texts
are taken whole, in words; repeated rows each get a row; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from lossframe.llm.common import slices, table

#: Words in each of the two generations of encodings that a worker remembers, and a quarter of the pairs.
CACHE = 150_000
#: Texts of these letters alone, Latin and general punctuation, are cut here; for all others the library's own Unicode tables count.
_PLAIN_LETTERS = [*map(chr, range(0x180)), *map(chr, range(0x2010, 0x2028))]
_PLAIN = re.compile(r"[\x00-\u017f\u2010-\u2027]*+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Automaton:
    """Letters lead from state to state; ``ends`` of a state lists the entries that end there, longest first."""

    def __init__(self, entries: Iterable[tuple[str, tuple[int, int]]]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple] = [()]
        for body, value in entries:
            s = 0
            for c in body:
                t = self.next[s].get(c)
                if t is None:
                    t = self.next[s][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(())
                s = t
            self.ends[s] = (value,)
        self.suffix = [0] * len(self.next)
        queue = list(self.next[0].values())
        for s in queue:  # grows while it is read: breadth first
            for c, t in self.next[s].items():
                queue.append(t)
                self.suffix[t] = self.step(self.suffix[s], c)
                self.ends[t] += self.ends[self.suffix[t]]

    def step(self, s: int, c: str) -> int:
        while s and c not in self.next[s]:
            s = self.suffix[s]
        return self.next[s].get(c, 0)


class Words(dict):
    """What ``make`` gives for a word; two generations, so that frequent words stay known."""

    def __init__(self, make, most: int = CACHE):
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word: str) -> str:
        got = self.old.get(word)
        if got is None:
            got = self.make(word)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = got
        return got


class Bpe:
    """Encoder and decoder for a tokenizers file with a BPE model and word ends."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special tokens with options are not covered")
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.split: dict[str, tuple[str, str]] = {}
        self.rank: dict[tuple[str, str], int] = {}
        for i, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault((a, b), i)
            self.split.setdefault(a + b, (a, b))
        # An entry ends a prefix inside the word, or the word as a whole, whose end is one letter more.
        self.mark = "\n"  # no byte letter
        whole = lambda entry: bool(self.end) and entry.endswith(self.end)
        self.automaton = Automaton((entry[: -len(self.end)] + self.mark, (len(entry) - len(self.end), i)) if whole(entry) else (entry, (len(entry), i))
                                   for entry, i in self.vocab.items())
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.cut_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        # The word pattern for plain texts, its classes spelt out.
        word = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        for kind in (r"\p{L}", r"\p{N}", r"\s"):
            word = word.replace(kind, "".join(re.escape(c) for c in _PLAIN_LETTERS if regex.fullmatch(kind, c)))
        self.word = re.compile(word)
        self.pairs: dict[int, bool] = {}
        self.ids_of = Words(lambda w: " ".join(map(str, self.ids(self.byte_letters(w)))))
        self.said_of = Words(lambda w: " ".join([self.token[int(i)] for i in self.ids_of[w].split()]))
        self.path, self.library = path, None

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves the tokens ``left`` and ``right`` side by side.

        A merge across the border joins a right edge of ``left`` with a left
        edge of ``right``. It happens if, at that time, its rank is below
        those of the merges that would have swallowed either edge.
        """
        a, b, top = self.token[left], self.token[right], len(self.rank)
        while True:
            if self.rank.get((a, b), top) < top:
                return False
            up_a, up_b = self.split.get(a), self.split.get(b)
            ra = self.rank[up_a] if up_a else -1
            rb = self.rank[up_b] if up_b else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # the later merge is undone first
                a, top = up_a[1], ra
            else:
                b, top = up_b[0], rb + 1

    def byte_letters(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)

    def ids(self, letters: str) -> list[int]:
        """Ids of one word given in byte letters."""
        n, pairs, step, ends, after = len(letters), self.pairs, self.automaton.step, self.automaton.ends, self.automaton.next
        if n > 64:  # compact, as a word may be a whole text
            size_at, id_at = array("i", [0]) * (n + 1), array("i", [0]) * (n + 1)
        else:
            size_at, id_at = [0] * (n + 1), [0] * (n + 1)
        state = stop = 0
        last = n if self.end else n + 1
        for c in letters:
            state = after[state].get(c) or step(state, c)
            stop += 1
            if stop == last:
                state = step(state, self.mark)
            for size, i in ends[state]:
                if size == stop:
                    size_at[stop], id_at[stop] = size, i
                    break
                before = stop - size
                if size_at[before]:
                    pair = id_at[before] << 32 | i
                    fits = pairs.get(pair)
                    if fits is None:
                        if len(pairs) >= 4 * CACHE:
                            pairs.clear()
                        fits = pairs[pair] = self.compatible(id_at[before], i)
                    if fits:
                        size_at[stop], id_at[stop] = size, i
                        break
        out = []
        while n:
            if not size_at[n]:
                raise ValueError("a letter is missing in the vocabulary")
            out.append(id_at[n])
            n -= size_at[n]
        return out[::-1]

    def words(self, text: str) -> list[str]:
        """The words of a piece of text without special tokens."""
        if text.isascii():
            return self.word.findall(text.lower())
        if _PLAIN.fullmatch(text):
            return self.word.findall(unicodedata.normalize("NFC", text).lower())
        if self.library is None:
            from tokenizers import Tokenizer

            steps = Tokenizer.from_file(self.path)
            self.library = steps.normalizer, steps.pre_tokenizer[0]
        normal, cut = self.library
        return [w for w, _ in cut.pre_tokenize_str(normal.normalize_str(text))]

    def encoded(self, text: str | None) -> tuple[str, int, str]:
        """(ids joined by spaces, their number, decoded text)."""
        ids, said = [], []
        for i, piece in self._pieces(text or ""):
            if i is not None:
                ids.append(str(i))
                said.append(piece)
            elif words := self.words(piece):
                ids.append(" ".join(map(self.ids_of.__getitem__, words)))
                said.append(" ".join(map(self.said_of.__getitem__, words)))
        joined = " ".join(ids)
        return joined, joined.count(" ") + 1 if joined else 0, " ".join(said)

    def _pieces(self, text: str) -> Iterator[tuple[int | None, str]]:
        at = 0
        for m in self.cut_special.finditer(text) if self.cut_special and "<|" in text else ():
            if m.start() > at:
                yield None, text[at:m.start()]
            yield self.special[m[0]], m[0]
            at = m.end()
        if at < len(text):
            yield None, text[at:]

    def decoded(self, ids: list[int]) -> str:
        return " ".join(self.token[i] for i in ids if i in self.token)


_LOADED: dict[str, Bpe] = {}


def _bpe(path: str) -> Bpe:
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
        gc.freeze()  # the automaton stays; no need to look through it again
    return _LOADED[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """One row for each document: doc_id, ids (array)."""

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _bpe(path)
        for part in slices(texts):
            yield pd.Series([[int(i) for i in bpe.encoded(t)[0].split()] for t in part], dtype=object)

    return docs.select("doc_id", ids("text").alias("ids"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """One row for each row of (doc_id, ids): doc_id, text."""

    @F.pandas_udf("string")
    def said(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _bpe(path)
        for part in rows:
            yield pd.Series([bpe.decoded(i if i is not None else []) for i in part], dtype=object)

    return encoded.select("doc_id", said("ids").alias("text"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe, sha = _bpe(path), lambda s: hashlib.sha256(s.encode()).hexdigest()
        for part in slices(texts):
            rows = [(n, sha(ids), sha(said)) for ids, n, said in map(bpe.encoded, part)]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", of("text").alias("t")).select("doc_id", "t.*")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
