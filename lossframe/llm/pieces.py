"""SentencePiece encoding and decoding of merge-type models, exactly, by backtracking.

A merge-type model joins, again and again, the neighbours whose joined text is
the best-scored piece. Its result is the only way to cut a text into pieces of
which any two neighbours, merged again on their own, stay as they are. So no
text is merged as a whole: an Aho-Corasick automaton over the reversed pieces
lists, in one pass from the end, the pieces that start at each place, longest
first; from the left the longest piece compatible with the one before it is
taken; where none is, the place is marked in a bitfield of failed positions, no
piece may end there any more, and the last piece taken gives way to the next
shorter one. Compatibility is found by re-merging the text of both pieces, and
remembered by pair.

A text gets a space in front, spaces become U+2581, and letters outside the
vocabulary become byte pieces, as the model file says; files with other
normalisation, user-defined or unused pieces raise an error. Texts are cut into
stretches that no piece crosses; stretches met before are looked up.

Cases: a null text counts as empty; an empty text has the end id alone and
decodes to the empty text; texts are taken whole, and a stretch may be a whole
text; control pieces written out in a text are ordinary letters; repeated rows
each get a row; an empty table gives no rows; other columns are not read. In
decoding, null ids count as none, and ids outside the vocabulary raise an error.
"""

from __future__ import annotations

import gc
import hashlib
import re
from array import array
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from lossframe.llm.bpe import CACHE, Automaton, Words
from lossframe.llm.common import slices, table

SPACE = "▁"
#: Stretches in each of the two generations that a worker remembers; about 350 bytes each.
KNOWN = 400_000
#: What the unknown id decodes to.
_UNKNOWN = " ⁇ "


class Pieces:
    """Encoder and decoder for a model file of type BPE with byte fallback."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        if model.Normalize("ﬁ  x ") != f"{SPACE}ﬁ{SPACE}{SPACE}x{SPACE}":
            raise ValueError("only files without normalisation and with a space put in front are covered")
        ids = range(model.get_piece_size())
        self.piece = [model.id_to_piece(i) for i in ids]
        self.byte = {i: int(self.piece[i][3:-1], 16) for i in ids if model.is_byte(i)}
        if len(self.byte) != 256 or any(model.is_unused(i) for i in ids):
            raise ValueError("only files with byte pieces and without unused pieces are covered")
        self.byte_id = {b: i for i, b in self.byte.items()}
        self.control, self.unknown, self.end = {i for i in ids if model.is_control(i)}, model.unk_id(), model.eos_id()
        own = [i for i in ids if i not in self.byte and i not in self.control and i != self.unknown]
        self.id = {self.piece[i]: i for i in own}
        self.score = {self.piece[i]: model.get_score(i) for i in own}
        self.starts = Automaton((p[::-1], (len(p), i)) for p, i in self.id.items())
        self.said = [_UNKNOWN if i == self.unknown else "" if i in self.control else self.piece[i].replace(SPACE, " ") for i in ids]
        self.number = [str(i) for i in ids]
        self.fits: dict[int, bool] = {}
        # Letters that stand side by side in a piece are of one class; no piece crosses from one class to another, nor to a space mark.
        kind: dict[str, str] = {}

        def root(c: str) -> str:
            while kind.setdefault(c, c) != c:
                c = kind[c]
            return c

        long = [p for p in self.id if len(p) > 1]
        inner = any(SPACE in p.lstrip(SPACE) for p in long)
        for p in long:
            for a, b in zip(p, p[1:]):
                if inner or SPACE not in (a, b):
                    kind[root(a)] = root(b)
        classes: dict[str, list[str]] = {}
        for c in sorted({c for p in long for c in p if inner or c != SPACE}):
            classes.setdefault(root(c), []).append(c)
        runs = "|".join(f"[{re.escape(''.join(own))}]+" for own in sorted(classes.values(), key=len, reverse=True)) or "(?!)"
        self.stretch = re.compile(f"{runs}|." if inner else f"{SPACE}*(?:{runs})|{SPACE}+|.", re.S)
        self.known = Words(self._both, KNOWN)

    def merged(self, text: str) -> list[str]:
        """Merging by score, of equal ones the leftmost first: for the short texts of two pieces."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the texts of two pieces, merged again, are those two pieces."""
        a, b = self.text(left), self.text(right)
        return self.merged(a + b) == [a, b]

    def text(self, i: int) -> str:
        """Text of a piece, or of a letter outside the vocabulary, whose number lies beyond it."""
        return self.piece[i] if i < len(self.piece) else chr(i - len(self.piece))

    def cut(self, text: str) -> list[int]:
        """Pieces of a normalised stretch, by backtracking."""
        n, after, step, ends, fits = len(text), self.starts.next, self.starts.step, self.starts.ends, self.fits
        short = n <= 64  # a longer one may be a whole text and is held compactly
        states = [0] * n if short else array("i", [0]) * n
        s, i = 0, n
        for c in reversed(text):
            t = after[s].get(c)
            s = t if t is not None else step(s, c)
            i -= 1
            states[i] = s
        failed = bytearray((n >> 3) + 1)
        taken, choices = ([], []) if short else (array("i"), array("i"))
        at = choice = 0
        last = -1
        while at < n:
            here = ends[states[at]]
            if not here or here[-1][0] > 1:  # a letter that is no piece of its own stands alone
                here = (*here, (1, len(self.piece) + ord(text[at])))
            options = len(here)
            while choice < options:
                size, i = here[choice]
                stop = at + size
                if not failed[stop >> 3] >> (stop & 7) & 1:
                    if last < 0:
                        break
                    pair = last << 32 | i
                    fit = fits.get(pair)
                    if fit is None:
                        if len(fits) >= 4 * CACHE:
                            fits.clear()
                        fit = fits[pair] = self.compatible(last, i)
                    if fit:
                        break
                choice += 1
            if choice < options:
                taken.append(i)
                choices.append(choice)
                last, at, choice = i, stop, 0
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(self.text(taken.pop()))
                choice = choices.pop() + 1
                last = taken[-1] if taken else -1
        return taken

    def ids(self, text: str) -> list[int]:
        """Ids of a normalised stretch; letters outside the vocabulary as bytes."""
        top = len(self.piece)
        got = self.cut(text)
        return got if max(got) < top else [j for i in got for j in ([i] if i < top else [self.byte_id[b] for b in chr(i - top).encode()])]

    def _both(self, stretch: str) -> tuple[str, str]:
        ids = self.ids(stretch)
        return " ".join([self.number[i] for i in ids]), self._joined(ids)

    def encoded(self, text: str | None) -> tuple[str, int, str]:
        """(ids joined by spaces with the end id last, their number, decoded text)."""
        if not text:
            return self.number[self.end], 1, ""
        ids, parts = zip(*map(self.known.__getitem__, self.stretch.findall(SPACE + text.replace(" ", SPACE))))
        joined, said = f"{' '.join(ids)} {self.end}", "".join(parts)
        return joined, joined.count(" ") + 1, said[1:] if said[:1] == " " else said

    def _joined(self, ids: list[int]) -> str:
        """Text of the ids, its first space included; each byte that is not part of a letter as U+FFFD."""
        if self.byte.keys().isdisjoint(ids) and ids and 0 <= min(ids) and max(ids) < len(self.piece):
            return "".join([self.said[i] for i in ids])
        out, raw = [], bytearray()

        def letters() -> None:
            while raw:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(raw[:size].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    size = 1
                    out.append("\ufffd")
                del raw[:size]

        for i in ids:
            if i < 0 or i >= len(self.piece):
                raise ValueError(f"{i} is no id of the vocabulary")
            if i in self.byte:
                raw.append(self.byte[i])
                continue
            if raw:
                letters()
            out.append(self.said[i])
        letters()
        return "".join(out)

    def decoded(self, ids: list[int]) -> str:
        """The text of any ids; one space in front goes if a piece of the vocabulary brings it."""
        said = self._joined(ids)
        first = next((i for i in ids if i not in self.control), self.unknown)
        return said[1:] if first not in self.byte and first != self.unknown and said[:1] == " " else said


_LOADED: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
        gc.freeze()  # the automaton stays
    return _LOADED[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """One row for each document: doc_id, ids (array, the end id last)."""

    @F.pandas_udf("array<int>")
    def ids(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _pieces(path)
        for part in slices(texts):
            yield pd.Series([[int(i) for i in model.encoded(t)[0].split()] for t in part], dtype=object)

    return docs.select("doc_id", ids("text").alias("ids"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """One row for each row of (doc_id, ids): doc_id, text."""

    @F.pandas_udf("string")
    def said(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _pieces(path)
        for part in rows:
            yield pd.Series([model.decoded(i if i is not None else []) for i in part], dtype=object)

    return encoded.select("doc_id", said("ids").alias("text"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, sha = _pieces(path), lambda s: hashlib.sha256(s.encode()).hexdigest()
        for part in slices(texts):
            rows = [(n, sha(ids), sha(said)) for ids, n, said in map(model.encoded, part)]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", of("text").alias("t")).select("doc_id", "t.*")


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
