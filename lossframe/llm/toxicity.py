"""Toxicity: a bidirectional GRU with attention pooling over characters and words, in numpy.

A word's input is a learned vector of the word (hashed) beside the mean of
learned vectors of its character trigrams (hashed, with the word's borders).
A window is ``WINDOW`` words; windows start every ``STRIDE`` words, so they
overlap, and the last one ends with the text. The GRU reads each window in
both directions, attention pools its states, and a logistic unit scores the
pool. A document's score is that of its highest window, calibrated.

Labels are of documents, so training alternates: it fits the windows, then
keeps of each toxic document the windows that score highest. It learns from at most ``MAX_TOXIC`` toxic and ``MAX_CLEAN``
other labelled documents, chosen by a hash of their id.

Cases: a null, empty or wordless text has no window and scores like the
median clean document learned from; null labels are not learned from; without both classes
in the sample every score is the share of toxic labels, 0 without labels;
repeated rows each get a row; long texts are scored whole, window after
window; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from lossframe.llm.common import crc_mod, slices, table
from lossframe.llm.quality import sample

WINDOW, STRIDE = 32, 16
MAX_TOXIC, MAX_CLEAN = 1500, 3000
WORDS, TRIGRAMS = 8192, 4096
DIM, HIDDEN = 8, 8
#: Words whose input projections a worker remembers, and windows scored at a time.
CACHE, BATCH = 200_000, 1024

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """ASCII letters in lower case, digits and bytes above 127; all else parts words."""
    return (text or "").encode().translate(_TABLE).split()


def windows(n: int) -> list[int]:
    """Starts of the windows of a text of ``n`` words."""
    if n <= WINDOW:
        return [0]
    starts = list(range(0, n - WINDOW + 1, STRIDE))
    return starts if starts[-1] == n - WINDOW else [*starts, n - WINDOW]


def _features(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed word ids, and the trigram ids of all words with the end of each word's."""
    ids = np.fromiter((xxhash.xxh32_intdigest(w) % WORDS for w in vocabulary), np.int64, len(vocabulary))
    size = np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))
    a = np.frombuffer(b"<" + b"><".join(vocabulary) + b">", np.uint8).astype(np.uint32)
    code = (a[:-2] << 16 | a[1:-1] << 8 | a[2:]) * np.uint32(2654435761) >> np.uint32(16)
    ends = np.cumsum(size)
    inside = np.ones(len(code), bool)  # a word of n letters has n trigrams, then two places cross its border
    border = (ends + 2 * np.arange(len(size)))[:-1]
    inside[border] = inside[border + 1] = False
    return ids, (code[inside] % TRIGRAMS).astype(np.int64), ends


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class BiGru:
    """Parameters, scoring and gradients. Directions are stacked in the first axis of GRU parameters."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        normal = lambda *shape: (rng.standard_normal(shape) * (1 / shape[-2]) ** 0.5).astype(np.float32)
        self.p = {
            "word": normal(WORDS, DIM) * 3, "tri": normal(TRIGRAMS, DIM) * 30,
            "w": normal(2, 2 * DIM, 3 * HIDDEN), "b": np.zeros((2, 3 * HIDDEN), np.float32),
            "u": normal(2, HIDDEN, 3 * HIDDEN), "att": normal(2 * HIDDEN, HIDDEN), "v": normal(HIDDEN, 1)[:, 0],
            "out": normal(2 * HIDDEN, 1)[:, 0], "bias": np.zeros(1, np.float32),
        }
        self.scale, self.shift, self.empty = 1.0, 0.0, 0.0

    def inputs(self, ids: np.ndarray, grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Vectors of words: word and mean trigram vector side by side."""
        starts = np.r_[0, ends[:-1]]
        tri = np.add.reduceat(self.p["tri"][grams], starts, axis=0) / (ends - starts)[:, None]
        return np.concatenate([self.p["word"][ids], tri.astype(np.float32)], axis=1)

    def project(self, x: np.ndarray) -> np.ndarray:
        """Input parts of the gates, both directions: (words, 2, 3 * HIDDEN)."""
        return np.einsum("nd,kdh->nkh", x, self.p["w"], optimize=True) + self.p["b"]

    def forward(self, gates: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows from their words' gate inputs (windows, WINDOW, 2, 3 * HIDDEN); mask tells words from padding."""
        n, size, h = len(gates), gates.shape[1], HIDDEN
        states, cache, full = np.zeros((n, size, 2, h), np.float32), [], bool(mask.all())
        for k, order in ((0, range(size)), (1, range(size - 1, -1, -1))):
            s, u = np.zeros((n, h), np.float32), self.p["u"][k]
            uz, uh = np.ascontiguousarray(u[:, :2 * h]), np.ascontiguousarray(u[:, 2 * h:])
            for t in order:
                g = gates[:, t, k]
                zr = _sigmoid(g[:, :2 * h] + s @ uz)
                z, r = zr[:, :h], zr[:, h:]
                rs = r * s
                c = np.tanh(g[:, 2 * h:] + rs @ uh)
                new = s + z * (c - s)
                if not full:
                    new = np.where(mask[:, t, None], new, s)
                if keep:
                    cache.append((k, t, s, z, r, rs, c))
                s = new
                states[:, t, k] = s
        flat = states.reshape(n, size, 2 * h)
        a = np.tanh(flat @ self.p["att"])
        e = np.where(mask, a @ self.p["v"], -1e9)
        e = np.exp(e - e.max(axis=1, keepdims=True)) * mask
        weight = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-9)
        pool = np.einsum("nt,nth->nh", weight, flat)
        logit = pool @ self.p["out"] + self.p["bias"][0]
        return (logit, (cache, flat, a, weight, pool)) if keep else logit

    def gradients(self, kept, mask: np.ndarray, d: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of all but the inputs' parameters, and of the gate inputs, from those of the logits."""
        cache, flat, a, weight, pool = kept
        n, size, _ = flat.shape
        h, p = HIDDEN, self.p
        g = {"out": pool.T @ d, "bias": d.sum(keepdims=True)}
        dpool = d[:, None] * p["out"]
        dflat = weight[:, :, None] * dpool[:, None]
        dw = np.einsum("nth,nh->nt", flat, dpool)
        de = weight * (dw - (weight * dw).sum(axis=1, keepdims=True))
        g["v"] = np.einsum("nth,nt->h", a, de)
        da = de[:, :, None] * p["v"] * (1 - a * a)
        g["att"] = np.einsum("nti,nth->ih", flat, da, optimize=True)
        dflat = (dflat + da @ p["att"].T).reshape(n, size, 2, h)
        g["u"], dgates = np.zeros_like(p["u"]), np.zeros((n, size, 2, 3 * h), np.float32)
        ds, at = np.zeros((n, h), np.float32), None
        for k, t, s, z, r, rs, c in reversed(cache):
            if k != at:
                ds, at = np.zeros((n, h), np.float32), k
            ds = ds + dflat[:, t, k]
            on = mask[:, t, None]
            dn = ds * on
            dc = dn * z * (1 - c * c)
            dz = dn * (c - s) * z * (1 - z)
            drs = dc @ p["u"][k][:, 2 * h:].T
            dr = drs * s * r * (1 - r)
            dzr = np.concatenate([dz, dr], axis=1)
            g["u"][k][:, 2 * h:] += rs.T @ dc
            g["u"][k][:, :2 * h] += s.T @ dzr
            dgates[:, t, k, :2 * h], dgates[:, t, k, 2 * h:] = dzr, dc
            ds = ds * ~on + dn * (1 - z) + drs * r + dzr @ p["u"][k][:, :2 * h].T
        return g, dgates


class Scorer:
    """Scores texts with a trained network; remembers words' projections."""

    def __init__(self, net: BiGru):
        self.net, self.known, self.rows = net, {}, None
        self._clear()

    def _clear(self) -> None:
        self.known, self.used = {}, 1  # row 0 is the padding
        self.rows = np.zeros((4096, 2, 3 * HIDDEN), np.float32)

    def ids(self, tokens: list[bytes]) -> np.ndarray:
        """Rows of the words' projections; those of new words are added."""
        look = self.known.get
        got = np.fromiter(map(look, tokens, repeat(0)), np.int32, len(tokens))
        absent = np.flatnonzero(got == 0)
        if len(absent):
            missed = [tokens[i] for i in absent.tolist()]
            new = list(dict.fromkeys(missed))
            if self.used + len(new) > len(self.rows):
                self.rows = np.concatenate([self.rows, np.zeros((max(len(self.rows), len(new)), *self.rows.shape[1:]), np.float32)])
            self.rows[self.used:self.used + len(new)] = self.net.project(self.net.inputs(*_features(new)))
            self.known.update(zip(new, range(self.used, self.used + len(new))))
            self.used += len(new)
            got[absent] = np.fromiter(map(look, missed), np.int32, len(missed))
        return got

    def scores(self, texts) -> np.ndarray:
        best = np.full(len(texts), -np.inf)
        held: list[tuple[int, np.ndarray]] = []
        size = 0
        for i, text in enumerate(texts):
            tokens = words(text)
            starts = windows(len(tokens))
            for at in range(0, len(starts), 2048):  # a long text goes in parts
                few = starts[at:at + 2048]
                held.append((i, tokens[few[0]:few[-1] + WINDOW]))
                size += len(held[-1][1]) + 8
                if size > 50_000:
                    self._score(held, best)
                    held, size = [], 0
        self._score(held, best)
        return 1 / (1 + np.exp(-np.clip(self.net.scale * best + self.net.shift, -60, 60)))

    def _score(self, held: list[tuple[int, list[bytes]]], best: np.ndarray) -> None:
        """Raise ``best`` to the highest window of each run of words in ``held``."""
        if self.used > CACHE:
            self._clear()
        ids = self.ids([w for _, tokens in held for w in tokens])
        full, short, at = [], [], 0
        for i, tokens in held:
            n = len(tokens)
            if not n:
                best[i] = max(best[i], self.net.empty)
            elif n < WINDOW:
                short.append((i, np.pad(ids[at:at + n], (0, WINDOW - n))))
            else:
                full += [(i, at + start) for start in windows(n)]
            at += n
        if short:  # only these need a mask
            part = np.stack([x for _, x in short])
            np.maximum.at(best, [i for i, _ in short], self.net.forward(self.rows[part], part > 0))
        owner, starts = np.array([i for i, _ in full], int), np.array([a for _, a in full], int)
        for k in range(0, len(full), BATCH):
            part = ids[starts[k:k + BATCH, None] + np.arange(WINDOW)]
            np.maximum.at(best, owner[k:k + BATCH], self.net.forward(self.rows[part], part > 0))


def fitted(texts: list[str], y: np.ndarray, epochs: int = 8, seed: int = 3) -> BiGru | float:
    """The network for texts and labels, or the share of toxic labels if there is one class alone."""
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    rng, net = np.random.default_rng(seed), BiGru()
    number: dict[bytes, int] = {}
    held, owner = [], []
    for i, text in enumerate(texts):
        ids = np.array([number.setdefault(w, len(number) + 1) for w in words(text)], np.int32)
        ids = np.pad(ids, (0, max(0, WINDOW - len(ids))))
        for at in windows(len(ids)):
            held.append(ids[at:at + WINDOW])
            owner.append(i)
    wins, owner = np.stack(held), np.array(owner)
    word, grams, ends = _features(list(number))
    starts = np.r_[0, ends[:-1]]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, target = 0, y[owner]
    logits = np.zeros(len(wins))

    def batch_inputs(win):
        used, inverse = np.unique(win, return_inverse=True)
        rows = used[used > 0] - 1
        own_ends = np.cumsum(ends[rows] - starts[rows])
        own_grams = np.concatenate([grams[starts[r]:ends[r]] for r in rows]) if len(rows) else np.zeros(0, np.int64)
        x = net.inputs(word[rows], own_grams, own_ends) if len(rows) else np.zeros((0, 2 * DIM), np.float32)
        if len(rows) < len(used):
            x = np.concatenate([np.zeros((1, 2 * DIM), np.float32), x])
        return x, inverse.reshape(win.shape), rows, own_grams, own_ends

    for epoch in range(epochs):
        neg, pos = np.flatnonzero(target == 0), np.flatnonzero(target == 1)
        if epoch:  # of each toxic document the highest window, and others that score like toxic ones
            order = np.lexsort((logits[pos], owner[pos]))
            top = pos[order][np.r_[owner[pos][order][1:] != owner[pos][order][:-1], True]]
            pos = np.union1d(top, pos[logits[pos] > max(0.0, np.median(logits[top]))])
            hard = neg[np.argsort(-logits[neg])[: len(pos)]]
            neg = np.concatenate([hard, rng.choice(neg, min(len(neg), 2 * len(pos)))])
        else:
            neg, pos = (rng.choice(a, min(len(a), 12_000), replace=False) for a in (neg, pos))
        pick = rng.permutation(np.concatenate([np.resize(pos, max(len(pos), min(len(neg) // 2, 4000))), neg]))
        if len(pick) < 6000:
            pick = rng.permutation(np.resize(pick, 6000))
        for at in range(0, len(pick), 256):
            rows = pick[at:at + 256]
            win, yy = wins[rows], target[rows]
            x, inverse, used, own_grams, own_ends = batch_inputs(win)
            mask = win > 0
            logit, kept = net.forward(net.project(x)[inverse], mask, keep=True)
            d = ((_sigmoid(logit) - yy) / len(yy)).astype(np.float32)
            g, dgates = net.gradients(kept, mask, d)
            flat = (dgates * mask[:, :, None, None]).reshape(-1, 2, 3 * HIDDEN)
            per = np.zeros((len(x), 2, 3 * HIDDEN), np.float32)
            np.add.at(per, inverse.ravel(), flat)
            g["w"], g["b"] = np.einsum("nd,nkh->kdh", x, per, optimize=True), per.sum(axis=0)
            dx = np.einsum("nkh,kdh->nd", per, net.p["w"], optimize=True)[len(x) - len(used):]
            g["word"], g["tri"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["tri"])
            np.add.at(g["word"], word[used], dx[:, :DIM])
            many = np.diff(np.r_[0, own_ends])
            np.add.at(g["tri"], own_grams, np.repeat(dx[:, DIM:] / many[:, None], many, axis=0))
            step += 1
            rate = 0.01 * (0.3 if epoch >= epochs - 2 else 1)
            for k, v in g.items():
                m1, m2 = moment[k]
                m1 += 0.1 * (v - m1)
                m2 += 0.001 * (v * v - m2)
                net.p[k] -= rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        table_ = np.concatenate([np.zeros((1, 2, 3 * HIDDEN), np.float32), net.project(net.inputs(word, grams, ends))]) if number else None
        logits = np.concatenate([net.forward(table_[wins[a:a + BATCH]], wins[a:a + BATCH] > 0) for a in range(0, len(wins), BATCH)])
    top = np.full(len(y), -np.inf)
    np.maximum.at(top, owner, logits)
    net.scale, net.shift = _calibrated(top, y)
    net.empty = float(np.median(top[y == 0]))
    return net


def _calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logit with equal weight for both classes, by Newton steps with a light ridge."""
    mean, spread = z.mean(), z.std() + 1e-6
    x = np.c_[(z - mean) / spread, np.ones(len(z))]
    w, weight = np.zeros(2), np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w -= np.linalg.solve(hess, x.T @ (weight * (p - y)) + 1e-3 * w)
    scale = max(w[0] / spread, 1e-3)
    return float(scale), float(w[1] - scale * mean)


def trained(docs: DataFrame, labels: DataFrame) -> BiGru | float:
    known = labels.filter(F.col("toxic").isin(0, 1))
    parts = [sample(docs, known.filter(F.col("toxic") == v), "toxic", 5, 0, most).toPandas() for v, most in ((0, MAX_CLEAN), (1, MAX_TOXIC))]
    data = pd.concat(parts).sort_values(["doc_id", "y"], kind="stable")
    return fitted(data["text"].tolist(), data["y"].to_numpy(float))


def scored(docs: DataFrame, model: BiGru | float) -> DataFrame:
    """doc_id and score of each document."""
    if not isinstance(model, BiGru):
        return docs.select("doc_id", F.lit(model).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for part in slices(parts):
            yield pd.Series(scorer.scores(part.tolist()))

    return docs.select("doc_id", score("text").alias("score"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = scored(docs, trained(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))
