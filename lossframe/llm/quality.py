"""Quality classifier: a sparse rule ensemble over text statistics.

Small trees, each grown on a resampled labelled sample, give conjunctive rules:
every path from a root to a node. A lasso logistic regression weighs the
rules; most get no weight. The rest are compiled into one Spark expression
over the statistics, which are Spark expressions too, so scoring is a single
scan without Python.

The trees learn from at most ``MAX_TRAIN`` labelled documents, chosen by a
hash of their id; each text is measured whole.

Cases: a null text counts as empty, whose statistics are 0; null labels are
not learned from; without labels the score is 0.5, with one class alone it is
that class's; repeated rows each get a row; an empty table gives no rows; given
columns pass through ``scored`` untouched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lossframe.llm.common import crc_mod, table

MAX_TRAIN = 20_000
TREES, DEPTH, BINS = 40, 3, 32
#: Weights of the lasso penalty that are tried on a fifth of the sample.
PENALTIES = (0.0003, 0.001, 0.003)


def statistics(text: Column) -> dict[str, Column]:
    """Each statistic as an expression of the text."""
    t = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    chars, words = F.char_length(t).cast("double"), count(r"\S++")
    share = lambda x, of: F.when(of > 0, x / of).otherwise(F.lit(0.0))
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    return {
        "chars": chars, "words": words,
        "word_length": share(chars, words),
        "symbols": share(count(r"[^\p{L}\p{N}\s.,]"), chars),
        "capitals": share(count(r"[A-Z]++[!A-Z]"), words),
        "digits": share(count(r"[0-9]++"), words),
        "stops": share(count(r"[.,!?]"), words),
        "sentences": share(count(r"[.!?](?=\s|$)"), words),
        "echoes": share(count(r"(?<!\S)(\S++)\s++(?=\1(?!\S))"), words),
        "one_letter": share(count(r"(?<!\S)\S(?!\S)"), words),
        "line_words": share(words, F.size(lines).cast("double")),
        "new_lines": share(F.size(F.array_distinct(lines)).cast("double"), F.size(lines).cast("double")),
    }


class Rules:
    """Weighted conjunctions: ``rules`` are tuples of (statistic, above, threshold)."""

    def __init__(self, names: list[str], rules: list[tuple], weights: np.ndarray, bias: float):
        self.names, self.rules, self.weights, self.bias = names, rules, weights, bias

    def column(self) -> Column:
        """The score as an expression over columns named like the statistics."""
        parts = [repr(float(self.bias)) + "D"]
        for rule, w in zip(self.rules, self.weights):
            fits = " and ".join(f"`{self.names[f]}` {'>' if above else '<='} {float(at)!r}D" for f, above, at in rule)
            parts.append(f"if({fits}, {float(w)!r}D, 0D)")
        return F.expr(f"1D / (1D + exp(-({' + '.join(parts)})))")

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.bias + _fits(self.rules, x) @ self.weights
        return 1 / (1 + np.exp(-z))


def _fits(rules: list[tuple], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for i, rule in enumerate(rules):
        for f, above, at in rule:
            out[:, i] *= (x[:, f] > at) if above else (x[:, f] <= at)
    return out


def _tree(x: np.ndarray, y: np.ndarray, cuts: list[np.ndarray], binned: np.ndarray, rng, path: tuple = ()) -> list[tuple]:
    """Paths to all nodes below; splits by the largest fall of the squared error over a random half of the statistics."""
    if len(path) == DEPTH or len(y) < 10 or y.min() == y.max():
        return []
    best = None
    for f in rng.permutation(x.shape[1])[: (x.shape[1] + 1) // 2]:
        if not len(cuts[f]):
            continue
        n = np.bincount(binned[:, f], minlength=len(cuts[f]) + 1).cumsum()[:-1]
        s = np.bincount(binned[:, f], y, minlength=len(cuts[f]) + 1).cumsum()[:-1]
        ok = (n >= 5) & (len(y) - n >= 5)
        if ok.any():
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (y.sum() - s) ** 2 / np.maximum(len(y) - n, 1), -1)
            if best is None or gain.max() > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
    if best is None or best[0] - y.sum() ** 2 / len(y) < 1e-9:
        return []
    _, f, k = best
    below = binned[:, f] <= k
    out = []
    for above, part in ((False, below), (True, ~below)):
        step = (*path, (int(f), above, float(cuts[f][k])))
        out += [step, *_tree(x[part], y[part], cuts, binned[part], rng, step)]
    return out


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient of the logistic loss with an l1 penalty on all but the bias."""
    n = len(y)
    rate = 1 / (0.25 * np.linalg.norm(np.c_[r, np.ones(n)], 2) ** 2 / n)
    w, b = np.zeros(r.shape[1]), 0.0
    v, c, t = w, b, 1.0
    for _ in range(steps):
        g = (1 / (1 + np.exp(-(r @ v + c))) - y) / n
        nw = v - rate * (r.T @ g)
        nw, nb = np.sign(nw) * np.maximum(abs(nw) - rate * penalty, 0), c - rate * g.sum()
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def fitted(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 7) -> Rules:
    """Rules and weights for statistics ``x`` and labels ``y``."""
    if not len(y) or y.min() == y.max():
        share = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
        return Rules(names, [], np.zeros(0), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] for f, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    rules: dict[tuple, None] = {}
    classes = [np.flatnonzero(y == v) for v in (0, 1)]
    for _ in range(TREES):
        rows = np.concatenate([rng.choice(c, min(len(c), 1500)) for c in classes])  # both classes alike
        rules |= dict.fromkeys(_tree(x[rows], y[rows], cuts, binned[rows], rng))
    fits, rules = _fits(list(rules), x), list(rules)
    _, first = np.unique(fits, axis=1, return_index=True)  # rules that fit the same rows
    rules, fits = [rules[i] for i in sorted(first)], fits[:, sorted(first)]
    test = rng.random(len(y)) < 0.2
    loss = []
    for penalty in PENALTIES:
        w, b = _lasso(fits[~test], y[~test], penalty)
        p = np.clip(1 / (1 + np.exp(-(fits[test] @ w + b))), 1e-9, 1 - 1e-9)
        loss.append(-(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean() if test.any() else 0)
    w, b = _lasso(fits, y, PENALTIES[int(np.argmin(loss))])
    kept = np.flatnonzero(w)
    return Rules(names, [rules[i] for i in kept], w[kept], float(b))


def sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, most: int) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled documents outside the held-out part; the chosen ids are what is broadcast.

    One row for each chosen id: of several labels the lowest, of several texts the first in order.
    """
    chosen = (labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), mod) != held_out))
              .groupBy("doc_id").agg(F.min(F.col(label).cast("double")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def trained(docs: DataFrame, labels: DataFrame) -> Rules:
    rows = sample(docs, labels, "quality", 3, 1, MAX_TRAIN)
    stats = statistics(F.col("text"))
    data = rows.select("doc_id", "y", *[c.alias(n) for n, c in stats.items()]).toPandas().sort_values("doc_id", kind="stable")
    return fitted(data[list(stats)].to_numpy(float), data["y"].to_numpy(float), list(stats))


def scored(docs: DataFrame, model: Rules) -> DataFrame:
    """The given columns as ``doc``, with score."""
    stats = statistics(F.col("doc.text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    return rows.select("doc", *[c.alias(n) for n, c in stats.items()]).select("doc", model.column().alias("score"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scored(docs, trained(docs, table(spark, sf_dir, "labels")))
    doc_id = F.col("doc.doc_id")
    return rows.select(doc_id.alias("doc_id"), (crc_mod(doc_id, 3) == 1).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"))
