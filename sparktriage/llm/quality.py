"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics, scored as one Spark column.

Text statistics are Spark expressions. Shallow boosted trees over a bounded labelled sample propose rules (every path
from a root to a node is one conjunction of thresholds); a lasso logistic regression keeps few of them; those and their
weights are compiled into a single column expression, so scoring is one narrow pass in the JVM without a shuffle.

Defined results: null text is the empty text; empty and very long texts get a score as any other; repeated labels of a
document count once each; null labels and labels of unknown documents are ignored; without any usable label the score is
0.5, with labels of one class only it is that class's smoothed share; extra columns are kept by score_quality.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_labels, crc_mod, fresh

MAX_TRAIN = 20_000
THRESHOLD = 0.3


def _gone(t: Column, s: str) -> Column:
    return F.length(t) - F.length(F.replace(t, F.lit(s), F.lit("")))


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of one text by name; every one is a JVM expression, ratios are 0 for an empty text."""
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    words = F.split(t, "[ \n]")
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    lines = F.split(t, "\n")
    marks = F.regexp_replace(t, r"[\p{L}\p{N}\s]+", "")
    return {
        "log_chars": F.log1p(F.length(t).cast("double")),
        "word_chars": chars / n,
        "upper": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")) / chars,
        "marks": F.length(marks) / chars,
        "plain_marks": (_gone(t, ".") + _gone(t, ",")) / n,
        "shouts": _gone(t, "!") / n,
        "bars": _gone(t, "|") / n,
        "distinct_marks": F.size(F.array_distinct(F.split(marks, ""))).cast("double"),
        "digits": F.length(F.regexp_replace(t, r"[^0-9]+", "")) / chars,
        "distinct_words": F.size(F.array_distinct(words)) / n,
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
        "line_words": n / F.size(lines).cast("double"),
    }


@dataclass
class RuleEnsemble:
    """bias + sum of weights of the rules that hold, through a sigmoid. A rule: ((statistic, "<=" or ">", cut), ...)."""

    bias: float
    rules: list[tuple[tuple[str, str, float], ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def column(self, stat: dict[str, Column]) -> Column:
        """The score as one Spark expression over columns of statistics."""
        total = F.lit(float(self.bias))
        for rule, w in zip(self.rules, self.weights, strict=True):
            hold = F.lit(True)
            for name, op, cut in rule:
                hold = hold & ((stat[name] <= F.lit(cut)) if op == "<=" else (stat[name] > F.lit(cut)))
            total = total + F.when(hold, F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _holds(x: np.ndarray, names: list[str], rule) -> np.ndarray:
    keep = np.ones(len(x), bool)
    for name, op, cut in rule:
        v = x[:, names.index(name)]
        keep &= (v <= cut) if op == "<=" else (v > cut)
    return keep


def _grow(x, bins, cuts, names, g, h, rows, depth, path, rules, rng, out):
    """One regression tree on gradients; each node's path is a rule. out gets the leaf values."""
    if path:
        rules.add(tuple(path))
    best = (1e-3, None, None)
    tg, th = g[rows].sum(), h[rows].sum()
    if depth and len(rows) >= 20:
        for f in rng.permutation(len(names))[: max(3, len(names) * 2 // 3)]:
            k = len(cuts[f])
            if not k:
                continue
            b = bins[rows, f]
            lg, lh = (np.bincount(b, v[rows], k + 1).cumsum()[:k] for v in (g, h))
            count = np.bincount(b, minlength=k + 1).cumsum()[:k]
            gain = lg**2 / (lh + 1) + (tg - lg) ** 2 / (th - lh + 1) - tg**2 / (th + 1)
            gain[(count < 8) | (len(rows) - count < 8)] = -1
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], f, i)
    if best[1] is None:
        out[rows] = tg / (th + 1)
        return
    _, f, i = best
    left = bins[rows, f] <= i
    for side, op in ((rows[left], "<="), (rows[~left], ">")):
        _grow(x, bins, cuts, names, g, h, side, depth - 1, [*path, (names[f], op, float(cuts[f][i]))], rules, rng, out)


def _lasso(z: np.ndarray, y: np.ndarray, lam: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """L1 logistic regression by accelerated proximal gradient; the bias is free."""
    n, m = z.shape
    lip = 0.25 * (float(np.linalg.norm(z, 2)) ** 2 / n + 1.0) if m else 0.25
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    b, w = float(np.log(p / (1 - p))), np.zeros(m)
    vb, vw, t = b, w.copy(), 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(vb + z @ vw))) - y
        nb, nw = vb - r.mean() / lip, vw - (z.T @ r) / n / lip
        nw = np.sign(nw) * np.maximum(np.abs(nw) - lam / lip, 0)
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vb, vw = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        b, w, t = nb, nw, nt
    return b, w


def _loss(z, y, b, w) -> float:
    s = b + z @ w
    return float(np.mean(np.logaddexp(0, s) - y * s))


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 40, depth: int = 3, seed: int = 7) -> RuleEnsemble:
    """Trees to rules to lasso weights; lambda by loss on a fifth of the rows held back."""
    n, pos = len(y), float(y.sum()) if len(y) else 0.0
    if n < 40 or pos == 0 or pos == n:
        p = (pos + 1) / (n + 2)
        return RuleEnsemble(float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.01, 0.99, 63))) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], 1)
    rules: set = set()
    s = np.full(n, np.log(pos / (n - pos)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-s))
        rows, out = rng.permutation(n)[: max(40, n * 7 // 10)], np.zeros(n)
        _grow(x, bins, cuts, names, y - p, p * (1 - p), np.sort(rows), depth, [], rules, rng, out)
        s = s + 0.3 * out
    found = sorted(rules)
    z = np.stack([_holds(x, names, r) for r in found], 1).astype(float) if found else np.zeros((n, 0))
    _, first = np.unique(z, axis=1, return_index=True)
    first = np.sort(first)
    z, found = z[:, first], [found[i] for i in first]
    fold = rng.permutation(n) % 5 == 0
    losses = {lam: _loss(z[fold], y[fold], *_lasso(z[~fold], y[~fold], lam)) for lam in (0.02, 0.01, 0.005, 0.002)}
    b, w = _lasso(z, y, min(losses, key=losses.get), 600)
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleEnsemble(float(b), [found[i] for i in kept], [float(w[i]) for i in kept])


def train_quality(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> RuleEnsemble:
    """Fit on at most max_train labelled documents outside the held-out fold (crc32 mod 5 = 0); the sample is broadcast."""
    rows = labels.select("doc_id", F.col("quality").cast("double").alias("__y")).where("doc_id is not null and __y in (0, 1)")
    rows = bounded_labels(rows.where(crc_mod(F.col("doc_id"), 5) != 0), max_train, "quality")
    chosen = documents.select("doc_id", "text").join(F.broadcast(rows), "doc_id")
    stat = statistics(F.col("text"))
    got = chosen.select("__y", *[c.cast("double").alias(k) for k, c in stat.items()]).toPandas()  # max_train rows of numbers
    got = got.sort_values(["__y", *stat], kind="stable")  # one order, so that the same sample gives the same rules
    return fit_rules(got[list(stat)].to_numpy(float), got["__y"].to_numpy(float), list(stat))


def score_quality(documents: DataFrame, model: RuleEnsemble, threshold: float = THRESHOLD, prefix: str = "quality_") -> DataFrame:
    """documents with <prefix>score and <prefix>predicted (columns of these names are replaced); one narrow pass over the whole texts."""
    documents = documents.drop(f"{prefix}score", f"{prefix}predicted")
    own_stat = fresh(documents, "stat_")
    used = {name for rule in model.rules for name, _, _ in rule}
    stat = {k: c for k, c in statistics(F.col("text")).items() if k in used}
    # a generator of one row: neither projections nor filters above it are folded into the statistics, so each is computed once
    own = documents.select("*", F.inline(F.array(F.struct(F.lit(0).alias(own_stat), *[c.cast("double").alias(f"{own_stat}{k}") for k, c in stat.items()]))))
    score = model.column({k: F.col(f"{own_stat}{k}") for k in stat})
    out = own.withColumn(f"{prefix}score", score).drop(own_stat, *[f"{own_stat}{k}" for k in stat])
    return out.withColumn(f"{prefix}predicted", (F.col(f"{prefix}score") >= threshold).cast("int"))


def op9_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train_quality(documents, labels)
    scored = score_quality(documents.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))
