"""Quality as a generalised additive model with pairwise interactions.

Cyclic boosting goes round the features; at each one a shallow tree over the
feature's bins corrects the score a little, and the corrections add up in a
lookup table. Afterwards the feature pairs that explain most of what is left get
tables of their own. A score is the sum of the looked-up values.

The model is fitted on a bounded sample of the labelled rows (``fit_rows``, those
with the lowest hashes of their key) and applied to every row. Without rows
of both labels the score is the smoothed share of label 1, or 0.5 without any
rows. Null labels are left out, null texts measure as empty ones.
"""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import labelled_sample
from tillroll.llm.measures import MEASURES, measure

FEATURES = (
    "log_words",
    "word_length",
    "symbols",
    "repeated_lines",
    "repeated_words",
    "words_per_line",
    "distinct_words",
    "letters",
    "upper",
    "digits",
    "stops",
    "loud",
    "long_words",
)


def features(measured):
    """Features of rows of measures, one column per feature."""
    m = dict(zip(MEASURES, np.asarray(measured, np.float64).reshape(-1, len(MEASURES)).T))
    words, lines = np.maximum(m["n_words"], 1), np.maximum(m["n_lines"], 1)
    chars, letters = np.maximum(m["word_chars"], 1), np.maximum(m["n_letters"], 1)
    columns = [
        np.log1p(m["n_words"]),
        m["word_chars"] / words,
        m["n_symbols"] / words,
        m["n_dup_lines"] / lines,
        m["n_repeat_words"] / words,
        np.log1p(m["n_words"] / lines),
        m["n_distinct_words"] / words**0.8,
        m["n_letters"] / chars,
        m["n_upper"] / letters,
        m["n_digits"] / chars,
        m["n_stops"] / words,
        m["n_loud"] / words,
        m["n_long_words"] / words,
    ]
    return np.stack(columns, axis=1)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _tree(gradient, weight, ridge, leaves=3):
    """Best piecewise constant over ordered bins: values per bin, and the gain."""
    cuts, gain = [0, len(gradient)], 0.0
    total, mass = np.cumsum(np.r_[0, gradient]), np.cumsum(np.r_[0, weight])

    def worth(a, b):
        return (total[b] - total[a]) ** 2 / (mass[b] - mass[a] + ridge)

    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                at = np.arange(a + 1, b)
                more = worth(a, at) + worth(at, b) - worth(a, b)
                if more.max() > best[0]:
                    best = (float(more.max()), int(at[more.argmax()]))
        if best[1] is None:
            break
        cuts, gain = sorted([*cuts, best[1]]), gain + best[0]
    values = np.zeros(len(gradient))
    for a, b in zip(cuts, cuts[1:]):
        values[a:b] = (total[b] - total[a]) / (mass[b] - mass[a] + ridge)
    return values, gain


def _quarters(g, h, ridge):
    """Values over two features' bins: one cut on the first, on each side one on the second."""
    best, step = -1.0, None
    for cut in range(1, max(2, len(g))):
        values, gain = np.zeros(g.shape), 0.0
        for side in (slice(0, cut), slice(cut, None)):
            row, more = _tree(g[side].sum(0), h[side].sum(0), ridge, leaves=2)
            values[side], gain = row, gain + more
            gain += g[side].sum() ** 2 / (h[side].sum() + ridge)
        if gain > best:
            best, step = gain, values
    return step


class AdditiveModel:
    """Tables per feature and per pair of features; ``fit`` makes one."""

    def __init__(self, base, edges, tables, coarse, pairs):
        self.base, self.edges, self.tables = base, edges, tables
        self.coarse, self.pairs = coarse, pairs

    def bins(self, x, edges):
        columns = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
        return np.stack(columns, axis=1)

    def raw(self, x):
        out = np.full(len(x), self.base)
        if self.tables:
            fine = self.bins(x, self.edges)
            for j, table in enumerate(self.tables):
                out += table[fine[:, j]]
        if self.pairs:
            rough = self.bins(x, self.coarse)
            for (i, j), table in self.pairs.items():
                out += table[rough[:, i], rough[:, j]]
        return out

    def score(self, x):
        return _sigmoid(self.raw(x))


def fit(x, y, bins=48, rounds=60, rate=0.2, n_pairs=6, pair_bins=8, ridge=2.0):
    """Fit on features ``x`` and labels ``y`` (0 or 1)."""
    y = np.asarray(y, np.float64)
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return AdditiveModel(float(np.log(share / (1 - share))), [], [], [], {})
    order = np.lexsort([*x.T[::-1], y])  # the order of the rows has no say in sums
    x, y = x[order], y[order]

    def edges_of(n):
        quantiles = np.linspace(0, 1, n + 1)[1:-1]
        return [np.unique(np.quantile(x[:, j], quantiles)) for j in range(x.shape[1])]

    model = AdditiveModel(float(np.log(y.mean() / (1 - y.mean()))), edges_of(bins), [], [], {})
    fine = model.bins(x, model.edges)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    raw = np.full(len(y), model.base)
    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            p = _sigmoid(raw)
            gradient = np.bincount(fine[:, j], y - p, len(table))
            weight = np.bincount(fine[:, j], p * (1 - p), len(table))
            step = rate * _tree(gradient, weight, ridge)[0]
            table += step
            raw += step[fine[:, j]]
    model.coarse = edges_of(pair_bins)
    rough = model.bins(x, model.coarse)
    sizes = [len(e) + 1 for e in model.coarse]

    def cells(i, j):
        return rough[:, i] * sizes[j] + rough[:, j]

    p = _sigmoid(raw)
    gains = []
    for i in range(x.shape[1]):
        for j in range(i):
            n = sizes[i] * sizes[j]
            g = np.bincount(cells(i, j), y - p, n)
            h = np.bincount(cells(i, j), p * (1 - p), n)
            gains.append((float((g**2 / (h + ridge)).sum()), i, j))
    for _, i, j in sorted(gains, reverse=True)[:n_pairs]:
        model.pairs[i, j] = np.zeros((sizes[i], sizes[j]))
    for _ in range(rounds // 3):
        for (i, j), table in model.pairs.items():
            p, n = _sigmoid(raw), sizes[i] * sizes[j]
            g = np.bincount(cells(i, j), y - p, n).reshape(table.shape)
            h = np.bincount(cells(i, j), p * (1 - p), n).reshape(table.shape)
            step = _quarters(g, h, ridge)
            table += rate * step
            raw += rate * step[rough[:, i], rough[:, j]]
    return model


def measured_texts(docs, text="text", into="measured"):
    """``docs`` with an array of the text's measures."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def measures_of(texts: pd.Series) -> pd.Series:
        return pd.Series([list(measure(t)) for t in texts], dtype=object)

    return docs.withColumn(into, measures_of(F.col(f"`{text}`").cast("string")))


def fit_quality(docs, labels, label="quality", key="doc_id", text="text", fit_rows=20_000):
    """Fit on at most ``fit_rows`` labelled rows, those with the lowest key hashes."""
    sample = measured_texts(labelled_sample(docs, labels, label, fit_rows, key, text))
    rows = sample.select("y", "measured").toPandas()
    return fit(features(list(rows["measured"])), rows["y"].to_numpy())


def with_quality(docs, model, text="text", into="score"):
    """``docs`` with the model's probability of label 1."""

    @F.pandas_udf(T.DoubleType())
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(features([measure(t) for t in texts])))

    return docs.withColumn(into, scores(F.col(f"`{text}`").cast("string")))
