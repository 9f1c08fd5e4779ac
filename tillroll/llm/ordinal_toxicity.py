"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

All grades share one weight per feature; ordered thresholds cut the line on which
a text's weights add up: P(grade <= k) = sigmoid(threshold_k - weights). Features
are the words of a text and their beginnings, present or not, so a text's length
does not matter. A text is toxic if grade 1 or more is as likely as not; the
thresholds are moved together to where that makes the fewest errors on rows the
weights were not fitted on.

The labels say only whether a text is toxic. The grades above the first are not
labelled: they split the toxic texts of the sample by how many telling features
they hold, so they order texts by the amount of such language and no more.

The model is fitted on a bounded sample of labelled rows (``fit_rows``, those
with the lowest hashes of their key) and applied to every row. Without toxic rows to learn from
nothing is toxic. A null or empty text has no features; null labels are left
out; repeated rows are graded each.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import labelled_sample
from tillroll.sources.scratch import written

_WORD = re.compile(r"[^\W\d_]+")

#: Words whose features are kept.
CACHE_ENTRIES = 100_000

#: Grades of toxic texts; grade 0 is not toxic.
GRADES = 3

#: Parts of the sample, each graded by weights of the others, to place the thresholds.
FOLDS = 3

GRADED_TYPE = T.StructType(
    [
        T.StructField("toxic", T.BooleanType()),
        T.StructField("grade", T.IntegerType()),
        T.StructField("expected_severity", T.DoubleType()),
        T.StructField("p_toxic", T.DoubleType()),
    ]
)


def word_features(word):
    """A word and its first four to six letters, if it has more."""
    return [word, *(f"{n}:{word[:n]}" for n in (4, 5, 6) if len(word) > n)]


def text_features(text):
    return sorted({f for w in set(_WORD.findall((text or "").lower())) for f in word_features(w)})


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class OrdinalModel:
    """``weights`` by feature and increasing ``thresholds``."""

    def __init__(self, weights, thresholds):
        self.weights, self.thresholds = weights, np.asarray(thresholds, np.float64)

    def above(self, line):
        """P(grade > k) for each k, one row per text."""
        return _sigmoid(np.asarray(line, np.float64)[:, None] - self.thresholds)


def fit(rows, grades, n_features, n_grades=GRADES, steps=400, rate=0.1, ridge=0.02):
    """Weights and thresholds from lists of feature numbers and grades 0..n_grades."""
    grades = np.asarray(grades, np.int64)
    ends = np.array([len(r) for r in rows], np.int64)
    which = np.repeat(np.arange(len(rows)), ends)
    what = np.concatenate([np.asarray(r, np.int64) for r in rows] + [np.zeros(0, np.int64)])
    weights = np.zeros(n_features)
    shares = [(np.sum(grades <= k) + 1) / (len(grades) + 2) for k in range(n_grades)]
    start = np.log(np.array(shares) / (1 - np.array(shares)))
    steps_up = np.log(np.maximum(np.diff(start), 1e-2))
    free = np.r_[start[0], steps_up]  # the first threshold, then logs of the distances
    moments = [np.zeros(n_features + n_grades) for _ in range(2)]
    for t in range(1, steps + 1):
        thresholds = np.cumsum(np.r_[free[0], np.exp(free[1:])])
        line = np.bincount(which, weights[what], len(rows))
        below = np.c_[np.zeros(len(rows)), _sigmoid(thresholds - line[:, None]), np.ones(len(rows))]
        each = np.arange(len(rows))
        p = np.maximum(below[each, grades + 1] - below[each, grades], 1e-9)
        slope = below * (1 - below)
        high, low = slope[each, grades + 1] / p, slope[each, grades] / p
        by_line = high - low  # of the loss, as are all that follow
        g_weights = np.bincount(what, by_line[which], n_features) / len(rows) + ridge * weights / len(rows)
        g_thresholds = np.zeros(n_grades + 2)
        np.add.at(g_thresholds, grades + 1, -high)
        np.add.at(g_thresholds, grades, low)
        g_thresholds = g_thresholds[1:-1] / len(rows)
        later = np.cumsum(g_thresholds[::-1])[::-1]
        gradient = np.r_[g_weights, later[0], later[1:] * np.exp(free[1:])]
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.999 * moments[1] + 0.001 * gradient**2
        step = rate * moments[0] / (1 - 0.9**t) / (np.sqrt(moments[1] / (1 - 0.999**t)) + 1e-8)
        weights, free = weights - step[:n_features], free - step[n_features:]
    return weights, np.cumsum(np.r_[free[0], np.exp(free[1:])])


def best_cut(line, toxic):
    """The cut on the line of weights with the fewest errors, in the widest gap."""
    order = np.argsort(line, kind="stable")
    line, toxic = line[order], np.asarray(toxic, bool)[order]
    errors = np.cumsum(np.r_[0, np.where(toxic, 1, -1)]) + np.sum(~toxic)
    gaps, errors = np.diff(line), errors[1:-1]
    between = gaps > 1e-9
    if not between.any():
        return float(line[-1]) + 1
    fewest = between & (errors == errors[between].min())
    widest = int(np.argmax(np.where(fewest, gaps, 0)))
    return float(line[widest] + line[widest + 1]) / 2


def _lines(rows, weights):
    return np.array([weights[x].sum() for x in rows])


def calibration(rows, grades, n_features):
    """What to add to the thresholds so that the first tells toxic texts best.

    Each fold is graded by weights fitted on the others; ``rows`` come in an order
    that spreads the grades over the folds.
    """
    fold, apart = np.arange(len(rows)) % FOLDS, np.zeros(len(rows))
    for f in range(FOLDS):
        others, own = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        weights, thresholds = fit([rows[i] for i in others], grades[others], n_features)
        apart[own] = _lines([rows[i] for i in own], weights) - thresholds[0]
    return best_cut(apart, grades > 0)


def featured_sample(docs, labels, label, key, text, fit_rows):
    """(y, features) of at most ``fit_rows`` labelled rows, stored."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def features_of(texts: pd.Series) -> pd.Series:
        return pd.Series([text_features(t) for t in texts], dtype=object)

    sample = labelled_sample(docs, labels, label, fit_rows, key, text)
    return written(sample.select("y", features_of("text").alias("features")), "featured")


def select_features(sample, at_least=4, n=4000):
    """The ``n`` features that tell toxic texts most, found in some of them."""
    counts = (
        sample.select("y", F.explode("features").alias("feature"))
        .groupBy("feature")
        .agg(F.sum("y").alias("toxic"), F.count("*").alias("texts"))
        .filter(F.col("toxic") >= at_least)
    )
    base = sample.agg(F.sum("y").alias("t"), F.count("*").alias("n")).first()
    if not base["t"] or base["t"] == base["n"]:
        return []
    share = base["t"] / base["n"]
    expected, least = F.col("texts") * share, (2 + share) / 3
    surplus = (F.col("toxic") - expected) / F.sqrt(expected * (1 - share))
    best = (
        counts.withColumn("surplus", surplus)
        .filter((F.col("surplus") > 4) & (F.col("toxic") > F.col("texts") * least))
        .orderBy(F.desc("surplus"), "feature")
        .limit(n)
    )
    return sorted(r["feature"] for r in best.select("feature").collect())


def fit_toxicity(docs, labels, label="toxic", key="doc_id", text="text", fit_rows=15_000):
    """Fit on binary labels, the grades 1 to ``GRADES`` by how many features a text has."""
    sample = featured_sample(docs, labels, label, key, text, fit_rows)
    chosen = select_features(sample)
    if not chosen:
        return OrdinalModel({}, [30.0 + g for g in range(GRADES)])
    number = {feature: i for i, feature in enumerate(chosen)}

    @F.pandas_udf(T.BinaryType())
    def numbered(found: pd.Series) -> pd.Series:
        each = ([number[f] for f in x if f in number] for x in found)
        return pd.Series([np.array(x, "<u2").tobytes() for x in each], dtype=object)

    sparse = sample.select("y", numbered("features").alias("x"))
    rows = sorted((r["y"], bytes(r["x"])) for r in sparse.collect())  # the order has a say in sums
    y, sparse = np.array([r[0] for r in rows]), [np.frombuffer(r[1], "<u2") for r in rows]
    amount = np.array([len(x) for x in sparse])
    edges = np.quantile(amount[y > 0], np.arange(1, GRADES) / GRADES)
    grades = np.where(y > 0, 1 + np.searchsorted(edges, amount, side="left"), 0)
    weights, thresholds = fit(sparse, grades, len(chosen))
    thresholds = thresholds + calibration(sparse, grades, len(chosen))
    return OrdinalModel(dict(zip(chosen, weights.tolist())), thresholds)


class _Lines:
    """Sums of weights; what a word has is looked up once."""

    def __init__(self, weights):
        self.weights, self.known = weights, {}

    def of(self, text):
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        known, found = self.known, set()
        for word in set(_WORD.findall((text or "").lower())):
            hits = known.get(word)
            if hits is None:
                hits = known[word] = tuple(f for f in word_features(word) if f in self.weights)
            if hits:
                found.update(hits)
        return sum(map(self.weights.__getitem__, sorted(found)))


def with_grades(docs, model, text="text", into="toxicity"):
    """``docs`` with a struct: toxic, grade, expected_severity, p_toxic.

    ``grade`` is the highest one at least as likely as not, 0 if none is;
    ``toxic`` is true from grade 1 on, which is where ``p_toxic`` reaches a half.
    """

    @F.pandas_udf(GRADED_TYPE)
    def graded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lines = _Lines(model.weights)
        for texts in batches:
            line = np.array([lines.of(t) for t in texts], np.float64)
            above = model.above(line)
            grade = (above >= 0.5).sum(1)
            yield pd.DataFrame(
                {
                    "toxic": grade > 0,
                    "grade": grade.astype(np.int32),
                    "expected_severity": above.sum(1),
                    "p_toxic": above[:, 0],
                }
            )

    return docs.withColumn(into, graded(F.col(f"`{text}`").cast("string")))


def without_toxic(docs, labels, key="doc_id", text="text"):
    """The rows and columns of ``docs`` whose text is not toxic."""
    model = fit_toxicity(docs, labels, key=key, text=text)
    graded = with_grades(docs, model, text, into="__toxicity")
    return graded.filter(~F.col("__toxicity.toxic")).drop("__toxicity")
