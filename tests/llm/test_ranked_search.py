import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tillroll.llm import ranked_search as search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, limit=20):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 100 - 25 + 25 * c.total() * n_docs // n_terms
            score = 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d))
        best = sorted(scored)[:limit]
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(best)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(8)

    def text(n):
        return " ".join(f"w{int(rng.paretovariate(0.5)) % 400}" for _ in range(n))

    docs = [(i, text(rng.randrange(1, 120))) for i in range(600)]
    docs += [(1000 + i, docs[7][1]) for i in range(90)]  # copies: equal scores
    docs += [(2, "Éa-x_W1 w2"), (5000, None), (5001, ""), (5002, " .,"), (None, docs[3][1])]
    docs += docs[10:13] + [(5003, text(40_000))]
    items = [(f"i{i}", text(rng.randrange(1, 90))) for i in range(25)]
    items += [("copy", docs[7][1]), ("twice", "W1, w1 w2"), ("i1", "w3"), (None, "éa W9 Éa")]
    return docs, [*items, ("none", "unseen"), ("null", None), ("empty", "?")]


@pytest.mark.parametrize(
    "settings", [{}, {"BLOCK_DOCS": 50, "SCORED": 3, "ITEM_TERMS": 60}, {"BLOCK_TERMS": 10}]
)
def test_against_brute_force(spark, tables, monkeypatch, conf, settings):
    conf("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    for name, value in settings.items():
        monkeypatch.setattr(search, name, value)
    docs, items = tables
    found = search.ranked(
        spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n int").repartition(3),
        spark.createDataFrame([(*r, 1) for r in items], "item_id string, text string, item int"),
    )
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items)


def test_text_ids_and_a_smaller_limit(spark, tables):
    docs, items = [(f"d{i}", t) for i, t in tables[0]], tables[1][:5]
    found = search.ranked(
        spark.createDataFrame(docs, "key string, body string"),
        spark.createDataFrame(items, "item_id string, text string"),
        limit=3,
        doc_id="key",
        text="body",
    )
    assert sorted(map(tuple, found.collect()), key=str) == brute(docs, items, 3)


def test_few_documents_are_scored(spark, tables, monkeypatch, conf):
    """Masks that cannot reach the best are left alone."""
    docs, items = tables
    scored = []
    scores = search._Block.scores
    monkeypatch.setattr(
        search._Block, "scores", lambda self, docs, *a: scored.append(len(docs)) or scores(self, docs, *a)
    )
    counts = [Counter(terms(t)) for _, t in docs if terms(t)]
    numbers = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
    block = search._Block(
        list(range(len(counts))),
        np.array([c.total() for c in counts]),
        np.array([len(c) for c in counts]),
        np.array([numbers[t] for c in counts for t in sorted(c)]),
        np.array([c[t] for c in counts for t in sorted(c)]),
        len(counts),
        sum(c.total() for c in counts),
    )
    df = Counter(t for c in counts for t in c)
    telling = sorted((t for t in df if 30 <= df[t] <= 60), key=df.get)[:3]
    assert len(telling) == 3
    asked = [numbers[t] for t in (*telling, "w1", "w2", "w3")]
    best = search._Best(20)
    block.search(np.array(asked), np.array([9000, 8000, 7000, 10, 9, 8]), best)
    assert len(best.rows) == 20 and sum(scored) < len(counts) / 3


@pytest.mark.parametrize("empty", ["docs", "items", "both"])
def test_empty_tables(spark, empty):
    docs = spark.createDataFrame([] if empty != "items" else [(1, "a")], "doc_id long, text string")
    items = spark.createDataFrame([] if empty != "docs" else [(1, "a")], "item_id long, text string")
    assert search.ranked(docs, items).count() == 0
