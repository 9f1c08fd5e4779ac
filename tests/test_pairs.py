import random
from collections import Counter
from itertools import combinations

import pytest
from conftest import plan_of

from tillroll.operators import pairs
from tillroll.operators.pairs import frequent_pairs


def brute_force(rows):
    baskets = {}
    for basket, item, weight in rows:
        baskets.setdefault(basket, {})[item] = weight
    counts = Counter()
    for content in baskets.values():
        for a, b in combinations(sorted(content), 2):
            counts[a, b] += content[a] * content[b]
    return counts


def shop(seed, baskets, items, heavy=0, weights=(1,)):
    source = random.Random(seed)
    names = [f"i{n:03d}" for n in range(items)]
    rows = []
    for basket in range(baskets):
        width = items if basket < heavy else source.randint(1, 5)
        for item in source.sample(names, width):
            rows.append((basket, item, source.choice(weights)))
    return rows


def run(spark, rows, minimum, n, narrow, part_width=3):
    df = spark.createDataFrame(rows, "basket bigint, item string, weight bigint")
    found, items = frequent_pairs(df, minimum, n, part_width, narrow)
    return (
        {(r.item_a, r.item_b): r.frequency for r in found.collect()},
        {r.item: r.baskets for r in items.collect()},
    )


@pytest.mark.parametrize("narrow", [0, 3, 6, 1000])
@pytest.mark.parametrize(
    "baskets, items, heavy, weights, minimum, n",
    [
        (200, 12, 0, (1,), 5, 10),
        (200, 30, 1, (1,), 1, None),
        (200, 30, 1, (1,), 5, None),
        (300, 30, 3, (1, 2, 3), 5, None),
        (300, 30, 3, (1, 2, 3), 2, 3),
        (60, 20, 30, (1,), 5, 10),
    ],
)
def test_matches_brute_force(spark, baskets, items, heavy, weights, minimum, n, narrow):
    rows = shop(baskets + heavy, baskets, items, heavy, weights)
    truth = {p: c for p, c in brute_force(rows).items() if c >= minimum}
    found, popularity = run(spark, rows, minimum, n, narrow)
    assert popularity == Counter(item for _, item, _ in rows)
    if n is None:
        assert found == truth
    else:
        # All that could rank, ties included, and nothing false.
        cut = sorted(truth.values(), reverse=True)[: n][-1] if truth else 0
        assert all(truth[p] == c for p, c in found.items())
        assert {p for p, c in truth.items() if c >= cut} <= set(found)


@pytest.fixture
def paired(monkeypatch):
    """What is paired within rows, and the bitmaps that are paired by words."""
    seen = {"rows": [], "words": []}
    within, words = pairs._pairs_within, pairs._pairs_of_words

    def watch_rows(baskets):
        seen["rows"].append(baskets.groupBy("basket").count().agg({"count": "max"}).first()[0])
        return within(baskets)

    def watch_words(bitmaps, part_width):
        rows = bitmaps.filter("NOT looked_up")
        seen["words"].append(rows.selectExpr("coalesce(max(bit_count(bits)), 0)").first()[0])
        return words(bitmaps, part_width)

    monkeypatch.setattr(pairs, "_pairs_within", watch_rows)
    monkeypatch.setattr(pairs, "_pairs_of_words", watch_words)
    return seen


def test_wide_basket_is_looked_up_not_paired(spark, paired):
    rows = shop(5, 300, 60, heavy=1)
    found, _ = run(spark, rows, 4, None, 10)
    assert found == {p: c for p, c in brute_force(rows).items() if c >= 4}
    assert max(paired["rows"]) <= 10 and paired["words"] == [0]


def test_baskets_of_one_width_are_cut_one_by_one(spark, paired):
    rows = [(b, f"i{n}", 1) for b in range(6) for n in range(40)]
    found, _ = run(spark, rows, 6, None, 10)
    assert found == brute_force(rows) and paired["words"] == [1]


def test_wide_baskets_are_paired_by_words(spark, paired):
    """More wide baskets than a word has bits, some of them with weights."""
    rows = shop(9, 150, 25, heavy=140, weights=(1, 2))
    found, _ = run(spark, rows, 3, None, 10)
    assert found == {p: c for p, c in brute_force(rows).items() if c >= 3}
    assert max(paired["words"]) > 20 and (paired["rows"][0] or 0) <= 10


def test_nameless_baskets_pair_nothing(spark):
    rows = [(None, "a", 1), (None, "b", 1), (1, "a", 1), (1, "b", 1)]
    assert run(spark, rows, 1, None, 10) == ({("a", "b"): 1}, {"a": 2, "b": 2})
    assert run(spark, rows, 1, None, 1)[0] == {("a", "b"): 1}


def test_rare_items_are_dropped_from_a_wide_basket(spark):
    rows = [(0, f"rare{n}", 1) for n in range(100)]
    rows += [(b, item, 1) for b in range(1, 9) for item in ("x", "y", "z")]
    found, _ = run(spark, rows, 5, None, 20)
    assert found == {("x", "y"): 8, ("x", "z"): 8, ("y", "z"): 8}


def test_empty(spark):
    assert run(spark, [], 5, 20, 10) == ({}, {})


def test_parts_of_words_are_not_broadcast(spark):
    rows = [(w, f"i{i}", False, 1 << w) for w in range(4) for i in range(9)]
    bitmaps = spark.createDataFrame(rows, "word long, item string, looked_up boolean, bits long")
    met = pairs._pairs_of_words(bitmaps, 3)
    assert "SortMergeJoin [word" in plan_of(met)
    assert met.count() == 4 * 9 * 8 // 2
