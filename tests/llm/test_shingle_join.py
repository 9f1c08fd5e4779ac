import random

import numpy as np
import pytest

from tillroll.llm import shingle_join as join
from tillroll.llm.components import components
from tillroll.llm.shingles import Shingler


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lower = lower.replace(c, " ")
    return [w for w in lower.split(" ") if w]


def shingles(text):
    w = words(text)
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows):
    sets, label = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    ids = {}
    for (doc, _), x in zip(rows, label):
        if doc is not None:
            ids[x] = min(doc, ids.get(x, doc))
    return sorted(((d, len(s), ids.get(x)) for (d, _), s, x in zip(rows, sets, label)), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)

    def text(n, size=400):
        return [f"v{rng.randrange(size)}" for _ in range(n)]

    rows, line = [], text(12)
    for base in (text(90), text(300), text(25)):
        rows.append(base)
        for _ in range(40):  # near copies, some of them just too far
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 30)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(400)}"
            rows.append(copy)
    rows += [line + text(rng.randrange(12)) for _ in range(80)]  # a line that many share
    rows += [text(rng.randrange(1, 8), 3) for _ in range(30)] + [text(4000)] * 2
    rng.shuffle(rows)
    texts = [" ".join(r) if i % 2 else "\n ".join(r).upper() for i, r in enumerate(rows)]
    out = [(1000 - i, t) for i, t in enumerate(texts)]
    return [*out, *out[:5], (5, None), (6, ""), (6, " \t"), (None, texts[0]), (None, "lone text")]


@pytest.mark.parametrize(
    "settings",
    [
        {},
        {"SHORT": 3, "FREQUENT": 2, "BLOCK": 500, "BROADCAST_ROWS": 0},
        {"SHORT": 10**6, "FREQUENT": 10**6},
    ],
)
def test_components_against_brute_force(spark, corpus, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(join, name, value)
    docs = spark.createDataFrame([(*r, 0) for r in corpus], "doc_id long, text string, component_id int")
    found = join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found), key=str) == brute(corpus)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert join.near_duplicates(docs).count() == 0
    assert join.one_per_group(docs).count() == 0


def test_one_row_of_each_group_stays(spark, corpus):
    docs = spark.createDataFrame([(*r, "s") for r in corpus], "doc_id long, text string, component string")
    left = join.one_per_group(docs)
    assert left.columns == docs.columns
    groups = {r[2] for r in brute(corpus) if r[1] and r[2] is not None}
    kept = [r["doc_id"] for r in left.collect() if shingles(r["text"])]
    assert sorted(x for x in kept if x is not None) == sorted(groups)
    assert kept.count(None) == 1  # "lone text" of a null id
    assert sum(not shingles(r["text"]) for r in left.collect()) == 3


def test_block_links_connect_what_all_links_would():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 60, 200).astype(np.uint64))
    sets = []
    for _ in range(70):
        change = rng.integers(0, len(base), rng.integers(0, 30))
        s = base.copy()
        s[change] = rng.integers(0, 1 << 60, len(change))
        sets.append(np.unique(s))
    names = np.arange(70) * 3
    label = {n: n for n in names.tolist()}

    def merge(pairs):
        out = dict(label)
        for a, b in pairs:
            old, new = max(out[a], out[b]), min(out[a], out[b])
            out = {k: new if v == old else v for k, v in out.items()}
        return out

    every = [
        (int(names[i]), int(names[j]))
        for i in range(70)
        for j in range(i)
        if join.similar(sets[i], sets[j], 80)
    ]
    links = join._spanning_links(names, sets, 80)
    assert merge(links) == merge(every) and len(links) < 70


def test_long_list_of_short_texts_is_multiplied_in_small_groups(spark, monkeypatch):
    n, same = 2500, " ".join(f"line{i}" for i in range(12))
    rows = [(i, f"{same} x{i} y{i}") for i in range(n)]
    rows += [(n + i, f"{same} {'tail ' * 6}x{i} z{i}") for i in range(2)]  # 12 of 16 shingles shared
    rows += [(n + 2 + i, f"{same} {'end ' * 30}{i}") for i in range(2)]  # linked
    sizes, block_links = [], join.block_links

    def counted(members, percent):
        sizes.extend(r["count"] for r in members.groupBy("key", "block").count().collect())
        return block_links(members, percent)

    monkeypatch.setattr(join, "block_links", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in join.near_duplicates(docs).collect()}
    assert sum(sizes) >= n and max(sizes) <= 1500
    assert found.pop(n + 3) == n + 2
    assert all(i == c for i, c in found.items())


def test_components_of_chains_and_repeats(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(50, 45), (45, 50), (60, 60)]
    found = components(spark.createDataFrame(links, "a long, b long"))
    expected = {i: 1 for i in range(1, 41)} | {45: 45, 50: 45, 60: 60}
    assert dict(map(tuple, found.collect())) == expected


def test_hashes_tell_short_sequences_apart():
    shingler = Shingler(5)
    sets = [tuple(shingler.set_of(t)) for t in ("a", "a a", "a a a", "a a a a a a", "b", "")]
    assert len(set(sets)) == 6 and [len(s) for s in sets] == [1, 1, 1, 1, 1, 0]
