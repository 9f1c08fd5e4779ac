import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tillroll.llm import simhash
from tillroll.sources.scratch import written


def brute_print(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    k = min(3, len(words))
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance):
    label = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= distance:
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    return label


def expected(rows, distance=2):
    prints = [brute_print(t) for _, t in rows]
    ids = {}
    for (doc, _), x in zip(rows, brute_components(prints, distance)):
        if doc is not None:
            ids[x] = min(doc, ids.get(x, doc))
    label = brute_components(prints, distance)
    return sorted(((d, f"{p:016x}", ids.get(x)) for (d, _), p, x in zip(rows, prints, label)), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)

    def text(n):
        return [f"w{rng.randrange(300)}" for _ in range(n)]

    rows = [text(rng.randrange(1, 60)) for _ in range(60)]
    for base in (text(400), text(900), text(40)):
        for _ in range(40):
            copy = list(base)
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(300)}"
            rows.append(copy)
    rows.append(text(30_000))
    rng.shuffle(rows)
    texts = [" ".join(r) if i % 2 else "\n ".join(r).upper() for i, r in enumerate(rows)]
    out = [(1000 - i, t) for i, t in enumerate(texts)]
    odd = [(5, None), (6, ""), (7, " \t"), (None, texts[0]), (None, "lone text"), (8, "é   ñ\x1cb É")]
    return out + out[:5] + odd


@pytest.mark.parametrize("crowd", [32, 1])
def test_components_against_brute_force(spark, corpus, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    docs = spark.createDataFrame([(*r, 0) for r in corpus], "doc_id long, text string, component_id int")
    found = simhash.near_duplicates(docs).select(
        "doc_id", simhash.hex_digits("fingerprint"), "component_id"
    )
    assert sorted(map(tuple, found.collect()), key=str) == expected(corpus)


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
@pytest.mark.parametrize("crowd", [32, 1])
def test_links_connect_all_close_fingerprints(spark, monkeypatch, distance, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(distance)
    prints = set()
    for _ in range(6):
        base = rng.getrandbits(64)
        prints |= {base, base ^ (1 << 63)}
        for _ in range(60):
            other = rng.choice(sorted(prints))
            for _ in range(rng.randrange(1, 5)):
                other ^= 1 << rng.randrange(64)
            prints.add(other)
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    table = written(spark.createDataFrame(signed, "print long"), "prints")
    links = simhash.close_links(table, distance).collect()
    index = {p: i for i, (p,) in enumerate(signed)}
    label = list(range(len(prints)))
    for a, b in links:
        assert ((a ^ b) & ((1 << 64) - 1)).bit_count() <= distance
        old, new = label[index[a]], label[index[b]]
        label = [new if x == old else x for x in label]
    wanted = brute_components(prints, distance)
    assert len(set(zip(label, wanted))) == len(set(wanted)) == len(set(label))


def test_crowded_block_is_linked_without_all_pairs(spark):
    """All 2^12 values of some bits: 8 million pairs, linked by stars."""
    table = written(spark.range(4096).select((F.col("id") * 8 + 1).alias("print")), "prints")
    links = simhash.close_links(table)
    assert links.count() < 4096 * 120
    nodes = simhash.components(links)
    assert nodes.count() == 4096 and nodes.select("label").distinct().count() == 1


def test_agrees_with_the_hash_of_spark(spark):
    texts = ["", "a", "some longer text of words", "é" * 40]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()
    for text, (there,) in zip(texts, rows):
        assert there & ((1 << 64) - 1) == xxhash.xxh64_intdigest(text.encode(), 42)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, print int, label string")
    assert simhash.near_duplicates(docs).count() == 0
    docs = spark.createDataFrame(
        [("b", "one text", 1, "x"), ("a", "one  TEXT", 2, "y")],
        "doc_id string, text string, print int, label string",
    )
    assert [r["component_id"] for r in simhash.near_duplicates(docs).collect()] == ["a", "a"]
