from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from tillroll.llm import license_scan as scan
from tillroll.llm import queries


def brute(text, pairs, percent):
    """All passages against all templates."""
    found = scan.bigrams(scan.words(text))
    best = {}
    for name, template in pairs:
        wanted = Counter(scan.bigrams(scan.words(template)))
        size = sum(wanted.values())
        for i in range(len(found)):
            for j in range(i + 1, len(found) + 1):
                shared = sum((Counter(found[i:j]) & wanted).values())
                if shared and 200 * shared >= percent * (j - i + size):
                    key = (-2 * shared / (j - i + size), i, j - i)
                    best[name] = min(best.get(name, key), key)
    return [(n, -k[0], k[1], k[1] + k[2] + 1) for n, k in sorted(best.items())]


PAIRS = [("x", "a b c a b"), ("y", "b c"), ("x", "c c c d e f a"), ("z", "d")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcdef"), max_size=25), st.sampled_from([50, 80, 100]))
def test_against_all_passages(letters, percent):
    text = " ".join(letters)
    assert scan.LicenseScanner(PAIRS, percent).passages(text) == brute(text, PAIRS, percent)


def test_every_template_is_found_in_a_text(spark):
    rows = [(i, f"Some words before.\n{t}\nAnd after", n) for i, (n, t) in enumerate(scan.templates())]
    rows += [(-1, None, None), (-2, "", None), (-3, "a licensed plumber", None), (-4, "x " * 50_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licenses string")
    expected = {i: n for i, _, n in rows}
    for row in scan.with_licenses(docs, into="found").collect():
        names = {f["license"]: f["dice"] for f in row["found"]}
        if row["doc_id"] < 0:
            assert not names
        else:
            assert names[expected[row["doc_id"]]] == 1.0
    assert scan.with_licenses(docs.limit(0)).count() == 0


def test_reworded_texts_are_found():
    scanner = scan.LicenseScanner(scan.templates(), 80)
    mit = dict(scan.TEXTS)["MIT"][0].replace("Software", "Program", 1).replace("merge,", "")
    assert [p[0] for p in scanner.passages("Copyright 2020 someone\n\n" + mit.upper())] == ["MIT"]
    assert scanner.passages("permission is a word, hereby another") == []


def test_query_finds_the_notices(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    notices = {
        "Released under the MIT License.": "MIT",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "All rights reserved.": "All-Rights-Reserved",
    }
    found = {(r["doc_id"], r["license"]) for r in queries.op5_license_scan(spark, sf).collect()}
    for doc, text in texts.items():
        for line, name in notices.items():
            assert (line in (text or "").split("\n")) <= ((doc, name) in found)
