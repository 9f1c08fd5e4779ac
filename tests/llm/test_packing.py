import json
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tillroll.llm import queries
from tillroll.llm import retrieval_packing as packing

WORDS = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(WORDS)
ODD = [
    "", " ", "It's don't we'll", "a\tb c　d", "é́ É ß İ ſ ﬁ", "x<|endoftext|>y", "<|startoftext|>",
    "don't. 's. <|x|>. o'. é. é́. ß?! a_b_ a-", "x.\n.y (z) [w]. \"v\".", "İ. Σας. ΑΣ.", "a.\tb.\x85c.",
    "日本語", "🙂!?", "foo###,,,", "12a34", "ÀÖØ×÷öÿ.", "word.word", "\x1c a\x85b", "'''s",
]


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def check_pieces(rows, texts, window):
    """Every id of every document lies in one piece, and sequences are full."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for (doc, n), pieces in docs.items():
        candidates = [np.array(t, "<u4") for t in map(ids_of, texts[doc]) if len(t) == n]
        pieces = sorted(pieces, key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces) == sum(map(len, candidates))
        for r in pieces:
            parts = [c[r["start"] : r["start"] + r["length"]] for c in candidates]
            assert r["ids_crc32"] in {zlib.crc32(p.tobytes()) for p in parts}
    assert sum(len(texts[d]) for d in texts) == sum(r["start"] == 0 for r in rows)
    for pieces in sequences.values():
        pieces = sorted(pieces, key=lambda r: r["offset"])
        ends = np.cumsum([r["length"] for r in pieces])
        assert [r["offset"] for r in pieces] == [0, *ends[:-1].tolist()]
        assert ends[-1] == window or (ends[-1] < window and ends[-1] & (ends[-1] - 1) == 0)


@pytest.mark.parametrize("text", ODD)
def test_ids_are_those_of_the_library(text):
    encoder = packing.TokenIds(WORDS)
    for part in (text, f"Before {text}\nAfter, {text}"):
        expected = LIBRARY.encode(part, add_special_tokens=False).ids
        assert encoder.of([part])[0].tolist() == expected


def test_plain_words_skip_steps_only_where_these_do_nothing(tmp_path):
    text = "Some WORDS, of ascii Letters\nAnd others: Éclair über naïve don't x1 <|endoftext|> end"
    assert packing.TokenIds(WORDS).lower is not None
    for step, kinds in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")):
        other = json.loads(Path(WORDS).read_text())
        other[step][kinds] = other[step][kinds][:2] if step == "normalizer" else other[step][kinds][::-1]
        path = tmp_path / f"{step}.json"
        path.write_text(json.dumps(other))
        assert packing.TokenIds(str(path)).lower is None
    for path in (WORDS, str(tmp_path / "normalizer.json")):
        expected = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
        assert packing.TokenIds(path).of([text, None])[0].tolist() == expected


def test_texts_are_looked_up_by_their_different_parts():
    texts = ["Éclair über plain plain", None, "plain.\nÉclair <|x|>", "", "plain!"]
    parts, places, ends = packing.TokenIds(WORDS).parts(texts)
    assert len(parts) == len(set(parts)) == 7
    rows = [[parts[i] for i in row] for row in np.split(places, ends[:-1])]
    assert rows == [
        ["Éclair", "über", "plain", "plain"], [""], ["plain.", "Éclair", "<|x|>"], [""], ["plain", "!"],
    ]


def test_words_of_accented_letters_skip_the_steps_too(monkeypatch):
    text = "".join(chr(c) for c in range(0xC0, 0x100) if chr(c).isalpha()) + " Éclair ß plain ÀÖ"
    encoder = packing.TokenIds(WORDS)
    monkeypatch.setattr(encoder, "encoded", None)
    assert encoder.of([text])[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("entries, ids", [(6, 1 << 23), (600_000, 20)])
def test_known_parts_are_bounded_and_learned_again(monkeypatch, entries, ids):
    monkeypatch.setattr(packing, "CACHE_ENTRIES", entries)
    monkeypatch.setattr(packing, "CACHE_IDS", ids)
    encoder, long = packing.TokenIds(WORDS), "y" * 300
    for i in range(12):
        texts = [f"again word{i} é{i} {long}", "again other", None]
        for found, text in zip(encoder.of(texts), texts, strict=True):
            assert found.tolist() == LIBRARY.encode(text or "", add_special_tokens=False).ids
        assert long not in encoder.known and len(encoder.known) <= max(6, entries // 10_000)
        assert len(encoder.pool) <= ids + sum(map(len, encoder.of(texts)))


def test_round_trip_of_the_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    texts = {r["doc_id"]: [r["text"]] for r in docs}
    check_pieces(queries.op6_retrieval_packing(spark, sf).collect(), texts, 2048)


@pytest.mark.parametrize("block", [2, 3000])
def test_small_windows_nulls_and_repeats(spark, block):
    rows = [(i, "word " * (i * 7 % 23), i) for i in range(60)]
    rows += [(5, "again and again", 0)] * 3 + [(None, None, 0), (None, "x", 1), (2**53 + 1, "big", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    texts = {}
    for doc, text, _ in rows:
        texts.setdefault(doc, []).append(text)
    pieces = packing.pack(docs, WORDS, window=16, block_docs=block).collect()
    check_pieces(pieces, texts, 16)
    assert packing.pack(docs.limit(0), WORDS).count() == 0


def test_neighbours_share_telling_terms():
    docs = []
    for i, terms in enumerate([[1, 2, 3], [1, 7, 8], [1, 2, 9], [1, 5, 6]]):
        doc = packing._Doc()
        doc.doc_id, doc.doc_tokens, doc.start = i, 3, 0
        doc.terms, doc.counts = np.array(terms), np.ones(3)
        doc.rest = np.zeros(3, np.uint16)
        docs.append(doc)
    idf = np.array([0, 0.1, 2, 2, 2, 2, 2, 2, 2, 2.0])
    index, used = packing._Index(docs, idf, 3.0), np.zeros(4, bool)
    used[0] = True
    assert list(index.neighbours(0, used))[0] == 2
    assert set(index.neighbours(0, used)) == {1, 2, 3}
