"""Packing documents into training sequences with their lexical neighbours.

Documents become token ids, each followed by a separator. A document's full
windows are sequences of their own. What remains of it is shorter than a window
and is packed: the remainders lie in shards, each with an inverted index of its
documents; a seed asks the index for unused neighbours by BM25, which fill its
window in that order. The last one is cut where the window ends and its rest is
the next seed. What a task has left at its end is cut into powers of two. So no
sequence needs padding.

The index covers whole documents and its statistics (document frequencies, mean
length, number of documents) all of them. Documents lie in the order of one
of their terms each, drawn by a weighted hash: the more telling a term, the
likelier it is drawn, and documents that share it draw alike. So copies and
documents of a kind meet, and words that all texts have do not decide; a large
group is spread over several shards.

A null text counts as empty: one token, the separator. Repeated rows are packed
each. An empty table gives an empty result.
"""

import json
import re
import zlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.sources.scratch import written

TOKENS_TYPE = pa.schema(
    [
        ("key", pa.int64()),
        ("doc_id", pa.string()),
        ("doc_tokens", pa.int64()),
        ("window_crcs", pa.list_(pa.int64())),
        ("rest", pa.binary()),
        ("terms", pa.binary()),
        ("counts", pa.binary()),
    ]
)
TOKENS_COLUMNS = (
    "key long, doc_id string, doc_tokens long, window_crcs array<long>, "
    "rest binary, terms binary, counts binary"
)

PIECE_TYPE = T.StructType(
    [T.StructField("doc_id", T.StringType())]
    + [
        T.StructField(name, T.LongType())
        for name in (
            "start",
            "length",
            "ids_crc32",
            "doc_tokens",
            "sequence_id",
            "offset",
        )
    ]
)

#: Parts of texts that a worker knows, about 200 bytes each, of how many letters at
#: most, and ids it keeps.
CACHE_ENTRIES = 600_000
CACHE_LETTERS = 100
CACHE_IDS = 1 << 23

#: Words of letters whose lower case needs no context, and the marks that end a part after one.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"[{_LETTERS}]+")
_MARKS = rf"([{_LETTERS}])([!-&(-/:-@\[-`{{-~]+)([ \n]|$)"

#: What a tokenizer does to a text before it looks at words, if of words of these
#: letters between spaces only the lower case and the spelling in bytes are left to make.
_LOWERS = (
    [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    [
        {
            "type": "Split",
            "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
)
_STEPS = (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))


class TokenIds:
    """Ids of texts from a word-end vocabulary; known words are looked up.

    White space never reaches the ids of such a vocabulary, so a text's ids are
    those of its parts between spaces and line ends. Marks at the end of a part are
    a part of their own where letters precede them, as no token holds both; texts
    that may name a special token are left as they are.
    """

    def __init__(self, json_file):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(json_file)
        with open(json_file, encoding="utf-8") as stored:
            steps = json.load(stored)
        self.lower = None
        if _LOWERS == tuple((steps[name] or {}).get(kind) for name, kind in _STEPS):
            self.lower = Tokenizer(self.tokenizer.model)
            self.lower.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.spelling = np.arange(256, dtype="<u2")  # the letter each byte becomes
            for letter in filter(_PLAIN.fullmatch, map(chr, range(0x80, 0x100))):
                self.spelling[list(letter.encode())] = [*map(ord, spelled.pre_tokenize_str(letter)[0][0])]
        vocabulary = self.tokenizer.get_vocab()
        suffix = self.tokenizer.model.end_of_word_suffix
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.dtype = np.uint16 if len(self.ends) <= 1 << 16 else np.uint32
        self.forget()

    def forget(self):
        #: The number of each known part; all ids in their order, and where each part's end.
        self.known, self.pool, self.ends_at = {}, np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def encoded(self, text):
        one = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(one.ids, self.dtype)

    def encoded_words(self, words):
        """Ids of plain words, without the steps that do nothing to them."""
        text = " ".join(words)
        if self.lower is None:
            return self.encoded(text)
        text = text.lower()
        if not text.isascii():
            letters = self.spelling[np.frombuffer(text.encode(), np.uint8)]
            text = letters.tobytes().decode("utf-16-le")
        one = self.lower.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(one.ids, self.dtype)

    def learn(self, parts):
        """Keep the ids of parts of texts; plain words are encoded many at once, as each
        ends with an id that ends words."""
        plain, others = [], []
        for part in parts:
            kind = plain if (part.isascii() and part.isalpha()) or _PLAIN.fullmatch(part) else others
            kind.append(part)
        pieces, sizes = [], []
        for some in (plain[at : at + 1000] for at in range(0, len(plain), 1000)):
            ids = self.encoded_words(some)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("a word has more than one end")
            pieces.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        for part in others:
            pieces.append(self.encoded(part))
            sizes.append([len(pieces[-1])])
        self.known.update(zip(plain + others, range(len(self.ends_at) - 1, len(self.ends_at) + len(parts))))
        self.pool = np.concatenate([self.pool, *pieces])
        ends = self.ends_at[-1] + np.cumsum(np.concatenate([[], *sizes]).astype(np.int64))
        self.ends_at = np.concatenate([self.ends_at, ends])

    def parts(self, texts):
        """(parts, places, ends): the different parts of all texts, of each part in turn
        its place among these, and where each text's parts end."""
        texts = pc.fill_null(pa.array(texts, pa.large_string()), "")
        marked = pc.replace_substring_regex(texts, _MARKS, r"\1 \2\3")
        marked = pc.if_else(pc.match_substring(texts, "<|"), texts, marked)
        lists = pc.split_pattern(pc.replace_substring(marked, "\n", " "), " ")
        each = lists.flatten().dictionary_encode()
        parts = each.dictionary.to_numpy(zero_copy_only=False).tolist()
        return parts, each.indices.to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy())

    def numbers(self, parts):
        """The numbers of different parts of texts."""
        found = np.fromiter(map(self.known.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(found < 0)
        if len(self.ends_at) + len(new) > CACHE_ENTRIES or len(self.pool) > CACHE_IDS:
            self.forget()
            new = np.arange(len(parts))
        if len(new):
            words = [parts[i] for i in new.tolist()]
            self.learn(words)
            found[new] = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            for long in [word for word in words if len(word) > CACHE_LETTERS]:
                del self.known[long]
        return found

    def of(self, texts):
        """The ids of each text, as arrays."""
        if not len(texts):
            return []
        parts, places, ends = self.parts(texts)
        part = self.numbers(parts)[places]
        starts = self.ends_at[part]
        lengths = self.ends_at[part + 1] - starts
        till = np.r_[0, np.cumsum(lengths)]
        ids = self.pool[np.arange(till[-1]) + np.repeat(starts - till[:-1], lengths)]
        return np.split(ids, till[ends[:-1]])


@lru_cache(maxsize=1)
def token_ids(json_file):
    """One per Python worker, which keeps what it learned from task to task."""
    return TokenIds(json_file)


def crc32(ids):
    return zlib.crc32(ids.astype("<u4").tobytes())


def draw_order(frequency, idf):
    """A number per term: a document's kind is its term with the least.

    Exponential draws from a hash of the term, at a rate that grows with how much
    the term tells; terms of a single document bring nobody together and come last.
    """
    x = np.arange(len(idf), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    even = ((x >> np.uint64(33)).astype(np.float64) + 0.5) / (1 << 31)
    rate = np.where(frequency > 1, np.maximum(idf, 1e-9) ** 3, 1e-12)
    return -np.log(even) / rate


def tokenized(docs, json_file, doc_id, text, window, separator):
    """One row per document: its full windows' checksums, its rest, and how often it
    has which terms."""

    def rows_of(batches):
        encoder = token_ids(json_file)
        for batch in batches:
            rows = []
            for ids in encoder.of(batch.column("text").cast(pa.large_string())):
                ids = np.append(ids, encoder.dtype(separator))
                full = len(ids) // window
                crcs = [crc32(ids[i * window : (i + 1) * window]) for i in range(full)]
                terms, counts = np.unique(ids, return_counts=True)
                rows.append(
                    (
                        len(ids),
                        crcs,
                        ids[full * window :].tobytes(),
                        terms.tobytes(),
                        counts.astype("<u4").tobytes(),
                    )
                )
            made = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(TOKENS_TYPE)[2:])]
            if rows:
                kept = [batch.column(c) for c in ("key", "doc_id")]
                yield pa.RecordBatch.from_arrays([*kept, *made], schema=TOKENS_TYPE)

    rows = docs.select(
        F.monotonically_increasing_id().alias("key"),
        F.col(f"`{doc_id}`").cast("string").alias("doc_id"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )
    return rows.mapInArrow(rows_of, TOKENS_COLUMNS)


def corpus_statistics(tokens, dtype):
    """Documents per term, documents and mean length, over all documents.

    The vocabulary bounds what is collected.
    """

    def partial(batches):
        docs = np.zeros(np.iinfo(dtype).max + 1 if dtype == np.uint16 else 1 << 20, np.int64)
        for batch in batches:
            for terms in batch["terms"]:
                docs[np.frombuffer(terms, dtype)] += 1
        found = np.flatnonzero(docs)
        yield pd.DataFrame({"term": found, "docs": docs[found]})

    sums = tokens.select("terms").mapInPandas(partial, "term long, docs long")
    frequency = sums.groupBy("term").agg(F.sum("docs").alias("docs")).collect()
    total = tokens.agg(
        F.count("*").alias("n"), F.avg("doc_tokens").alias("mean"), F.sum(F.octet_length("rest")).alias("bytes")
    ).first()
    docs = np.zeros(max([r["term"] for r in frequency], default=0) + 1)
    for row in frequency:
        docs[row["term"]] = row["docs"]
    return docs, total["n"], total["mean"] or 1.0, total["bytes"] or 0


class _Index:
    """BM25 over the documents of one block of a shard."""

    def __init__(self, docs, idf, mean, k1=1.2, b=0.75, query_terms=24):
        self.n, self.idf, self.query_terms = len(docs), idf, query_terms
        sizes = np.array([len(d.terms) for d in docs], np.int64)
        self.starts = np.r_[0, np.cumsum(sizes)]
        self.terms = np.concatenate([d.terms for d in docs]).astype(np.int64)
        counts = np.concatenate([d.counts for d in docs]).astype(np.float64)
        owner = np.repeat(np.arange(self.n), sizes)
        length = np.array([d.doc_tokens for d in docs], np.float64)[owner] / mean
        weight = idf[self.terms] * counts * (k1 + 1) / (counts + k1 * (1 - b + b * length))
        order = np.argsort(self.terms, kind="stable")
        found, first = np.unique(self.terms[order], return_index=True)
        self.owner, self.weight = owner[order], weight[order]
        self.posting = dict(zip(found.tolist(), zip(first.tolist(), [*first[1:].tolist(), len(order)])))

    def neighbours(self, seed, used):
        """Unused documents by their score for the seed's most telling terms."""
        terms = self.terms[self.starts[seed] : self.starts[seed + 1]]
        if len(terms) > self.query_terms:
            terms = terms[np.argpartition(-self.idf[terms], self.query_terms)[: self.query_terms]]
        spans = [slice(*self.posting[t]) for t in terms.tolist()]
        scores = np.bincount(
            np.concatenate([self.owner[s] for s in spans]),
            np.concatenate([self.weight[s] for s in spans]),
            self.n,
        )
        scores[used] = 0  # whatever is used later the caller passes over
        found = np.flatnonzero(scores > 0)
        if len(found) > 64:  # the first few mostly fill a window
            best = scores[found] >= np.partition(scores[found], -32)[-32]
            yield from _by_score(found[best], scores)
            found = found[~best]
        yield from _by_score(found, scores)


def _by_score(found, scores):
    return found[np.argsort(-scores[found], kind="stable")].tolist()


class _Doc:
    __slots__ = ("counts", "doc_id", "doc_tokens", "rest", "start", "terms")


class _Packer:
    """Sequences of one task; ``pieces`` are finished rows."""

    def __init__(self, window, first_sequence):
        self.window, self.next, self.pieces = window, first_sequence, []
        self.open, self.filled = [], 0

    def piece(self, doc, start, ids, offset):
        row = (doc.doc_id, start, len(ids), crc32(ids), doc.doc_tokens, self.next, offset)
        self.pieces.append(row)

    def full_windows(self, doc_id, doc_tokens, crcs):
        for i, crc in enumerate(crcs):
            row = (doc_id, i * self.window, self.window, crc, doc_tokens, self.next, 0)
            self.pieces.append(row)
            self.next += 1

    def add(self, doc, ids, start):
        """Put ids into the open sequence; what does not fit starts the next one."""
        while len(ids):
            part = ids[: self.window - self.filled]
            self.open.append((doc, start, part))
            self.filled += len(part)
            ids, start = ids[len(part) :], start + len(part)
            if self.filled == self.window:
                self.close(self.window)

    def close(self, size):
        """Finish a sequence of the first ``size`` ids that are open."""
        offset, left = 0, []
        for doc, start, ids in self.open:
            part = ids[: max(0, size - offset)]
            if len(part):
                self.piece(doc, start, part, offset)
                offset += len(part)
            if len(part) < len(ids):
                left.append((doc, start + len(part), ids[len(part) :]))
        self.open, self.filled, self.next = left, self.filled - size, self.next + 1

    def finish(self):
        while self.filled:
            self.close(1 << (self.filled.bit_length() - 1))

    def taken(self):
        pieces, self.pieces = self.pieces, []
        return pd.DataFrame(pieces, columns=PIECE_TYPE.names)


def _pack_block(packer, docs, idf, mean):
    if not docs:
        return
    index, used = _Index(docs, idf, mean), np.zeros(len(docs), bool)
    seed, neighbours, upcoming, sequence = None, iter(()), 0, packer.next

    def take(i):
        used[i] = True
        packer.add(docs[i], docs[i].rest, docs[i].start)

    while True:
        if packer.next != sequence:  # a new window; the rest of the last document seeds it
            sequence = packer.next
            neighbours = index.neighbours(seed, used) if packer.filled else iter(())
        chosen = next((i for i in neighbours if not used[i]), None)
        if chosen is None:
            while upcoming < len(docs) and used[upcoming]:
                upcoming += 1
            if upcoming == len(docs):
                return
            chosen = upcoming
            take(chosen)
            if packer.next == sequence:
                neighbours = index.neighbours(chosen, used)
        else:
            take(chosen)
        seed = chosen


def pack(
    docs,
    json_file,
    doc_id="doc_id",
    text="text",
    window=2048,
    separator=1,
    block_docs=3000,
    shard_bytes=16 << 20,
):
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A task packs its shard in blocks of ``block_docs`` documents, so its memory
    does not depend on the shard's size. Tokens are stored once in the scratch
    folder; rests and terms then pass one shuffle.
    """
    tokens = written(tokenized(docs, json_file, doc_id, text, window, separator), "tokens")
    dtype = TokenIds(json_file).dtype
    frequency, n_docs, mean, n_bytes = corpus_statistics(tokens, dtype)
    idf = np.log1p((n_docs - frequency + 0.5) / (frequency + 0.5))
    order = draw_order(frequency, idf)

    @F.pandas_udf(T.LongType())
    def kind(terms: pd.Series) -> pd.Series:
        each = (np.frombuffer(t, dtype) for t in terms)
        return pd.Series([int(t[np.argmin(order[t])]) for t in each], dtype=np.int64)

    def packed(batches):
        packer = _Packer(window, TaskContext.get().partitionId() << 36)
        block = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                packer.full_windows(row.doc_id, row.doc_tokens, row.window_crcs)
                doc = _Doc()
                doc.doc_id, doc.doc_tokens = row.doc_id, row.doc_tokens
                doc.start = len(row.window_crcs) * window
                doc.rest = np.frombuffer(row.rest, dtype)
                doc.terms = np.frombuffer(row.terms, dtype)
                doc.counts = np.frombuffer(row.counts, "<u4")
                if len(doc.rest):
                    block.append(doc)
                if len(block) == block_docs:
                    _pack_block(packer, block, idf, mean)
                    block = []
            yield packer.taken()
        _pack_block(packer, block, idf, mean)
        packer.finish()
        yield packer.taken()

    shards = max(1, -(-n_bytes // shard_bytes))
    return (
        tokens.withColumn("kind", kind("terms"))
        .repartitionByRange(int(shards), "kind", "key")
        .sortWithinPartitions("kind", "key")
        .mapInPandas(packed, PIECE_TYPE)
        .withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))
    )
