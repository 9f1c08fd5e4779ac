"""Phrases whose words belong together, mined per language from a parsed corpus.

Texts are parsed into chunks that end at words picked by their content (one of
``TRIGGER`` hashes) and reach ``longest - 1`` words over their end, but not
beyond the piece of text a phrase must stay in. Equal passages fall into equal
chunks wherever they stand, so the corpus becomes a dictionary of distinct chunks
with their frequencies. A phrase belongs to the chunk in whose own part its first
word stands, so what chunks overlap in is counted once. All counting happens
inside distinct chunks, weighted by frequency.

What is frequent begins and ends with what is frequent and one word shorter. Words,
then pairs of words are counted by their hashes; the frequent ones are marked in a
bitmap of bounded size, which leaves of the dictionary only runs of words whose
neighbours are all frequent pairs. These runs form a smaller dictionary, in which
longer phrases are marked in the same way. What is marked is then counted by the
words themselves, so a hash that two phrases share, or too little room in a bitmap,
costs time only (inside a task phrases are told apart by their 64-bit hashes).

Words are separated by blanks and tabs, ASCII in lower case; pieces end at
``.,;:!?`` and line ends. Null texts are empty, a null language is ``und``.
Repeated rows count as often as they occur. Columns other than the two named play
no part.
"""

from zlib import crc32

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillroll.llm.common import batches_of, text_of
from tillroll.sources.scratch import written

#: One word in so many ends a chunk; a chunk's own part has at most ``LONGEST_CORE`` words.
TRIGGER, LONGEST_CORE = 40, 4096
#: Words a task counts at once.
COUNTED = 3 << 19
#: Chunks a Python worker gets at once.
CHUNK_ROWS = 5000
#: Bits of the bitmap per frequent phrase, and the most it has, as powers of two.
BITS_PER_PHRASE, MOST_BITS = 6, 27

_UPPER, _BREAKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b".,;:!?\n\v\f\r"
#: Pieces are told apart by a full stop, which no word holds.
_TABLE = bytes.maketrans(
    _UPPER + _BREAKS + b"\t", _UPPER.lower() + b"." * len(_BREAKS) + b" "
)
_BREAK = b"."
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def tokens_of(text):
    """Words and breaks between pieces; no two breaks in a row, none at the ends."""
    pieces = (text or "").encode().translate(_TABLE).split(_BREAK)
    tokens = []
    for words in map(bytes.split, pieces):
        if words:
            tokens += words
            tokens.append(_BREAK)
    return tokens[:-1]


def chunks_of(tokens, overlap):
    """(chunk, tokens of its own part, words in it) of a text, in order."""
    ends = np.fromiter(map(crc32, tokens), np.uint32, len(tokens)) % TRIGGER == 0
    start = 0
    for end in [*(np.flatnonzero(ends) + 1).tolist(), len(tokens)]:
        while start < end:
            core = min(end, start + LONGEST_CORE)
            tail = tokens[core : core + overlap]
            if _BREAK in tail:
                tail = tail[: tail.index(_BREAK)]
            own = tokens[start:core]
            if own[0] == _BREAK:
                own = own[1:]
            if own:
                yield b" ".join(own + tail).decode(), len(own), len(own) - own.count(_BREAK)
            start = core


def dictionary(docs, lang, text, longest):
    """lang, chunk, core, n_words and weight of every distinct chunk, stored."""

    def parsed(batches):
        for batch in batches:
            rows = []
            for language, content in zip(batch["lang"], batch["text"]):
                rows += [(language, *c) for c in chunks_of(tokens_of(content), longest - 1)]
                if len(rows) > 50_000:
                    yield pd.DataFrame(rows, columns=["lang", "chunk", "core", "n_words"])
                    rows = []
            yield pd.DataFrame(rows, columns=["lang", "chunk", "core", "n_words"])

    texts = docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"),
        text_of(text).alias("text"),
    )
    chunks = texts.mapInPandas(parsed, "lang string, chunk string, core int, n_words int")
    counted = chunks.groupBy("lang", "chunk", "core", "n_words").agg(F.count("*").alias("weight"))
    return written(counted, "chunks", compression="zstd")


def phrase_hashes(words, seeds, size):
    """Hashes of the runs of ``size`` words, given by their hashes; ``seeds`` tells languages."""
    n = max(0, len(words) - size + 1)
    mixed = seeds[:n].copy()
    for i in range(size):
        mixed = (mixed ^ words[i : i + n]) * _ODD
        mixed ^= mixed >> np.uint64(29)
    return mixed * _MIX


class Marks:
    """Bitmap of the phrases that are frequent."""

    def __init__(self, power, bits):
        self.shift, self.bits = np.uint64(64 - power), bits

    def holds(self, hashes):
        slot = hashes >> self.shift
        return (self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def marks_of(frequent):
    """Marks of stored ``hash`` values, built by Spark's bitmap aggregate."""
    n = max(1, frequent.count())
    power = min(MOST_BITS, max(15, (n << BITS_PER_PHRASE).bit_length()))
    # Spark's positions begin with 1: slot s is bit s % 32768 of bucket 1 + s // 32768
    slots = frequent.select((F.shiftrightunsigned("hash", 64 - power) + 1).alias("slot"))
    parts = slots.groupBy(F.bitmap_bucket_number("slot").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    bits = np.zeros((1 << power) // 8, np.uint8)
    for row in parts.collect():  # at most 2 ** (MOST_BITS - 15) parts of 4 KB
        bits[(row["part"] - 1) * 4096 : row["part"] * 4096] = np.frombuffer(row["bits"], np.uint8)
    return Marks(power, bits)


class Part:
    """The words of many chunks (lang, chunk, core, weight) one after the other."""

    def __init__(self, rows):
        split = [chunk.encode().split(b" ") for chunk in rows["chunk"]]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        self.tokens = [t for words in split for t in words]
        digests = map(xxhash.xxh64_intdigest, self.tokens)
        self.words = np.fromiter(digests, np.uint64, len(self.tokens))
        self.place = np.arange(len(self.tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.length = np.repeat(lengths, lengths)
        self.owned = self.place < np.repeat(rows["core"].to_numpy(np.int64), lengths)
        self.word = self.words != np.uint64(xxhash.xxh64_intdigest(_BREAK))
        of_lang, langs = pd.factorize(rows["lang"].to_numpy(object))
        # Not hashed as words are: word "en" of "de" would meet word "de" of "en".
        seeds = [xxhash.xxh64_intdigest(x.encode(), seed=1) for x in langs]
        self.seeds = np.repeat(np.array(seeds, np.uint64)[of_lang], lengths)
        self.langs, self.of_lang = langs, np.repeat(of_lang, lengths)
        self.weight = np.repeat(rows["weight"].to_numpy(np.int64), lengths)

    def hashes(self, size):
        return phrase_hashes(self.words, self.seeds, size)

    def starts(self, size):
        """Per place whether a phrase of this size begins there, and stays in its piece."""
        n = max(0, len(self.tokens) - size + 1)
        good = (self.place + size <= self.length)[:n]
        for i in range(size):
            good &= self.word[i : i + n]
        return good

    def counted(self, size, shorter=None, own=None):
        """(first places, hashes, counts) of the distinct phrases of a size.

        Only those that ``own`` marks, and whose first and last words ``shorter`` marks.
        """
        good = self.starts(size) & self.owned[: max(0, len(self.tokens) - size + 1)]
        if shorter is not None and len(good):
            marked = shorter.holds(self.hashes(size - 1))
            good &= marked[: len(good)] & marked[1 : len(good) + 1]
        at = np.flatnonzero(good)
        found = self.hashes(size)[at]
        if own is not None:
            kept = own.holds(found)
            at, found = at[kept], found[kept]
        order = np.argsort(found, kind="stable")
        found, at = found[order], at[order]
        new = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else order
        sums = np.add.reduceat(self.weight[at], new) if len(new) else self.weight[:0]
        return at[new], found[new], sums

    def phrases(self, at, ends):
        tokens = self.tokens
        texts = [b" ".join(tokens[i:j]).decode() for i, j in zip(at.tolist(), ends.tolist())]
        langs = self.langs[self.of_lang[at]] if len(at) else []
        return {"lang": pd.Series(langs, dtype=object), "phrase": pd.Series(texts, dtype=object)}


def _parts(batches):
    """Batches put together to some ``COUNTED`` words; longer chunks stay whole."""
    held, words = [], 0
    for batch in batches:
        held.append(batch)
        words += int(batch["core"].sum())
        if words >= COUNTED:
            yield Part(pd.concat(held))
            held, words = [], 0
    if held:
        yield Part(pd.concat(held))


_CHUNK = ("lang", "chunk", "core", "weight")


def marked_phrases(chunks, size, least, shorter=None):
    """Marks of the phrases found ``least`` times by their hashes."""

    def count(batches):
        for part in _parts(batches):
            _, found, sums = part.counted(size, shorter)
            yield pd.DataFrame({"hash": found.view(np.int64), "n": sums})

    found = chunks.select(*_CHUNK).mapInPandas(count, "hash long, n long")
    sums = found.groupBy("hash").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    with batches_of(chunks.sparkSession, CHUNK_ROWS):  # chunks are short
        return marks_of(written(sums.select("hash"), f"hashes-{size}"))


def runs_of(chunks, words, pairs):
    """phrase, core and n by lang, stored: marked words (core 0), and the longest runs in
    which all pairs of neighbours are marked, with the words that their chunk owns.
    """

    def cut(batches):
        for part in _parts(batches):
            at, _, sums = part.counted(1, own=words)
            yield pd.DataFrame(part.phrases(at, at + 1) | {"core": 0, "n": sums})
            linked = part.starts(2)
            if len(linked):
                linked &= pairs.holds(part.hashes(2))
            edges = np.diff(np.concatenate([[0], linked.astype(np.int8), [0]]))
            first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            own = np.concatenate([[0], np.cumsum(part.owned)])
            core = own[last + 1] - own[first]
            first, last, core = first[core > 0], last[core > 0], core[core > 0]
            yield pd.DataFrame(part.phrases(first, last + 1) | {"core": core, "n": part.weight[first]})

    found = chunks.select(*_CHUNK).mapInPandas(cut, "lang string, phrase string, core int, n long")
    sums = found.groupBy("lang", "phrase", "core").agg(F.sum("n").alias("n"))
    with batches_of(chunks.sparkSession, CHUNK_ROWS):
        return written(sums, "runs")


def counted(runs, marks, least):
    """lang, phrase, size and n of the marked phrases (size → marks) found ``least`` times, stored."""

    def count(batches):
        for part in _parts(batches):
            for size, own in marks.items():
                at, _, sums = part.counted(size, own=own)
                yield pd.DataFrame(part.phrases(at, at + size) | {"size": size, "n": sums})

    found = runs.mapInPandas(count, "lang string, phrase string, size int, n long")
    sums = found.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n"))
    with batches_of(runs.sparkSession, CHUNK_ROWS):
        return written(sums.filter(F.col("n") >= least), "phrases")


def frequent_phrases(chunks, least, longest):
    """lang, phrase, size and n of all phrases of 1 to ``longest`` words found ``least`` times."""
    words = marked_phrases(chunks, 1, least)
    marks = {2: marked_phrases(chunks, 2, least, words)}
    found = runs_of(chunks, words, marks[2])
    single = found.filter((F.col("core") == 0) & (F.col("n") >= least))
    runs = found.filter("core > 0").select(
        "lang", F.col("phrase").alias("chunk"), "core", F.col("n").alias("weight")
    )
    for size in range(3, longest + 1):
        marks[size] = marked_phrases(runs, size, least, marks[size - 1])
    return single.select("lang", "phrase", F.lit(1).alias("size"), "n").unionByName(
        counted(runs, marks, least)
    )


def uncontained(phrases, percent):
    """Candidates not inside a longer one that is ``percent`` as frequent or more.

    A phrase between the two is at least as frequent as the longer one, so it is
    enough to look at those one word longer.
    """
    words = F.split("phrase", " ")
    inner = F.array(
        F.array_join(F.slice(words, 1, F.col("size") - 1), " "),
        F.array_join(F.slice(words, 2, F.col("size") - 1), " "),
    )
    inside = phrases.filter("size > 2").select("lang", "n", F.explode(inner).alias("phrase"))
    around = inside.groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    candidates = phrases.filter("size > 1").join(around, ["lang", "phrase"], "left")
    # in decimals, as a hundred times a count may pass 64 bits
    drop = F.col("longer").cast("decimal(20,0)") * 100 >= F.col("n").cast("decimal(20,0)") * percent
    return candidates.filter(~F.coalesce(drop, F.lit(False))).drop("longer")


def with_scores(candidates, phrases, totals):
    """Candidates with the cut of the lowest score: a, l, r, n and score."""
    words = F.split("phrase", " ")
    cuts = candidates.select(
        "lang",
        "phrase",
        F.col("n").alias("a"),
        F.posexplode(
            F.transform(
                F.sequence(F.lit(1), F.col("size") - 1),
                lambda k: F.struct(
                    F.array_join(F.slice(words, F.lit(1), k), " ").alias("left"),
                    F.array_join(F.slice(words, k + 1, F.col("size") - k), " ").alias("right"),
                ),
            )
        ).alias("cut", "parts"),
    ).select("lang", "phrase", "a", "cut", "parts.*")
    for side, name in (("left", "l"), ("right", "r")):
        known = phrases.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
        cuts = cuts.join(known, ["lang", side])
    # 1000 * a * n stays below 38 digits for any corpus of less than 10 ** 17 words
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    # Without the new deal a language's phrases would stay together for the aggregate.
    cuts = cuts.join(totals, "lang").repartition("lang", "phrase")
    cuts = cuts.withColumns(
        {"above": wide["a"] * F.lit(1000).cast("decimal(4,0)") * wide["n"], "below": wide["l"] * wide["r"]}
    ).withColumn("score", F.expr("above div below"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("best"))
    return best.select("lang", "phrase", "best.a", "best.l", "best.r", "best.n", "best.score")


def collocations(docs, lang="lang", text="text", least=100, longest=5, percent=100, limit=2000):
    """Each language's first ``limit`` phrases: lang, rank, phrase, a, l, r, n, score."""
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    chunks = dictionary(docs, lang, text, longest)
    totals = chunks.groupBy("lang").agg(F.sum(F.col("n_words") * F.col("weight")).alias("n"))
    phrases = frequent_phrases(chunks, least, longest)
    scored = with_scores(uncontained(phrases, percent), phrases, totals)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.filter(F.col("rank") <= limit).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
