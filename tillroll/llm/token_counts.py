"""Exact token counts of every prefix of a text.

A text's ledger has one signed byte per character: how the token count of the
prefix changes with it. Sums over the ledger answer how many tokens a prefix
has and which prefixes fit a budget, without encoding anything again.

Null texts count as empty: no tokens, an empty ledger. Texts are never cut,
repeated rows are counted each, and other columns pass through; a column of the
name an operator adds is replaced.
"""

import re
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.prefix_bpe import CACHE_ENTRIES, from_sentencepiece

#: No piece spans the end of a word before a space, or a line end.
_WORD = re.compile(r"▁*[^▁\n]+|\n|▁+")


class _Ledgers:
    """Ledgers of texts, put together from those of their words, which are kept."""

    def __init__(self, model_file):
        self.encoder, self.weight = from_sentencepiece(model_file)
        self.known = {}

    def learn(self, words):
        if len(self.known) + len(words) > CACHE_ENTRIES:
            self.known.clear()
        counts, changes = [0], bytearray()
        for word, last, same in self.encoder.steps(words):
            del counts[same + 1 :], changes[same:]
            for end in range(same + 1, len(word) + 1):
                token = last[end]
                count = counts[end - len(token)] + self.weight(token)
                changes.append((count - counts[-1]) & 255)
                counts.append(count)
            self.known[word] = bytes(changes)

    def of(self, texts):
        """Each text's ledger; its first byte belongs to the space set before it."""
        words = [_WORD.findall("▁" + t.replace(" ", "▁")) if t else [] for t in texts]
        new = set().union(*words) - self.known.keys()
        if new:
            self.learn(new if len(self.known) + len(new) <= CACHE_ENTRIES else set().union(*words))
        return [b"".join(map(self.known.__getitem__, w)) for w in words]


@cache
def _ledgers(model_file):
    return _Ledgers(model_file)


def text_ledgers(texts, model_file, chars=2_000_000):
    """Ledgers of texts, some millions of characters at a time."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= chars:
            yield from _ledgers(model_file).of(part)
            part, size = [], 0
    yield from _ledgers(model_file).of(part)


def counts_of(ledger):
    """Token counts of all prefixes, the empty one first."""
    if not ledger:
        return np.zeros(1, np.int64)
    counts = np.cumsum(np.frombuffer(ledger, np.int8), dtype=np.int64)
    counts[0] = 0
    return counts


def longest_fit(counts, budget):
    """Length in characters of the longest prefix of at most ``budget`` tokens."""
    if counts[-1] <= budget:
        return len(counts) - 1
    return int(np.flatnonzero(counts <= budget)[-1])


def with_ledger(docs, model_file, text="text", into="ledger"):
    """``docs`` with the ledger of each text, a binary column."""

    @F.pandas_udf("binary")
    def ledgers(texts: pd.Series) -> pd.Series:
        return pd.Series(list(text_ledgers(texts, model_file)))

    return docs.withColumn(into, ledgers(F.col(f"`{text}`").cast("string")))


@F.pandas_udf(T.LongType())
def tokens_in_prefix(ledger: pd.Series, chars: pd.Series) -> pd.Series:
    """Tokens of the first ``chars`` characters (all, if the text has fewer)."""
    pairs = zip(ledger, chars)
    return pd.Series([int(c[min(int(n), len(c) - 1)]) for c, n in ((counts_of(x), n) for x, n in pairs)])


@F.pandas_udf(T.LongType())
def chars_in_budget(ledger: pd.Series, budget: pd.Series) -> pd.Series:
    """Characters of the longest prefix of at most ``budget`` tokens."""
    return pd.Series([longest_fit(counts_of(x), int(n)) for x, n in zip(ledger, budget)])


def token_counts(docs, model_file, limit, text="text", into="counted"):
    """``docs`` with a struct: n_bytes, n_tokens, over_limit, fit_chars.

    ``fit_chars`` is the length of the longest prefix of at most ``limit``
    tokens. The ledger is summed where it is made and not kept.
    """

    @F.pandas_udf("n_tokens long, fit_chars long")
    def measured(texts: pd.Series) -> pd.DataFrame:
        counts = map(counts_of, text_ledgers(texts, model_file))
        rows = [(int(c[-1]), longest_fit(c, limit)) for c in counts]
        return pd.DataFrame(rows, columns=["n_tokens", "fit_chars"])

    content = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    count = measured(content)
    return docs.withColumn(into, count).withColumn(
        into,
        F.struct(
            F.octet_length(content).cast("long").alias("n_bytes"),
            F.col(f"{into}.n_tokens"),
            (F.col(f"{into}.n_tokens") > limit).alias("over_limit"),
            F.col(f"{into}.fit_chars"),
        ),
    )
