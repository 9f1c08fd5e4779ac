"""What rules and quality scores know about a text, measured in one pass.

Words are runs of anything but space, tab, line feed, vertical tab, form feed
and carriage return. A null text measures like an empty one.
"""

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACES = " \t\n\v\f\r"
_SYMBOLS = "#*$%&|<>"
_BEYOND = re.compile("[\x00-\x7f]+")

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_distinct_words",
    "n_letters",
    "n_upper",
    "n_digits",
    "n_stops",
    "n_loud",
    "n_long_words",
)

MEASURES_TYPE = T.StructType([T.StructField(name, T.LongType()) for name in MEASURES])


def repeated_words(ids):
    """Words in windows of three words that the text has twice or more."""
    if len(ids) < 4:
        return 0
    _, pairs = np.unique(ids[:-1] * (ids.max() + 1) + ids[1:], return_inverse=True)
    windows = pairs[:-1] * (ids.max() + 1) + ids[2:]
    _, place, found = np.unique(windows, return_inverse=True, return_counts=True)
    if found.max() < 2:
        return 0
    again, inside = found[place] > 1, np.zeros(len(ids), bool)
    for shift in range(3):
        inside[shift : shift + len(again)] |= again
    return int(inside.sum())


def repeated_lines(lines):
    """Lines with a word that equal an earlier line."""
    if len(set(lines)) == len(lines):
        return 0
    worded = [line for line in lines if line.strip(_SPACES)]
    return len(worded) - len(set(worded))


def measure(text):
    """The measures of one text, in the order of ``MEASURES``."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    known = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    lines = text.split("\n")
    codes = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(codes, minlength=256)
    upper = int(kinds[65:91].sum())
    letters = upper + int(kinds[97:123].sum())
    if len(raw) != len(text):  # each character beyond ASCII is looked at once
        for char, times in Counter(_BEYOND.sub("", text)).items():
            letters += times * char.isalpha()
            upper += times * char.isupper()
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, _SYMBOLS)),
        repeated_lines(lines),
        repeated_words(ids),
        len(lines),
        len(known),
        letters,
        upper,
        int(kinds[48:58].sum()),
        text.count(".") + text.count("?"),
        text.count("!"),
        sum(1 for w in known if len(w) > 30),
    )


@F.pandas_udf(MEASURES_TYPE)
def measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=list(MEASURES))
