"""Licence texts and notices in documents, by Dice similarity of word bigrams.

Texts are normalised to lower-case words of letters, digits and dots inside
numbers. A passage of a document is compared with a template by
2 * shared / (bigrams of the passage + bigrams of the template), with bigrams
counted as often as they occur. Bounds come first: a passage of n bigrams can
only reach the threshold with templates of between n * t / (2 - t) and
n * (2 - t) / t bigrams, and must share at least t / (2 - t) of a template's
bigrams within the longest passage allowed.

Every passage of a document is a candidate, whole texts included. Per document
and licence the best passage is reported, the earliest and then shortest on
ties. Null and empty texts have none; repeated rows are scanned each.
"""

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")

#: Names by which notices call a licence.
NAMES = {
    "MIT": ["MIT License"],
    "Apache-2.0": ["Apache License, Version 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2"],
    "GPL-3.0": ["GNU General Public License, version 3"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3"],
    "MPL-2.0": ["Mozilla Public License, version 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD 3-Clause License"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
    "CC0-1.0": ["CC0 1.0 Universal"],
}

#: Longer texts of licences and their usual headers.
TEXTS = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software."
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies."
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: 1. Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution."
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version."
    ],
    "All-Rights-Reserved": ["All rights reserved."],
}


def templates():
    """(licence, text) of all texts, and of notices put together from the names."""
    out = [(licence, text) for licence, texts in TEXTS.items() for text in texts]
    for licence, names in NAMES.items():
        for name in names:
            the = "" if name.startswith("CC") else "the "
            out += [(licence, f"{verb} under {the}{name}") for verb in ("Released", "Licensed", "Distributed")]
            out.append((licence, f"This work is licensed under {the}{name}"))
    return out


def words(text):
    return _WORD.findall((text or "").lower())


def bigrams(sequence):
    return list(zip(sequence, sequence[1:]))


class LicenseScanner:
    """Templates prepared for many texts; ``percent`` is the least similarity."""

    def __init__(self, pairs, percent):
        self.percent = percent
        self.names = [licence for licence, _ in pairs]
        self.bigrams = [Counter(bigrams(words(text))) for _, text in pairs]
        self.sizes = [sum(b.values()) for b in self.bigrams]
        self.owners = {}
        for i, found in enumerate(self.bigrams):
            for bigram in found:
                self.owners.setdefault(bigram, []).append(i)
        self.known = set(self.owners)

    def passages(self, text):
        """(licence, dice, first word, end word): the best passage per licence."""
        sequence = words(text)
        pairs = bigrams(sequence)
        if self.known.isdisjoint(pairs):
            return []
        places = {}
        for place, bigram in enumerate(pairs):
            for i in self.owners.get(bigram, ()):
                places.setdefault(i, []).append(place)
        best = {}
        for i, at in sorted(places.items()):
            found = self._best(pairs, np.array(at), i)
            if found:
                score, first, size = found
                key = (-score, first, size)
                if self.names[i] not in best or key < best[self.names[i]]:
                    best[self.names[i]] = key
        return [(n, -k[0], k[1], k[1] + k[2] + 1) for n, k in sorted(best.items())]

    def _best(self, pairs, at, i):
        """Best passage for one template; it starts and ends with a shared bigram."""
        size, t = self.sizes[i], self.percent / 100
        least, longest = size * t / (2 - t), int(size * (2 - t) / t + 1e-9)
        if len(at) < least:
            return None
        within = np.searchsorted(at, at + longest) - np.arange(len(at))
        best = None
        for start in np.flatnonzero(within >= least - 1e-9).tolist():
            left, shared = dict(self.bigrams[i]), 0
            for place in at[start : start + within[start]].tolist():
                if left[pairs[place]]:
                    left[pairs[place]] -= 1
                    shared += 1
                length = place - int(at[start]) + 1
                if 200 * shared >= self.percent * (length + size):
                    key = (2 * shared / (length + size), -int(at[start]), -length)
                    best = max(best or key, key)
        return best and (best[0], -best[1], -best[2])


FOUND_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("license", T.StringType()),
            T.StructField("dice", T.DoubleType()),
            T.StructField("first_word", T.LongType()),
            T.StructField("end_word", T.LongType()),
        ]
    )
)


def with_licenses(docs, text="text", into="licenses", percent=80, pairs=None):
    """``docs`` with an array of the licences found in each text."""
    scanner = LicenseScanner(pairs or templates(), percent)

    @F.pandas_udf(FOUND_TYPE)
    def scanned(texts: pd.Series) -> pd.Series:
        rows = ([dict(zip(FOUND_TYPE.elementType.names, p)) for p in scanner.passages(t)] for t in texts)
        return pd.Series(list(rows), dtype=object)

    return docs.withColumn(into, scanned(F.col(f"`{text}`").cast("string")))
