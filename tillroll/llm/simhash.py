"""Documents linked by the Hamming distance of their SimHash fingerprints.

A fingerprint has a bit set where over half the hashes of a text's shingles,
repeats included, have it set. Fingerprints are cut into ``distance + SHARED``
blocks; a difference of ``distance`` bits leaves ``SHARED`` blocks alike, so every
close pair meets under the bits of one choice of that many blocks.

* Documents of the same fingerprint form a class; only classes meet.
* The classes that share some blocks are compared pair by pair if they are few,
  and the Hamming distance decides.
* Where many share them, each class is sent to all values it turns into by
  changing half of ``distance`` bits outside the blocks. Two classes are close
  enough if and only if they reach a common value; there all are linked with one,
  again behind the Hamming distance. The work grows with the classes, not with
  their pairs, and no class is left out.

Shingles are ``k`` words joined by spaces, hashed by XXH64 with seed 42; words are
runs of non-space, ASCII in lower case. Fewer words are one shingle. Null texts
and texts without words have the fingerprint zero and link like any other.
Repeated rows are copies. A null id counts as larger than all others. Columns
other than the two named play no part.
"""

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import functions as F

from tillroll.llm.components import components
from tillroll.llm.shingles import LOWER
from tillroll.sources.scratch import written

BITS = 64
#: Blocks that a close pair is sure to share.
SHARED = 3
#: Classes under the same blocks up to which all pairs are compared.
CROWD = 32
_SEED = 42


def shingle_hashes(text, k):
    """XXH64 of every run of ``k`` words, repeats included."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(k, len(words))
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], _SEED) for a, b in zip(starts, ends[k - 1 :].tolist())]
    return np.array(hashes, np.uint64)


def majority_bits(hashes):
    """The signed 64-bit number of the bits set in over half the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 255 * 256):
        part = hashes[at : at + 255 * 256].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(part) // 255 * 255  # 255 rows of bits add up within a byte
        counts += bits[:full].reshape(-1, 255, BITS).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        counts += bits[full:].sum(0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text, k=3):
    """Column with the fingerprint of a text column."""

    @F.pandas_udf("long")
    def of_texts(texts: pd.Series) -> pd.Series:
        return pd.Series([majority_bits(shingle_hashes(t, k)) for t in texts], dtype="int64")

    return of_texts(F.col(f"`{text}`").cast("string"))


def hex_digits(column):
    """A fingerprint as 16 hexadecimal digits."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def _signed(number):
    return number - (1 << BITS) if number >> (BITS - 1) else number


def block_masks(distance):
    """Masks of every choice of ``SHARED`` out of ``distance + SHARED`` blocks."""
    n = distance + SHARED
    edges = [BITS * i // n for i in range(n + 1)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(blocks, SHARED)]


def _changes(spark, distance):
    """(choice, change, near): changes of at most half of ``distance`` bits outside
    the blocks of each choice, rounded up, and whether rounded down as well.
    """
    rows = []
    for choice, mask in enumerate(block_masks(distance)):
        free = [1 << b for b in range(BITS) if not mask >> b & 1]
        for size in range((distance + 1) // 2 + 1):
            for bits in combinations(free, size):
                rows.append((choice, _signed(sum(bits)), size <= distance // 2))
    return spark.createDataFrame(rows, "choice int, change long, near boolean")


def _close(a, b, distance):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def close_links(prints, distance=2):
    """Links (a, b) that connect all distinct fingerprints at ``distance`` or less.

    ``prints``: a stored table with a column ``print``, each value once.
    """
    if not 0 <= distance <= 3:
        raise ValueError("distance must be 0 to 3")
    keys = [F.col("print").bitwiseAND(F.lit(_signed(m))) for m in block_masks(distance)]
    entries = prints.select("print", F.posexplode(F.array(*keys)).alias("choice", "key"))
    sizes = entries.groupBy("choice", "key").agg(F.count("*").alias("size")).filter("size > 1")
    met = written(entries.join(written(sizes, "block-sizes"), ["choice", "key"]), "blocks")

    few = met.filter(F.col("size") <= CROWD).select("choice", "key", F.col("print").alias("a"))
    pairs = few.join(few.withColumnRenamed("a", "b"), ["choice", "key"]).filter("a < b")
    pairs = pairs.filter(_close("a", "b", distance)).select("a", "b").distinct()

    # The changes are some thousand rows at most, whatever the input.
    many = met.filter(F.col("size") > CROWD).join(
        F.broadcast(_changes(prints.sparkSession, distance)), "choice"
    )
    reached = many.select(
        "choice", F.col("print").bitwiseXOR(F.col("change")).alias("value"), "near", "print"
    )
    hubs = reached.groupBy("choice", "value").agg(
        F.min(F.when(F.col("near"), F.col("print"))).alias("a"),
        F.collect_list("print").alias("others"),  # no more than there are changes
    )
    stars = hubs.filter("a IS NOT NULL AND size(others) > 1").select("a", F.explode("others").alias("b"))
    stars = stars.filter("a <> b").filter(_close("a", "b", distance)).distinct()
    return written(pairs.unionByName(stars), "print-links")


def near_duplicates(docs, doc_id="doc_id", text="text", k=3, distance=2):
    """One row per document: doc_id, fingerprint (long) and component_id, the smallest
    id in reach over links of at most ``distance`` bits.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), fingerprint(text, k).alias("print"))
    rows = written(rows, "fingerprints")
    classes = rows.groupBy("print").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"))
    classes = written(classes, "classes")
    labels = components(close_links(classes.select("print"), distance))
    labelled = classes.join(labels.withColumnRenamed("node", "print"), "print", "left").filter(
        "copies > 1 OR label IS NOT NULL"
    )
    labelled = written(labelled.withColumn("label", F.coalesce("label", "print")), "labelled")
    least = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = labelled.join(least, "label").select("print", "component_id")
    return rows.join(named, "print", "left").select(
        "doc_id",
        F.col("print").alias("fingerprint"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )
