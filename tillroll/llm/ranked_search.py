"""The best documents of a table for each of many short texts, exactly.

A document's score for an item adds, over the item's terms, repeats included, the
term's weight times a saturating share of its occurrences in the document; all
but the weight's logarithm is whole-number arithmetic. Terms are runs of ASCII
letters and digits and of all other characters; only A-Z are lower-cased.

* One pass counts the items' terms in every whole text; the counts are stored,
  and the totals and document frequencies come from them.
* Documents are then taken in blocks. In a block every term is a bitmap of its
  documents with the most it can add. Terms whose sum stays below what an item's
  best documents already have cannot lift a document by themselves; the bitmaps
  of the others, united, are the documents to look at. These are grouped by the
  mask of the terms they hold. A mask's terms bound the score of its group, and
  groups are evaluated by descending bound until the next one cannot reach the
  items' best. What a task has found bounds its later blocks.
* The best of every task meet in a window that keeps the best of all.

Items are taken in blocks of so many terms, each a pass over the documents, so
what a task knows of the items is bounded whatever their number.

Null texts and texts without terms are in no result and no count, as items and as
documents. Every item row is ranked by itself, even if its id repeats, and so is
every document row. Equal scores are ordered by id, null last. Columns other than
the named ones play no part.
"""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tillroll.llm.common import text_of
from tillroll.sources.scratch import written

#: Documents and counted terms of a block.
BLOCK_DOCS, BLOCK_TERMS = 8192, 2_000_000
#: Distinct terms of the items that are searched together.
ITEM_TERMS = 50_000
#: Documents scored at once.
SCORED = 64

_KEPT = b"abcdefghijklmnopqrstuvwxyz0123456789"
_TABLE = bytes(
    b if b >= 128 or b in _KEPT else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def terms_of(text):
    return (text or "").encode().translate(_TABLE).split()


def item_blocks(items):
    """Lists of (row, {term: times}) with at most ``ITEM_TERMS`` terms or one item each."""
    block, terms = [], 0
    for row, text in items.toLocalIterator():
        counts = Counter(terms_of(text))
        if block and terms + len(counts) > ITEM_TERMS:
            yield block
            block, terms = [], 0
        if counts:
            block.append((row, counts))
            terms += len(counts)
    if block:
        yield block


def counted(docs, vocabulary, doc_id, text):
    """doc_id, n (terms of the text), terms and times of those in ``vocabulary``, stored."""
    number = vocabulary.get

    @F.pandas_udf("n long, terms array<int>, times array<int>")
    def count(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for content in texts:
            words = terms_of(content)
            known = [i for i in map(number, words) if i is not None]
            terms, times = np.unique(np.array(known, np.int32), return_counts=True)
            rows.append((len(words), terms, times.astype(np.int32)))
        return pd.DataFrame(rows, columns=["n", "terms", "times"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), count(text_of(text)).alias("of"))
    return written(rows.select("doc_id", "of.*"), "term-counts")


def weights_of(counts):
    """(documents with a term, their terms, {term: weight}) of stored counts."""
    n, total = counts.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
    found = counts.select(F.explode("terms").alias("term")).groupBy("term").count()
    rows = found.collect()  # no more than there are terms in a block of items
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t, df in rows}
    return n, total or 0, weight


class _Best:
    """The best documents of an item so far: score, then id, null last."""

    def __init__(self, limit):
        self.limit, self.rows = limit, []

    @property
    def least(self):
        """What a document must reach to matter."""
        return self.rows[-1][0] if len(self.rows) == self.limit else 1

    def add(self, scores, ids):
        least = self.least
        self.rows += [(s, i) for s, i in zip(scores.tolist(), ids) if s >= least]
        self.rows.sort(key=lambda r: (-r[0], r[1] is None, r[1]))
        del self.rows[self.limit :]


class _Block:
    """Documents with the items' terms as bitmaps and lists."""

    def __init__(self, ids, n, sizes, terms, times, n_docs, n_terms):
        self.ids, docs = ids, len(ids)
        place = np.repeat(np.arange(docs, dtype=np.int32), sizes)
        order = np.argsort(terms, kind="stable")
        self.place, times = place[order], times[order].astype(np.int64)
        mean = 100 - 25 + (25 * n.astype(np.int64) * n_docs) // n_terms
        self.adds = (1_000_000_000 * times) // (1000 * times + 12 * mean[self.place])
        self.terms, self.starts = np.unique(terms[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        self.most = np.maximum.reduceat(self.adds, self.starts) if len(order) else self.adds
        self.bitmaps = {}

    def bitmap(self, at):
        """Bits of the documents that hold the term at place ``at``."""
        if at not in self.bitmaps:
            bits = np.zeros(len(self.ids), np.uint8)
            bits[self.place[self.starts[at] : self.ends[at]]] = 1
            self.bitmaps[at] = np.packbits(bits)
        return self.bitmaps[at]

    def scores(self, docs, ats, weights):
        """Scores of the documents at the sorted places ``docs``."""
        total = np.zeros(len(docs), np.int64)
        for at, weight in zip(ats, weights):
            start, end = self.starts[at], self.ends[at]
            list_of = self.place[start:end]
            found = np.minimum(np.searchsorted(list_of, docs), end - start - 1)
            total += np.where(list_of[found] == docs, weight * self.adds[start + found], 0)
        return total

    def search(self, terms, weights, best):
        """Add the documents that may be among an item's best."""
        if not len(self.terms):
            return
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = self.terms[at] == terms
        at, weights = at[here], weights[here]
        bounds = weights * self.most[at]
        order = np.argsort(-bounds, kind="stable")
        at, weights, bounds = at[order], weights[order], bounds[order]
        rest = np.cumsum(bounds[::-1])[::-1]  # what this term and all lesser ones can add
        telling = int((rest >= best.least).sum())
        if not telling:
            return
        maps = np.stack([self.bitmap(a) for a in at])
        united = np.bitwise_or.reduce(maps[:telling], axis=0)
        docs = np.flatnonzero(np.unpackbits(united, count=len(self.ids)))
        held = (maps[:, docs >> 3] >> (7 - (docs & 7)).astype(np.uint8)) & 1
        group, first = _groups(held)
        most = bounds @ held[:, first].astype(np.int64)
        members = np.argsort(group, kind="stable")
        sizes = np.bincount(group, minlength=len(first))
        begins = np.cumsum(sizes) - sizes
        queue = np.argsort(-most, kind="stable")
        done = 0
        while done < len(queue) and most[queue[done]] >= best.least:
            taken, chosen = 0, []
            while done < len(queue) and taken < SCORED and most[queue[done]] >= best.least:
                g = queue[done]
                chosen.append(members[begins[g] : begins[g] + sizes[g]])
                taken, done = taken + sizes[g], done + 1
            places = np.sort(docs[np.concatenate(chosen)])
            scores = self.scores(places, at, weights)
            good = scores >= best.least
            best.add(scores[good], [self.ids[p] for p in places[good].tolist()])


def _groups(held):
    """Per document the number of its mask, and per mask one document."""
    packed = np.packbits(held, axis=0)
    packed = np.pad(packed, ((0, -len(packed) % 8), (0, 0)))
    words = np.ascontiguousarray(packed.T).view(np.uint64)
    group = np.zeros(len(words), np.int64)
    for word in words.T:
        _, rank = np.unique(word, return_inverse=True)
        _, group = np.unique(group * (int(rank.max(initial=0)) + 1) + rank, return_inverse=True)
    _, first = np.unique(group, return_index=True)
    return group, first


def searched(counts, items, n_docs, n_terms, limit):
    """(item, doc_id, score): per task the best documents of each item.

    ``items``: (row, term numbers, weights) of a block of items.
    """
    kind = to_arrow_type(counts.schema["doc_id"].dataType)

    def of_task(batches):
        best = {row: _Best(limit) for row, _, _ in items}
        parts, docs, held = [], 0, 0

        def search():
            ids = [i for part in parts for i in part[0]]
            block = _Block(ids, *(np.concatenate(c) for c in list(zip(*parts))[1:]), n_docs, n_terms)
            for row, terms, weights in items:
                block.search(terms, weights, best[row])

        for batch in batches:
            lists = batch.column("terms"), batch.column("times")
            sizes = np.diff(lists[0].offsets.to_numpy())
            numbers = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
            n = batch.column("n").to_numpy(zero_copy_only=False)
            parts.append((batch.column("doc_id").to_pylist(), n, sizes, *numbers))
            docs, held = docs + len(n), held + len(numbers[0])
            if docs >= BLOCK_DOCS or held >= BLOCK_TERMS:
                search()
                parts, docs, held = [], 0, 0
        if parts:
            search()
        found = [(row, i, s) for row, b in best.items() for s, i in b.rows]
        rows, ids, scores = zip(*found) if found else ((), (), ())
        arrays = [pa.array(rows, pa.int64()), pa.array(ids, kind), pa.array(scores, pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, ["item", "doc_id", "score"])

    holding = counts.filter(F.size("terms") > 0).select("doc_id", "n", "terms", "times")
    doc_id = counts.schema["doc_id"].dataType.simpleString()
    return holding.mapInArrow(of_task, f"item long, doc_id {doc_id}, score long")


def ranked(docs, items, limit=20, doc_id="doc_id", text="text", item_id="item_id", item_text="text"):
    """item_id, rank, doc_id and score of the ``limit`` best documents of every item."""
    rows = items.select(
        F.monotonically_increasing_id().alias("item"),
        F.col(f"`{item_id}`").alias("item_id"),
        text_of(item_text).alias("text"),
    )
    rows = written(rows, "items")
    found = None
    for block in item_blocks(rows.select("item", "text")):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
        counts = counted(docs, vocabulary, doc_id, text)
        n_docs, n_terms, weight = weights_of(counts)
        asked = []
        for row, terms in block:
            known = [(vocabulary[t], weight.get(vocabulary[t], 0) * times) for t, times in terms.items()]
            known = [(t, w) for t, w in known if w > 0]
            if known:
                asked.append((row, *(np.array(c, np.int64) for c in zip(*known))))
        best = written(searched(counts, asked, n_docs, n_terms, limit), "best-documents")
        found = best if found is None else found.unionByName(best)
    named = rows.select("item", "item_id")
    if found is None:
        found = docs.limit(0).select(
            F.lit(0).cast("long").alias("item"),
            F.col(f"`{doc_id}`").alias("doc_id"),
            F.lit(0).cast("long").alias("score"),
        )
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    first = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    return first.join(named, "item").select("item_id", "rank", "doc_id", "score")
