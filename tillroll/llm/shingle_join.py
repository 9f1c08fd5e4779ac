"""Documents linked by the Jaccard similarity of their word shingles.

The incidence of documents and shingles is a sparse matrix, and overlaps are its
product with itself. Sizes bound what must be multiplied: two documents that are
similar enough share one of the first ``prefix`` shingles of either, in any
order of all shingles. The order puts frequent ones last.

* Documents with the same set form a class; only one of a class is multiplied.
* In the list of documents that share a prefix shingle, each is first compared
  with the smallest one. What links joins into components, and pairs within a
  component need no further look.
* What is left of short lists is counted pair by pair; a pair whose counts rule
  out the similarity is dropped, the others are compared in full.
* Long lists are multiplied in blocks of documents with their full sets.

No list is cut, and no pair dropped that its size or overlap does not rule out:
the links found connect the same documents as all links would. Shingles are
62-bit hashes; the order is a matter of speed, so it may rest on a bounded number
of frequent shingles.

Null texts and texts without words have an empty set and link with nothing; of
fewer than ``k`` words the whole sequence is one shingle. Repeated rows are
copies like any others. A null id counts as larger than all others.
"""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import of_rows, text_md5
from tillroll.llm.components import components
from tillroll.llm.shingles import Shingler
from tillroll.sources.scratch import written

#: Lists up to this length are counted pair by pair.
SHORT = 64
#: A shingle in more prefixes than this is put last, of the most frequent so many.
FREQUENT, FREQUENT_KEPT = 16, 100_000
#: Shingles of the documents in a block.
BLOCK = 1 << 20
#: Documents in a block; two blocks are multiplied as a dense matrix of twice as many rows.
BLOCK_DOCS = 1000
#: Rows of three numbers up to which a table is sent to all executors.
BROADCAST_ROWS = 500_000
_LAST = np.uint64(1 << 62)


def small(df):
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def prefix_size(n, percent):
    """Shingles of which similar documents share one: n - ceil(n * percent / 100) + 1."""
    return n - (-(-n * percent // 100)) + 1


def similar(a, b, percent):
    """Whether two sorted distinct arrays are similar enough, exactly."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def ordered(shingles, frequent):
    """Keys whose order is that of all documents: frequent shingles last."""
    if not len(frequent) or not len(shingles):
        return shingles
    at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
    return np.sort(np.where(frequent[at] == shingles, shingles | _LAST, shingles))


def frequent_shingles(texts, k, percent):
    """The shingles found in most prefixes, at most ``FREQUENT_KEPT``, sorted."""

    def counted(batches):
        shingler = Shingler(k)
        for batch in batches:
            sets = map(shingler.set_of, batch["text"])
            prefixes = [s[: prefix_size(len(s), percent)] for s in sets if len(s)]
            keys, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *prefixes]), return_counts=True)
            yield pd.DataFrame({"key": keys.astype(np.int64), "n": n.astype(np.int64)})

    counts = texts.mapInPandas(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    most = counts.filter(F.col("n") > FREQUENT).orderBy(F.desc("n"), "key").limit(FREQUENT_KEPT)
    return np.array(sorted(r["key"] for r in most.select("key").collect()), np.uint64)


def described(docs, frequent, k, percent, doc_id, text):
    """row, doc_id, text_md5, n, set_md5 and prefix of every document, stored."""
    schema = T.StructType(
        [
            T.StructField("row", T.LongType()),
            T.StructField("doc_id", T.StringType()),
            T.StructField("text_md5", T.StringType()),
            T.StructField("n", T.LongType()),
            T.StructField("set_md5", T.BinaryType()),
            T.StructField("prefix", T.ArrayType(T.LongType())),
        ]
    )

    def rows_of(batches):
        shingler = Shingler(k)
        for batch in batches:
            rows = []
            for row, doc, md5, content in zip(*(batch[c] for c in ("row", "doc_id", "text_md5", "text"))):
                shingles = shingler.set_of(content)
                keys = ordered(shingles, frequent)[: prefix_size(len(shingles), percent)]
                whole = hashlib.md5(shingles.tobytes()).digest() if len(shingles) else None
                rows.append((row, doc, md5, len(shingles), whole, keys.astype(np.int64)))
            yield pd.DataFrame(rows, columns=schema.names)

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{doc_id}`").cast("string").alias("doc_id"),
        text_md5(text).alias("text_md5"),
        F.col(f"`{text}`").cast("string").alias("text"),
    )
    table = written(rows.mapInPandas(rows_of, schema), "described")
    return table.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))


def shared_entries(table, classes):
    """Entries of prefix shingles that several classes have: key, class, n, rank,
    entries (length of the list) and hub (its smallest class), stored.
    """
    copies = table.filter("n > 0").join(
        classes.filter("copies > 1").select("set_md5", "class"), "set_md5"
    )
    others = copies.filter("row <> class").select("row")
    entries = (
        table.filter("n > 0")
        .select(F.col("row").alias("class"), "n", "prefix", "row")
        .join(small(written(others, "copies")), "row", "left_anti")
        .select("class", "n", F.posexplode("prefix").alias("rank", "key"))
    )
    lists = entries.groupBy("key").agg(F.count("*").alias("entries"), F.min("class").alias("hub"))
    return written(entries.join(lists.filter("entries > 1"), "key"), "entries")


def texts_of(docs, text, wanted):
    """(class, text) for the classes in ``wanted`` (class, text_md5), each once."""
    content = F.col(f"`{text}`").cast("string")
    found = docs.select(text_md5(text).alias("text_md5"), content.alias("text"))
    return found.join(small(written(wanted, "wanted")), "text_md5").groupBy("class").agg(
        F.first("text").alias("text")
    )


def verified(pairs, texts, k, percent):
    """The pairs (a, b) whose full sets are similar enough."""

    def check(batches):
        shingler, last, mine = Shingler(k), None, None
        for batch in batches:
            kept = []
            for a, b, text_a, text_b in zip(*(batch[c] for c in ("a", "b", "text_a", "text_b"))):
                if a != last:
                    last, mine = a, shingler.set_of(text_a)
                kept.append(similar(mine, shingler.set_of(text_b), percent))
            yield batch.loc[np.array(kept, bool), ["a", "b"]]

    sides = [texts.select(F.col("class").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab"]
    joined = pairs.join(sides[1], "b").join(sides[0], "a").select("a", "b", "text_a", "text_b")
    return joined.mapInPandas(check, "a long, b long")


def hub_pairs(entries, percent):
    """Per class the hub it shares most prefix shingles with, if a good part of them."""
    shared = entries.filter("class <> hub").groupBy("class", "hub").agg(
        F.count("*").alias("shared"), F.first("n").alias("n")
    )
    near = shared.filter(F.col("shared") * 20 * 4 >= F.col("n") * (100 - percent))
    return near.groupBy("class").agg(F.max(F.struct("shared", -F.col("hub"))).alias("best")).select(
        (-F.col("best.col2")).alias("a"), F.col("class").alias("b")
    )


def short_pairs(entries, percent):
    """Pairs of classes of different components in short lists that may be similar."""
    long_entries = (
        entries.filter(F.col("entries") > SHORT).groupBy("class").agg(F.count("*").alias("in_long"))
    )
    left = entries.filter(F.col("entries") <= SHORT).select("key", "class", "n", "rank", "label")
    right = left.withColumnsRenamed({c: f"{c}_b" for c in left.columns if c != "key"})
    pairs = (
        left.withColumnRenamed("class", "a")
        .join(right, "key")
        .filter(
            "a < class_b AND label <> label_b "
            f"AND least(n, n_b) * 100 >= greatest(n, n_b) * {percent}"
        )
        .groupBy("a", F.col("class_b").alias("b"))
        .agg(
            F.count("*").alias("shared"),
            F.first("n").alias("n_a"),
            F.first("n_b").alias("n_b"),
            (F.max("rank") + 1).alias("seen_a"),
            (F.max("rank_b") + 1).alias("seen_b"),
        )
    )
    for side in "ab":
        named = long_entries.select(F.col("class").alias(side), F.col("in_long").alias(f"long_{side}"))
        pairs = pairs.join(named, side, "left").fillna(0, [f"long_{side}"])
    # At most so many shared prefix shingles. One of the two prefixes ends first in
    # the order; all of it that is not shared, and what the other has before the
    # last shared one, differs.
    most = "shared + least(long_a, long_b)"
    differ = [
        f"greatest(0, n_{x} - ceil(n_{x} * {percent} / 100) + 1 - ({most})) "
        f"+ greatest(0, seen_{y} - ({most}))"
        for x, y in ("ab", "ba")
    ]
    # similar sets differ in at most (100 - percent) / (100 + percent) of n_a + n_b
    return pairs.filter(
        f"least({differ[0]}, {differ[1]}) * {100 + percent} <= (n_a + n_b) * {100 - percent}"
    ).select("a", "b")


def block_links(members, percent):
    """Links found by multiplying the documents of a list, block by block.

    ``members``: key, block, blocks, class, label, shingles. Per pair of blocks
    at most one link per document is given; they connect what all links would.
    """
    pairs = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        (F.col("block") < F.col("other")).alias("upper"),
        "class",
        "label",
        "shingles",
    )

    def multiply(group):
        group = group.sort_values("class", kind="stable")
        sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
        return pd.DataFrame(_spanning_links(group["class"].to_numpy(), sets, percent), columns=["a", "b"])

    return pairs.groupBy("key", "low", "high").applyInPandas(multiply, "a long, b long")


def _spanning_links(names, sets, percent):
    """Links that connect the similar documents of a block."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, found = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    overlap = np.zeros((len(sets), len(sets)), np.float32)
    many = np.flatnonzero(found > 16)
    for at in range(0, len(many), 1024):  # columns with many entries: as dense panels
        place = np.full(len(found), -1)
        place[many[at : at + 1024]] = np.arange(len(many[at : at + 1024]))
        inside = place[column] >= 0
        panel = np.zeros((len(sets), min(1024, len(many) - at)), np.float32)
        panel[owner[inside], place[column[inside]]] = 1
        overlap += panel @ panel.T
    few = (found[column] > 1) & (found[column] <= 16)  # the others: entry by entry
    order = np.lexsort((owner[few], column[few]))
    c, o = column[few][order], owner[few][order]
    for shift in range(1, 16):
        same = c[shift:] == c[:-shift]
        np.add.at(overlap, (o[:-shift][same], o[shift:][same]), 1)
    overlap = np.maximum(overlap, overlap.T)
    union = sizes[:, None] + sizes[None, :] - overlap
    linked = 100 * overlap >= percent * union
    links, rest = [], np.ones(len(sets), bool)
    for start in range(len(sets)):
        if not rest[start]:
            continue
        rest[start], frontier = False, [start]
        while frontier:
            reached = np.flatnonzero(linked[frontier].any(0) & rest)
            rest[reached] = False
            links += [(int(names[start]), int(names[i])) for i in reached]
            frontier = reached.tolist()
    return links


def _labelled(entries, labels):
    """Entries of lists that still hold several components."""
    same = F.col("class") == F.col("node")
    labelled = entries.join(labels, same, "left").drop("node")
    labelled = written(labelled.withColumn("label", F.coalesce("label", "class")), "labelled")
    lists = labelled.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    several = lists.filter("least < most").select("key")
    return written(labelled.join(several, "key", "left_semi"), "several")


def links_of(docs, table, classes, text, k, percent):
    """Links (a, b) between classes that connect whatever is similar enough."""
    entries = shared_entries(table, classes)
    md5 = table.select(F.col("row").alias("class"), "text_md5")

    def texts(*columns):
        wanted = columns[0]
        for more in columns[1:]:
            wanted = wanted.union(more)
        return texts_of(docs, text, md5.join(wanted.toDF("class").distinct(), "class"))

    hubs = written(hub_pairs(entries, percent), "hubs")
    found = written(texts(hubs.select("a"), hubs.select("b")), "texts")
    links = written(verified(hubs, found, k, percent), "hub-links")
    left = _labelled(entries, components(links))
    pairs = written(short_pairs(left, percent), "pairs")
    lists = (
        left.filter(F.col("entries") > SHORT)
        .groupBy("key")
        .agg(
            F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.count("*") / BLOCK_DOCS))
            .cast("int")
            .alias("blocks")
        )
    )
    members = written(
        left.join(lists, "key")
        .withColumn("block", F.expr("CAST(pmod(xxhash64(class), blocks) AS INT)"))
        .select("key", "blocks", "block", "class", "label"),
        "members",
    )
    found = written(texts(pairs.select("a"), pairs.select("b"), members.select("class")), "texts")
    more = verified(pairs, found, k, percent)

    def sets_of(batches):
        shingler = Shingler(k)
        for batch in batches:
            sets = [shingler.set_of(t).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"class": batch["class"], "shingles": sets})

    wanted = found.join(members.select("class").distinct(), "class", "left_semi")
    sets = wanted.mapInPandas(sets_of, "class long, shingles binary")
    blocked = block_links(members.join(sets, "class"), percent)
    return written(links.unionByName(more).unionByName(blocked), "links")


def near_duplicates(docs, doc_id="doc_id", text="text", k=5, percent=80):
    """One row per document: row, doc_id, text_md5, n_shingles, component_id (the
    smallest id in reach) and component (a number of the component's own).

    ``docs`` must come from a stored table.
    """
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    table = described(docs, frequent_shingles(texts, k, percent), k, percent, doc_id, text)
    classes = written(
        table.filter("n > 0")
        .groupBy("set_md5")
        .agg(
            F.min("row").alias("class"),
            F.min("doc_id").alias("least_id"),
            F.count("*").alias("copies"),
        ),
        "classes",
    )
    labels = components(links_of(docs, table, classes, text, k, percent))
    labelled = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn(
        "label", F.coalesce("label", "class")
    )
    least = labelled.groupBy("label").agg(F.min("least_id").alias("component_id"))
    named = labelled.join(least, "label").select("set_md5", "component_id", F.col("label").alias("least_row"))
    members = table.drop("prefix").join(named, "set_md5", "left")
    alone = F.col("n") == 0
    return members.select(
        "row",
        "doc_id",
        "text_md5",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.col("row")).otherwise(F.col("least_row")).alias("component"),
    )


def one_per_group(docs, doc_id="doc_id", text="text", k=5, percent=80):
    """The rows and columns of ``docs``, one row of each group of near duplicates.

    The smallest id stays, of repeated rows one. Texts without words all stay.
    """
    rows = written(near_duplicates(docs, doc_id, text, k, percent), "near")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = rows.groupBy("component").agg(F.min(order).alias("first"))
    marked = rows.join(first.select("component", F.col("first.row").alias("stays")), "component")
    kinds = marked.groupBy("doc_id", "text_md5").agg(
        F.max(F.col("row") == F.col("stays")).alias("stays"),
        ((F.count("*") > 1) & (F.max("n_shingles") > 0)).alias("repeated"),
    )
    kinds = written(kinds.withColumnRenamed("doc_id", doc_id).filter("repeated OR NOT stays"), "kinds")
    kept = of_rows(docs, kinds.filter("NOT stays"), "left_anti", doc_id, text, small)
    repeated = kinds.filter("stays AND repeated")
    if repeated.isEmpty():
        return kept
    once = of_rows(kept, repeated, "left_semi", doc_id, text, small).dropDuplicates([doc_id, text])
    return of_rows(kept, repeated, "left_anti", doc_id, text, small).unionByName(once)
