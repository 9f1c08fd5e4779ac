"""Benchmark passages in training documents, by a positional inverted index.

Words are runs of ASCII letters and digits, in lower case, and of anything beyond
ASCII. A window is ten consecutive words of an item, or all words of a shorter
one; an item without words has none. Of each window the two terms rarest in the
corpus are looked up: their postings (document and position) are stored, moved
back by their offset in the item, and intersected; what remains is compared word
by word. Everything is DataFrame expressions.

Items are handled in segments of at most 62 words, so that offsets fit the bits
of a long: intersecting lists is a bitwise aggregate. Null texts have no words; a
null item id counts as the empty string, items of one id as one item. Repeated
documents are judged each.
"""

import string

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillroll.llm.common import text_md5, text_of
from tillroll.sources.scratch import written

#: Words of a window, and windows of a segment: 62 bits at most.
WINDOW, SEGMENT_WINDOWS = 10, 53
#: Rows up to which a table is sent to all executors; rows of at most 62 words.
BROADCAST_ROWS = 50_000


def small(df):
    """``df`` with a broadcast hint if it has few rows; joins shuffle otherwise."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def normalized(column):
    """The words of a text, joined by single spaces."""
    lowered = F.translate(column, string.ascii_uppercase, string.ascii_lowercase)
    return F.trim(F.regexp_replace(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))


def words_in(joined):
    """Array of words; no words make an empty array."""
    empty = F.array().cast("array<string>")
    return F.when(F.col(joined) == "", empty).otherwise(F.split(joined, " "))


def stored_words(docs, doc_id="doc_id", text="text"):
    """key, doc_id, text_md5, n_words and the joined words of every document, stored once."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("key"),
        F.col(f"`{doc_id}`").alias("doc_id"),
        text_md5(text).alias("text_md5"),
        normalized(text_of(text)).alias("joined"),
    )
    spaces = F.length("joined") - F.length(F.replace("joined", F.lit(" "), F.lit("")))
    count = F.when(F.col("joined") == "", 0).otherwise(spaces + 1).cast("long")
    return written(rows.withColumn("n_words", count), "words")


def segments_of(items, item_id="item_id", text="text", window=WINDOW):
    """segment, item_id, size (words of a window) and the words of each segment."""
    rows = (
        items.select(
            F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item_id"),
            normalized(text_of(text)).alias("joined"),
        )
        .withColumn("words", words_in("joined"))
        .filter(F.size("words") > 0)
        .withColumn("size", F.least(F.lit(window), F.size("words")))
        .select(
            "item_id",
            "size",
            "words",
            F.explode(F.expr(f"sequence(0, size(words) - size, {SEGMENT_WINDOWS})")).alias("start"),
        )
    )
    words = F.expr(f"slice(words, start + 1, {SEGMENT_WINDOWS - 1} + size)")
    cut = rows.select("item_id", "size", words.alias("words"))
    return written(cut.select(F.monotonically_increasing_id().alias("segment"), "*"), "segments")


def document_frequency(documents, segments):
    """Number of documents with a term, for the terms of the items."""
    terms = segments.select(F.explode("words").alias("term")).distinct()
    found = documents.select(F.explode(F.array_distinct(words_in("joined"))).alias("term"))
    counted = found.join(small(terms), "term").groupBy("term").agg(F.count("*").alias("docs"))
    return written(counted, "frequency")


def rarest_terms(segments, frequency, depth=2):
    """(segment, needs, anchors): per window the bits of its ``depth`` rarest terms.

    ``anchors`` are (term, offset) of any window. A window with a term no document
    has is left out: it cannot occur.
    """
    places = (
        segments.select("segment", "size", "words", F.expr("explode(sequence(0, size(words) - size)) AS w"))
        .select("segment", "w", F.expr("posexplode(slice(words, w + 1, size)) AS (i, term)"))
        .select("segment", "w", "term", F.expr("w + i").alias("offset"))
        .join(frequency, "term", "left")
    )
    window = Window.partitionBy("segment", "w")
    ranked = (
        places.withColumn("least", F.min(F.coalesce("docs", F.lit(0))).over(window))
        .filter("least > 0")
        .withColumn("rank", F.row_number().over(window.orderBy("docs", "offset")))
        .filter(F.col("rank") <= depth)
        .withColumn("bit", F.expr("shiftleft(1L, offset)"))
    )
    by_window = ranked.groupBy("segment", "w").agg(
        F.bit_or("bit").alias("need"), F.collect_list(F.struct("term", "offset")).alias("anchors")
    )
    return written(
        by_window.groupBy("segment").agg(
            F.collect_set("need").alias("needs"),
            F.array_distinct(F.flatten(F.collect_list("anchors"))).alias("anchors"),
        ),
        "rarest",
    )


def postings_of(documents, terms):
    """(term, key, position) of the given terms: the positional index, stored."""
    found = documents.select("key", F.posexplode(words_in("joined")).alias("position", "term"))
    return written(found.join(small(terms), "term"), "postings")


def alignments_of(postings, rarest):
    """Postings moved back by their offset: (key, segment, shift, bit)."""
    anchors = rarest.select("segment", F.explode("anchors").alias("a")).select(
        "segment", F.col("a.term"), F.col("a.offset")
    )
    return postings.join(small(anchors), "term").select(
        "key",
        "segment",
        (F.col("position") - F.col("offset")).alias("shift"),
        F.expr("shiftleft(1L, offset)").alias("bit"),
    )


def phrase_matches(documents, segments, rarest, postings):
    """Where windows occur: (key, item_id, first, end), runs of covered words."""
    intersected = (
        alignments_of(postings, rarest)
        .groupBy("key", "segment", "shift")
        .agg(F.bit_or("bit").alias("found"))
        .join(small(rarest.select("segment", "needs")), "segment")
        .filter(F.expr("exists(needs, n -> (found & n) = n)"))
        .select("key", "segment", "shift")
    )
    candidates = written(intersected.join(small(segments), "segment"), "candidates")
    # Words are split once per row: as arguments of zip_with, not inside a lambda.
    lacking = F.greatest(F.lit(0), -F.col("shift"))
    compared = (
        documents.select("key", "joined")
        .join(small(candidates), "key")
        .select(
            "key",
            "item_id",
            "size",
            "shift",
            lacking.alias("lacking"),
            F.expr("slice(words, greatest(0, -shift) + 1, size(words))").alias("wanted"),
            F.slice(
                words_in("joined"), F.greatest(F.lit(0), F.col("shift")) + 1, F.size("words")
            ).alias("found"),
        )
        .withColumn("same", F.zip_with("wanted", "found", lambda w, f: w.eqNullSafe(f) & w.isNotNull()))
        .select(
            "key",
            "item_id",
            "size",
            "shift",
            F.aggregate(
                F.zip_with(
                    "same",
                    F.sequence("lacking", F.lit(61)),
                    lambda s, i: F.when(s & i.isNotNull(), F.call_function("shiftleft", F.lit(1).cast("long"), i)),
                ),
                F.lit(0).cast("long"),
                lambda bits, one: bits.bitwiseOR(F.coalesce(one, F.lit(0).cast("long"))),
            ).alias("same"),
        )
    )
    starts = "aggregate(sequence(0, size - 1), -1L, (bits, i) -> bits & shiftrightunsigned(same, i))"
    compared = written(
        compared.filter("same <> 0").withColumn("starts", F.expr(starts)).filter("starts <> 0"), "same"
    )
    cover = "aggregate(sequence(0, size - 1), 0L, (bits, i) -> bits | shiftleft(starts, i))"
    compared = written(compared.withColumn("covered", F.expr(cover)), "covered")
    # runs of set bits: a first word has none set before it, an end is the word after a run
    first = "filter(sequence(0, 62), i -> (shiftright(covered, i) & 1) = 1 AND (i = 0 OR (shiftright(covered, i - 1) & 1) = 0))"
    end = "filter(sequence(1, 63), i -> (shiftright(covered, i - 1) & 1) = 1 AND (i = 63 OR (shiftright(covered, i) & 1) = 0))"
    runs = F.explode(F.arrays_zip(F.expr(first).alias("first"), F.expr(end).alias("end")))
    return compared.select("key", "item_id", "shift", runs.alias("run")).select(
        "key",
        "item_id",
        (F.col("shift") + F.col("run.first")).alias("first"),
        (F.col("shift") + F.col("run.end")).alias("end"),
    )


def proximity_matches(postings, rarest, slop=5, share=0.6):
    """(key, segment, near): segments whose looked-up terms mostly stand together.

    Terms count if they are displaced by at most ``slop`` words against each
    other; ``near`` is the share of a segment's terms, at least ``share``.
    """
    window = Window.partitionBy("key", "segment").orderBy("shift").rangeBetween(0, slop)
    near = alignments_of(postings, rarest).withColumn("found", F.bit_or("bit").over(window))
    return (
        near.groupBy("key", "segment")
        .agg(F.max(F.bit_count("found")).alias("n"))
        .join(small(rarest.select("segment", F.size("anchors").alias("of"))), "segment")
        .select("key", "segment", (F.col("n") / F.col("of")).alias("near"))
        .filter(F.col("near") >= share)
    )


def contamination(docs, items, doc_id="doc_id", text="text", item_id="item_id", item_text="text", window=WINDOW):
    """(documents, hits): the stored words, and per contaminated document
    key, n_hit, n_items and items (sorted ids).
    """
    documents = stored_words(docs, doc_id, text)
    segments = segments_of(items, item_id, item_text, window)
    rarest = rarest_terms(segments, document_frequency(documents, segments))
    terms = rarest.select(F.explode("anchors.term").alias("term")).distinct()
    matches = phrase_matches(documents, segments, rarest, postings_of(documents, terms))
    before = (
        Window.partitionBy("key").orderBy("first", "end").rowsBetween(Window.unboundedPreceding, -1)
    )
    reached = F.coalesce(F.max("end").over(before), F.lit(0))
    own = F.greatest(F.lit(0), F.col("end") - F.greatest("first", reached))
    hits = (
        matches.withColumn("own", own)
        .groupBy("key")
        .agg(F.sum("own").cast("long").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
        .withColumn("n_items", F.size("items").cast("long"))
    )
    return documents, hits


def without_contaminated(docs, items, doc_id="doc_id", text="text"):
    """The rows and columns of ``docs`` in whose text no window of an item occurs."""
    documents, hits = contamination(docs, items, doc_id, text)
    texts = documents.join(hits, "key", "left_semi").select(F.col("text_md5").alias("__md5"))
    found = small(written(texts.distinct(), "contaminated"))
    return docs.join(found, text_md5(text).eqNullSafe(F.col("__md5")), "left_anti")
