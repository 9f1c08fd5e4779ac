"""Items bought together: exact pair counts without pairing every basket in full.

Input baskets are rows (basket, item, weight), one per basket and item. The
frequency of a pair is the sum over baskets of weight_a * weight_b, which is the
number of shared baskets when all weights are 1. A weight of 0 adds to no pair.

Baskets up to ``narrow`` items are paired within one row each, so their work grows
with the rows. Wider ones are turned on their side: every item holds a bitmap of
the wide baskets it is in, 64 of them in a word, and the count of a pair is the
number of bits two bitmaps have in common. A weight of w puts an item on w levels
of bitmaps. Three exact cuts come first:

* ``need``: with a top-n, a pair must reach the n-th best frequency already
  found among the most sold items, not just the minimum.
* An item whose total weight times the largest weight stays below ``need`` can
  be in no such pair and is dropped.
* The widest baskets, as many as together could add less than ``need`` to any
  pair, bring up no pairs: one that matters also occurs elsewhere. Pairs found in
  the other baskets are looked up in their bitmaps.

What is left of the wide baskets is paired word by word, in parts, so that the
work of a word spreads over as many tasks as it has parts.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillroll.sources.scratch import written

SEED_ITEMS = 64
#: Baskets up to this width are paired within a row.
NARROW = 256
#: Items of a word of baskets that one task pairs with the whole word.
PART_WIDTH = 1_000
#: Wide baskets looked at for the cut; it only saves work.
LOOKED_UP = 10_000


def _summed(pairs):
    return pairs.groupBy("item_a", "item_b").agg(F.sum("frequency").alias("frequency"))


def _pairs_within(baskets):
    """Pairs of narrow baskets: every basket becomes one row of sorted items."""
    content = F.sort_array(F.collect_list(F.struct("item", "weight"))).alias("content")
    named = baskets.filter(F.col("basket").isNotNull())
    rows = named.groupBy("basket").agg(content).filter(F.size("content") > 1)
    firsts = rows.select("content", F.posexplode("content").alias("at", "a"))
    later = F.slice("content", F.col("at") + 2, F.size("content") - F.col("at") - 1)
    return _summed(
        firsts.select("a", F.explode(later).alias("b")).select(
            F.col("a.item").alias("item_a"),
            F.col("b.item").alias("item_b"),
            (F.col("a.weight") * F.col("b.weight")).alias("frequency"),
        )
    )


def _nth_best_seed(baskets, items, n):
    """Frequency of the n-th best pair among the most sold items, 0 if fewer pairs."""
    seeds = items.orderBy(F.desc("weight"), "item").limit(SEED_ITEMS).select("item")
    best = (
        _pairs_within(baskets.join(F.broadcast(seeds), "item", "left_semi"))
        .orderBy(F.desc("frequency"))
        .limit(n)
        .agg(F.count("*").alias("pairs"), F.min("frequency").alias("frequency"))
        .first()
    )
    return best.frequency if best.pairs == n else 0


def _wide_baskets(baskets, narrow):
    widths = baskets.groupBy("basket").agg(
        F.count("*").alias("width"), F.max("weight").alias("peak")
    )
    return written(widths.filter(F.col("width") > narrow), "wide")


def _places(wide, need):
    """(places, reach): a word and a bit for every wide basket, stored.

    Baskets go in order of (width, basket), while what they could add to one pair
    stays below ``need``; these are only ``looked_up``, and ``reach`` is what they
    could add.
    """
    order = (F.desc("width"), F.asc_nulls_last("basket"))
    widest = wide.orderBy(*order).limit(min(LOOKED_UP, max(0, need - 1)))
    running = F.sum(F.col("peak") * F.col("peak")).over(Window.orderBy(*order))
    taken = written(widest.withColumn("reach", running).filter(F.col("reach") < need), "widest")
    reach = taken.agg(F.max("reach")).first()[0] or 0
    names = F.broadcast(taken.select("basket"))
    numbered = [
        part.select(
            "basket", F.lit(kind).alias("looked_up"), F.monotonically_increasing_id().alias("number")
        )
        for part, kind in (
            (taken, True),
            (wide.join(names, "basket", "left_anti"), False),
        )
    ]
    places = numbered[0].unionByName(numbered[1]).select(
        "basket",
        "looked_up",
        F.shiftright("number", 6).alias("word"),
        F.expr("shiftleft(1L, CAST(number & 63 AS INT))").alias("bit"),
    )
    return written(places, "places"), reach


def _bitmaps(baskets, places):
    """item, level, looked_up, word and bits, stored."""
    levels = F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))).alias("level")
    marked = baskets.filter("weight > 0").join(places, "basket")
    marked = marked.select("item", levels, "looked_up", "word", "bit")
    return written(
        marked.groupBy("item", "level", "looked_up", "word").agg(F.bit_or("bit").alias("bits")),
        "bitmaps",
    )


def _common(a, b):
    return F.bit_count(F.col(a).bitwiseAND(F.col(b)))


def _pairs_of_words(bitmaps, part_width):
    """Pairs by the bits they share, word by word.

    The rows of a word are cut into parts; every row is paired against one part at
    a time, so the work of a word spreads over as many tasks as it has parts.
    """
    rows = bitmaps.filter("NOT looked_up").select("word", "item", "bits")
    sizes = rows.groupBy("word").agg(
        F.ceil(F.count("*") / F.lit(part_width)).cast("int").alias("parts")
    )
    rows = rows.join(sizes, "word")
    one_part = rows.withColumn("part", F.pmod(F.xxhash64("item"), "parts").cast("int"))
    all_parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    a, b = (
        side.select("word", "part", F.col("item").alias(f"item_{x}"), F.col("bits").alias(f"bits_{x}"))
        for side, x in ((one_part, "a"), (all_parts, "b"))
    )
    # Shuffled: by the size of the stored bitmaps one side, far larger than they, looks
    # small enough to be sent whole through the driver.
    met = a.join(b.hint("merge"), ["word", "part"]).filter(F.col("item_a") < F.col("item_b"))
    shared = met.select("item_a", "item_b", _common("bits_a", "bits_b").cast("long").alias("frequency"))
    return shared.filter("frequency > 0")


def _looked_up(found, bitmaps):
    """What the looked-up baskets add to the pairs found."""
    rows = bitmaps.filter("looked_up").select("item", "word", "bits")
    a = rows.withColumnsRenamed({"item": "item_a", "bits": "bits_a"})
    b = rows.withColumnsRenamed({"item": "item_b", "bits": "bits_b"})
    return (
        found.select("item_a", "item_b")
        .join(a, "item_a")
        .join(b, ["item_b", "word"])
        .select("item_a", "item_b", _common("bits_a", "bits_b").cast("long").alias("frequency"))
    )


def frequent_pairs(baskets, min_frequency, n=None, part_width=PART_WIDTH, narrow=NARROW):
    """(pairs, items) for stored baskets.

    ``pairs`` holds item_a < item_b and frequency for at least every pair that
    reaches ``min_frequency`` and, with ``n``, could rank among the n best by
    frequency, ties included. ``items`` holds item and its number of baskets.
    """
    items = baskets.groupBy("item").agg(
        F.count("*").alias("baskets"), F.sum("weight").alias("weight")
    )
    wide = _wide_baskets(baskets, narrow)
    names = wide.select("basket")
    need = min_frequency
    if n is not None:  # baskets of seeds have no more items than there are seeds
        need = max(need, _nth_best_seed(baskets, items, n))

    heaviest = baskets.agg(F.max("weight")).scalar()
    useful = items.filter(F.col("weight") * heaviest >= need).select("item")
    kept = baskets.join(useful, "item", "left_semi")
    if wide.isEmpty():
        pairs = _pairs_within(kept)
    else:
        places, reach = _places(wide, need)
        bitmaps = _bitmaps(kept, places)
        paired = _pairs_within(kept.join(names, "basket", "left_anti"))
        found = _summed(paired.unionByName(_pairs_of_words(bitmaps, part_width)))
        found = written(found.filter(F.col("frequency") >= need - reach), "pairs")
        pairs = _summed(found.unionByName(_looked_up(found, bitmaps)))
    return pairs.filter(F.col("frequency") >= need), items.select("item", "baskets")
