"""NTILE over a whole table.

A window without partitions sorts every row in one task. An n-tile split only
needs the rows at n-1 known ranks, and with those keys at hand each row finds
its tile by comparison, without a join or a shuffle of the rows.

The ranks are found by narrowing. A sample, taken by the hash of the row key,
brackets each rank of every order; exact counts over all rows confirm a bracket;
the next sample is of the rows inside it only, until the sample is all of them.
A bracket that counting refutes is taken again from a larger sample, so the
result never rests on the sample.
"""

import math
from dataclasses import dataclass, replace

from pyspark.sql import Window
from pyspark.sql import functions as F

#: Rows of a sample; a bracket with no more rows than that is ranked whole.
SAMPLE_ROWS = 20_000
#: Standard deviations of a sampled rank on either side of it.
MARGIN = 5


@dataclass(frozen=True)
class TileOrder:
    """Numeric column to rank by; the row key breaks ties."""

    column: str
    descending: bool = False


@dataclass(frozen=True)
class Bracket:
    """Rows of an order after key ``low`` up to key ``high``, which hold the ranks.

    ``before`` rows come up to ``low``, ``inside`` rows are in the bracket.
    """

    name: str
    ranks: tuple
    before: int
    inside: int
    low: tuple | None = None
    high: tuple | None = None


def _sort_keys(order, key):
    """Ascending, NULL-safe equivalents of the order, unique through the row key.

    Descending puts NULLs first, ascending puts them last.
    """
    value = F.col(order.column)
    if order.descending:
        keys = (value.isNotNull().cast("int"), -value)
    else:
        keys = (value.isNull().cast("int"), value)
    return (*keys, F.col(key).isNull().cast("int"), F.col(key))


def _as_struct(columns):
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(columns)])


class _Orders:
    """The sort keys of a table's orders as structs, and comparisons with given keys."""

    def __init__(self, df, orders, key):
        self.df, self.key = df, key
        self.structs = {name: _as_struct(_sort_keys(o, key)) for name, o in orders.items()}
        schema = df.select(*[s.alias(name) for name, s in self.structs.items()]).schema
        self.types = {field.name: field.dataType for field in schema}

    def beyond(self, name, keys):
        """Whether a row comes after ``keys``."""
        fields = self.types[name].fields
        limit = [F.lit(v).cast(f.dataType) for v, f in zip(keys, fields)]
        return self.structs[name] > _as_struct(limit)

    def inside(self, bracket):
        within = F.lit(True)
        if bracket.low is not None:
            within = within & self.beyond(bracket.name, bracket.low)
        if bracket.high is not None:
            within = within & ~self.beyond(bracket.name, bracket.high)
        return within

    def sampled(self, brackets, positions, sample_rows):
        """(bracket, position) → keys at these positions of each bracket's sample, in one job."""
        hashed = F.xxhash64(self.key).cast("double")
        taken = []
        for i, b in enumerate(brackets):
            share, within = _share(b, sample_rows), self.inside(b)
            if share < 1:
                within = within & (hashed < (2 * share - 1) * 2.0**63)
            taken.append(F.when(within, F.lit(i)))
        rows = self.df.select(
            F.explode(F.array_compact(F.array(*taken))).alias("bracket"),
            *[s.alias(f"o{i}") for i, s in enumerate(self.structs.values())],
        )
        own = []  # of a bracket's rows only the keys of its order count
        for i, name in enumerate(self.structs):
            mine = [j for j, b in enumerate(brackets) if b.name == name]
            own.append(F.when(F.col("bracket").isin(mine), F.col(f"o{i}")))
        place = F.row_number().over(Window.partitionBy("bracket").orderBy(*own))
        wanted = F.lit(False)
        for i, at in enumerate(positions):
            wanted = wanted | ((F.col("bracket") == i) & F.col("place").isin(sorted(at)))
        found = rows.withColumn("place", place).filter(wanted).collect()
        order_of = {name: i for i, name in enumerate(self.structs)}
        return {
            (r["bracket"], r["place"]): tuple(r[f"o{order_of[brackets[r['bracket']].name]}"])
            for r in found
        }

    def counted(self, brackets):
        """The brackets with their exact counts, in one job."""
        total = F.count("*")
        sides = []
        for b in brackets:
            for keys, none in ((b.low, F.lit(0)), (b.high, total)):
                sides.append(none if keys is None else F.count_if(~self.beyond(b.name, keys)))
        counts = self.df.agg(*[s.alias(f"c{i}") for i, s in enumerate(sides)]).first()
        return [
            replace(b, before=counts[2 * i], inside=counts[2 * i + 1] - counts[2 * i])
            for i, b in enumerate(brackets)
        ]


def _share(bracket, sample_rows):
    return 1.0 if bracket.inside <= sample_rows else sample_rows / bracket.inside


def _around(bracket, rank, sample_rows):
    """Positions in the sample that a rank lies between, but for a rare chance."""
    share = _share(bracket, sample_rows)
    if share == 1.0:
        return (rank - bracket.before,) * 2
    expected = (rank - bracket.before) * share
    spread = MARGIN * math.sqrt(expected * (1 - share)) + 1
    return math.floor(expected - spread), math.ceil(expected + spread)


def keys_at_ranks(table, ranks, total):
    """name of an order → its sort keys at the given 1-based ranks, in rank order.

    The driver holds two keys per bracket at a time.
    """
    sample_rows, found = SAMPLE_ROWS, {}
    brackets = [Bracket(name, tuple(ranks), 0, total) for name in table.structs] if ranks else []
    while brackets:
        around = [{r: _around(b, r, sample_rows) for r in b.ranks} for b in brackets]
        positions = [{p for pair in at.values() for p in pair} for at in around]
        keys = table.sampled(brackets, positions, sample_rows)
        narrower, parents = [], []
        for i, bracket in enumerate(brackets):
            for rank, (low, high) in around[i].items():
                if bracket.inside <= sample_rows:
                    found[bracket.name, rank] = keys[i, low]
                    continue
                low, high = keys.get((i, low), bracket.low), keys.get((i, high), bracket.high)
                narrower.append(replace(bracket, ranks=(rank,), low=low, high=high))
                parents.append(replace(bracket, ranks=(rank,)))
        brackets = []
        for bracket, parent in zip(table.counted(narrower) if narrower else [], parents):
            holds = bracket.before < bracket.ranks[0] <= bracket.before + bracket.inside
            if not holds or 2 * bracket.inside > parent.inside:
                sample_rows *= 2
            brackets.append(bracket if holds else parent)
    return {name: [found[name, r] for r in ranks] for name in table.structs}


def with_tiles(df, orders, key, tiles, total=None):
    """Add a 1..tiles column per entry of ``orders`` (name → TileOrder).

    ``key`` must be unique. ``df`` is read several times: pass a stored table, and
    its number of rows as ``total`` if that is known.
    """
    total = df.count() if total is None else total
    size, larger = divmod(total, tiles)
    last_ranks = [t * size + min(t, larger) for t in range(1, tiles)]
    table = _Orders(df, orders, key)
    bounds = keys_at_ranks(table, [r for r in last_ranks if r], total)
    added = {}
    for name in orders:
        # A tile that ends at rank 0 is empty: every row lies beyond it.
        tile = F.lit(1 + last_ranks.count(0))
        for bound in bounds[name]:
            tile = tile + table.beyond(name, bound).cast("int")
        added[name] = tile
    return df.withColumns(added)
