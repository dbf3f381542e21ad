"""Adjacency placed by its source: written once, then bucketed and sorted, so that joins move only their other side.

Placing moves and writes all of it, which a few frontiers that touch little are not worth: rows beside these are picked by
a filter of bits first, and moved alone.

A source of very many rows would make one bucket's task do its work alone. Such hubs are found first, by counts that are
summed up before any shuffle, and their rows lie in a second table, each hub dealt over several buckets.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.plans.session import SMALL, stored, stored_buckets

#: Rows of one source above which it is a hub, dealt over pieces of about so many rows.
HUB_ROWS = 1_000_000
#: Values of at most so many counted rows are named in the scan's filter, which then reads the files that may hold them.
FEW = 200
#: Numbers of 64 bits in a row of a filter of bits; it has at most ``SMALL`` rows.
LONGS = 16
#: Rows that frontiers may have moved, as a part of the adjacency, before it is bucketed.
MOVED = 0.25


def _bit(value) -> tuple:
    """(row, number, mask) of a value in a filter of bits."""
    more = F.xxhash64(value, F.lit(1))
    bit = F.pmod(F.shiftright(more, 8), F.lit(64)).cast("int")
    return F.pmod(F.xxhash64(value), F.lit(SMALL)), F.pmod(more, F.lit(LONGS)), F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def sieve(values: DataFrame, at: str) -> DataFrame:
    """A filter of bits of a column's values, of bounded size: small enough for a broadcast, whatever their number."""
    row, number, mask = _bit(F.col(at))
    bits = values.select(row.alias("_row"), number.alias("_number"), mask.alias("_mask"))
    return stored(bits.groupBy("_row").agg(*(F.bit_or(F.when(F.col("_number") == k, F.col("_mask")).otherwise(F.lit(0).cast("long"))).alias(f"_bits{k}") for k in range(LONGS))))


def sieved(df: DataFrame, by: str, bits: DataFrame) -> DataFrame:
    """The rows whose value is one of the filter's, and a few others; no row is moved."""
    row, number, mask = _bit(F.col(by))
    held = F.element_at(F.array(*(f"_bits{k}" for k in range(LONGS))), (number + 1).cast("int"))
    return df.join(F.broadcast(bits), row == F.col("_row")).where(held.bitwiseAND(mask) != 0).select(*df.columns)


def beside(df: DataFrame, size: int) -> DataFrame:
    """A table as the side of a join that may be broadcast, if its counted size allows."""
    return F.broadcast(df) if size <= SMALL else df


@dataclass(frozen=True)
class Buckets:
    """rows(src, dst) bucketed by src; hubs(src, pieces) and hub_rows(src, piece, dst) bucketed by both, or None."""

    rows: DataFrame
    hubs: DataFrame | None = None
    hub_rows: DataFrame | None = None

    @classmethod
    def of(cls, pairs: DataFrame, hub: int) -> "Buckets":
        if pairs.count() <= hub:  # no source can have more; counts of a written table are read off its footers
            return cls(stored_buckets(pairs, ["src"], ["dst"]))
        pieces = F.ceil(F.col("n") / hub).cast("int").alias("pieces")
        hubs = stored(pairs.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hub).select("src", pieces))
        if hubs.isEmpty():
            return cls(stored_buckets(pairs, ["src"], ["dst"]))
        dealt = pairs.join(hubs, "src").select("src", F.pmod(F.xxhash64("dst"), F.col("pieces")).cast("int").alias("piece"), "dst")
        return cls(stored_buckets(pairs.join(hubs, "src", "left_anti"), ["src"], ["dst"]), hubs, stored_buckets(dealt, ["src", "piece"], ["dst"]))


class Placed:
    """A written adjacency. Small frontiers come to it by broadcast; large ones have it placed in buckets, once, when they ask for much of it."""

    def __init__(self, pairs: DataFrame, hub: int = HUB_ROWS):
        self.written, self.hub, self.moved = stored(pairs.select("src", "dst")), hub, 0

    @cached_property
    def buckets(self) -> Buckets:
        return Buckets.of(self.written, self.hub)

    @property
    def pairs(self) -> DataFrame:
        """All of it: src, dst. In buckets once there are some: these are sorted, so a scan for few sources skips most."""
        if "buckets" not in self.__dict__:
            return self.written
        b = self.buckets
        return b.rows if b.hub_rows is None else b.rows.unionByName(b.hub_rows.select("src", "dst"))

    def near(self, frontier: DataFrame, at: str, size: int) -> DataFrame:
        """The frontier's columns and ``next``: the rows beside the column ``at``; size: the frontier's counted rows."""
        if size <= FEW:
            values = [r[0] for r in frontier.select(at).distinct().collect()]
            return self._joined(self.pairs.where(F.col("src").isin(values)), F.broadcast(frontier), at)
        if size <= SMALL:
            return self._joined(self.pairs, F.broadcast(frontier), at)
        if "buckets" not in self.__dict__:
            beside_it = sieved(self.written, "src", sieve(frontier, at))
            self.moved += beside_it.count()
            if self.moved <= MOVED * self.written.count():  # the latter is read off its footers
                return self._joined(beside_it.hint("merge"), frontier, at)
        b = self.buckets
        if b.hubs is None:
            return self._joined(b.rows, frontier, at)
        plain = frontier.join(b.hubs.select(F.col("src").alias(at)), at, "left_anti")
        spread = frontier.join(b.hubs.select(F.col("src").alias(at), "pieces"), at).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
        dealt = spread.join(b.hub_rows.select(F.col("src").alias(at), "piece", F.col("dst").alias("next")), [at, "piece"]).select(*frontier.columns, "next")
        return self._joined(b.rows, plain, at).unionByName(dealt)

    @staticmethod
    def _joined(pairs: DataFrame, frontier: DataFrame, at: str) -> DataFrame:
        hop = pairs.select(F.col("src").alias("_from"), F.col("dst").alias("next"))
        return hop.join(frontier, F.col("_from") == F.col(at)).select(*frontier.columns, "next")

    def degree(self) -> DataFrame:
        """src, degree; rows in buckets are counted where they lie."""
        count = lambda df: df.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
        if "buckets" not in self.__dict__:
            return count(self.written)
        b = self.buckets
        return count(b.rows) if b.hub_rows is None else count(b.rows).unionByName(count(b.hub_rows))


class Grown:
    """A table that grows by rounds; tables of like rank are merged, so each row is written again log(rounds) times at most."""

    def __init__(self, first: DataFrame):
        self.tables = [(0, first)]

    def add(self, df: DataFrame) -> None:
        self.tables.append((0, df))
        while len(self.tables) > 1 and self.tables[-1][0] == self.tables[-2][0]:
            (rank, a), (_, b) = self.tables[-2:]
            merged = a.unionByName(b)
            self.tables[-2:] = [(rank + 1, stored(merged) if rank >= 2 else merged)]  # unions of up to four stay plans

    @property
    def rows(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (t for _, t in self.tables))
