"""Bounded reachability, subgraphs, closures and components as frontier loops.

The adjacency is placed by its source once (``sources.placed``), and every round joins that: few frontier rows are
named in the scan, a small frontier comes by broadcast, a large one is moved to the buckets. A round's result is cut
off from its lineage, so plans stay small and a lost executor costs one round.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.plans.session import by_size, cut, stored
from weft.sources.graph import PropertyGraph
from weft.sources.placed import Grown, Placed


def reach(adj: DataFrame | Placed, sources: DataFrame, min_depth: int, max_depth: int, include_self: bool = False) -> DataFrame:
    """src, dst, dist: shortest distances in [min_depth, max_depth] from ``sources(gid)``.

    The start itself comes at distance 0 only with include_self and min_depth 0.
    """
    start = sources.select(F.col("gid").alias("src"), F.col("gid").alias("dst"), F.lit(0).alias("dist"))
    if max_depth <= 0:
        return start if include_self and min_depth == 0 else start.where("false")
    if max_depth == 1 and isinstance(adj, DataFrame):
        near = adj.join(sources.select(F.col("gid").alias("src")), "src").where("src <> dst").select("src", "dst", F.lit(1).alias("dist")).distinct()
        levels = [start, near]
    else:
        levels = _levels(adj if isinstance(adj, Placed) else Placed(adj), cut(start), max_depth)
    low = max(min_depth, 0)
    out = [x for k, x in enumerate(levels) if k >= low and (k > 0 or include_self)]
    return reduce(DataFrame.unionByName, out) if out else start.where("false")


def _levels(adj: Placed, start: DataFrame, max_depth: int) -> list[DataFrame]:
    """The pairs at each distance, until none are new."""
    levels, frontier, size = [start], start, start.count()
    for d in range(1, max_depth + 1):
        met = reduce(DataFrame.unionByName, levels[-2:])  # undirected: a next node is met one or two levels up, or new
        near = adj.near(frontier.select("src", "dst"), "dst", size).select("src", F.col("next").alias("dst")).distinct()
        frontier = cut(near.join(met.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("dist", F.lit(d)))
        size = frontier.count()
        if not size:
            break
        levels.append(frontier)
    return levels


def in_order(far: DataFrame) -> DataFrame:
    """src, dst, dist, ord: a source's rows as a search meets them, by distance, then by gid, from 0.

    Positions are counted in sorted ranges, whose row counts per source are summed up, so a source of very many rows is
    ranked by many tasks.
    """
    by = ["src", "dist", "dst"]
    ranged = cut(far.select(*by).repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("src", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("src", "_part", (F.sum("_n").over(W.partitionBy("src").orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(W.partitionBy("_part", "src").orderBy("dist", "dst")) - 1
    return ranged.withColumn("_place", place).join(before, ["src", "_part"]).select("src", "dst", "dist", (F.col("_before") + F.col("_place")).cast("long").alias("ord"))


#: So many sources share a row of a search from many: one bit of a number each.
WORD = 63


def reach_in_order(adj: Placed, sources: DataFrame, min_depth: int, max_depth: int) -> DataFrame:
    """src, dst, dist, ord: as ``in_order`` of ``reach`` from ``sources(gid)``, the start itself left out.

    Where sources reach the same nodes, a row for each pair is moved and written in every round. Here a row is a node, a
    distance and the set of those of ``WORD`` sources that are so far away; pairs are made where they are ranked, and not moved.
    """
    each = cut(sources.select("gid").distinct())
    ranged = each.repartitionByRange("gid").withColumn("_part", F.spark_partition_id())
    ids = _numbered(cut(ranged))
    start = cut(ids.select(F.col("gid").alias("dst"), F.expr(f"id div {WORD}").alias("block"), F.expr(f"shiftleft(1L, cast(id % {WORD} as int))").alias("mask")))
    levels, frontier, size = [start], start, start.count()
    for d in range(1, max_depth + 1):
        met = reduce(DataFrame.unionByName, levels[-2:]).groupBy("dst", "block").agg(F.bit_or("mask").alias("met"))
        near = adj.near(frontier, "dst", size).groupBy(F.col("next").alias("dst"), "block").agg(F.bit_or("mask").alias("mask"))
        fresh = near.join(met, ["dst", "block"], "left").withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("met", F.lit(0).cast("long")))))
        frontier = cut(fresh.where("mask <> 0").select("dst", "block", "mask"))
        size = frontier.count()
        if not size:
            break
        levels.append(frontier)
    far = [x.withColumn("dist", F.lit(k)) for k, x in enumerate(levels) if k >= max(min_depth, 1)]
    far = reduce(DataFrame.unionByName, far) if far else start.withColumn("dist", F.lit(0)).where("false")
    n = int(adj.written.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by its bytes a table of sets looks too small to share out
    ranged = cut(far.repartitionByRange(n, "dist", "dst", "block").withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part", "block").agg(*(F.sum(F.expr(f"shiftright(mask, {k}) & 1")).alias(str(k)) for k in range(WORD)))
    counts = counts.select("_part", F.posexplode(F.array(*(str(k) for k in range(WORD)))).alias("k", "n"), "block").where("n > 0")
    before = counts.select("_part", (F.col("block") * WORD + F.col("k")).alias("id"), (F.sum("n").over(W.partitionBy("block", "k").orderBy("_part")) - F.col("n")).alias("_before"))
    placed = ranged.repartition(n, "_part").sortWithinPartitions("_part", "dist", "dst", "block").select("_part", "dst", "dist", "block", "mask")
    pairs = placed.mapInArrow(_places, "id bigint, _part int, dst string, dist int, place bigint")
    named = pairs.join(by_size(cut(before)), ["id", "_part"]).join(by_size(ids), "id")
    return named.select(F.col("gid").alias("src"), "dst", "dist", (F.col("_before") + F.col("place")).alias("ord"))


def _numbered(ranged: DataFrame) -> DataFrame:
    """gid and id, from 0 without gaps, of gid in sorted ranges."""
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(W.partitionBy("_part").orderBy("gid")) - 1
    return cut(ranged.withColumn("_place", place).join(F.broadcast(before), "_part").select("gid", (F.col("_before") + F.col("_place")).alias("id")))


def _places(batches):
    """A row for each source of a set, and how many of that source stand before it in its range; rows come sorted by range and order."""
    part, seen = None, {}
    for batch in batches:
        parts, block, mask = (batch.column(k).to_numpy() for k in (0, 3, 4))
        edges = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)] if len(parts) else [0]
        for lo, hi in zip(edges, edges[1:]):
            if parts[lo] != part:
                part, seen = parts[lo], {}
            for a in range(lo, hi, 4096):
                row, bit = np.nonzero((mask[a : min(a + 4096, hi), None] >> np.arange(WORD)) & 1)
                ids = block[row + a] * WORD + bit
                by = np.argsort(ids, kind="stable")
                known, first, n = np.unique(ids[by], return_index=True, return_counts=True)
                place = np.empty(len(ids), np.int64)
                place[by] = np.arange(len(ids)) - np.repeat(first, n) + np.repeat([seen.get(i, 0) for i in known.tolist()], n).astype(np.int64)
                seen.update((i, seen.get(i, 0) + k) for i, k in zip(known.tolist(), n.tolist()))
                of = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), *(batch.column(k).take(of) for k in (0, 1, 2)), pa.array(place)], names=["id", "_part", "dst", "dist", "place"]
                )


def meet(adj: Placed, left: DataFrame, right: DataFrame, min_depth: int, max_depth: int, include_self: bool = False) -> tuple[DataFrame, int]:
    """(left, right, dist) of shortest distances in the range between left(gid) and right(gid), and the rows of all frontiers.

    Both sides walk half the depth and meet in the middle; the side whose frontier is smaller takes the next step. A
    shortest path of d steps has a node that is at most a steps from the left and d - a from the right for any split
    a, so the least sum over the nodes where the balls meet is the distance.
    """
    sides = []
    for ends in (left, right):
        start = cut(ends.select(F.col("gid").alias("src"), F.col("gid").alias("dst"), F.lit(0).alias("dist")).distinct())
        sides.append({"levels": [start], "size": start.count(), "rows": 0, "over": False})
    for _ in range(max_depth):
        side = min((s for s in sides if not s["over"]), key=lambda s: s["size"], default=None)
        if side is None:
            break
        frontier, d = side["levels"][-1], len(side["levels"])
        met = reduce(DataFrame.unionByName, side["levels"][-2:]).select("src", "dst")
        near = adj.near(frontier.select("src", "dst"), "dst", side["size"]).select("src", F.col("next").alias("dst")).distinct()
        frontier = cut(near.join(met, ["src", "dst"], "left_anti").withColumn("dist", F.lit(d)))
        size = frontier.count()
        side["rows"] += size
        if size:
            side["levels"].append(frontier)
            side["size"] = size
        else:  # nothing further away: this side's balls are whole, and the other's steps no longer matter
            side["over"] = True
            break
    a, b = (reduce(DataFrame.unionByName, s["levels"]) for s in sides)
    both = a.select(F.col("src").alias("left"), F.col("dst").alias("mid"), F.col("dist").alias("_a")).join(
        b.select(F.col("src").alias("right"), F.col("dst").alias("mid"), F.col("dist").alias("_b")), "mid"
    )
    least = both.groupBy("left", "right").agg(F.min(F.col("_a") + F.col("_b")).alias("dist"))
    low = min_depth if include_self else max(min_depth, 1)
    return least.where(F.col("dist").between(low, max_depth)), sum(s["rows"] for s in sides)


def subgraph(graph: PropertyGraph, roots: list[str] | None, max_depth: int) -> DataFrame:
    """Nodes within max_depth of any root: gid, dist; no roots means the top-level nodes.

    Any unknown root is an error; a negative depth counts as 0.
    """
    if not roots or roots == [""]:
        start = graph.roots().select("gid")
    else:
        start = graph.nodes.select("gid").where(F.col("gid").isin(roots)).distinct()
    start = cut(start.withColumn("dist", F.lit(0)))
    if roots and roots != [""]:
        known = {r["gid"] for r in start.select("gid").collect()}  # as many rows as the caller named roots
        missing = sorted(set(roots) - known)
        if missing:
            raise LookupError(f"NotFound: {', '.join(missing)}")
    if max_depth == 1 and not graph.is_placed:
        near = graph.adj.select(F.col("src").alias("gid"), "dst").join(start.select("gid"), "gid").select(F.col("dst").alias("gid")).distinct()
        return start.unionByName(near.join(start.select("gid"), "gid", "left_anti").withColumn("dist", F.lit(1)))
    levels = list(_spread(graph.placed, start, max_depth)) if max_depth > 0 else []
    return reduce(DataFrame.unionByName, [start, *levels])


def _spread(adj: Placed, start: DataFrame, max_depth: int | None = None):
    """gid, dist of what is new at each distance from ``start(gid, dist)``; a level is compared with the two before it."""
    last, size, d = [start], start.count(), 0
    while size and (max_depth is None or d < max_depth):
        d += 1
        near = adj.near(last[-1].select("gid"), "gid", size).select(F.col("next").alias("gid")).distinct()
        for level in last[-2:]:
            near = near.join(level.select("gid"), "gid", "left_anti")
        frontier = cut(near.withColumn("dist", F.lit(d)))
        size = frontier.count()
        if size:
            last = [last[-1], frontier]
            yield frontier


def traverse(graph: PropertyGraph, start: str) -> DataFrame:
    """Every node reachable from ``start``, once; order is not kept. A round writes what it found, no more."""
    first = cut(graph.get(start).select("gid", F.lit(0).alias("dist")))
    found = Grown(first)
    for level in _spread(graph.placed, first):
        found.add(level)
    return found.rows.select("gid")


def induced_edges(graph: PropertyGraph, gids: DataFrame) -> DataFrame:
    """Edges with both ends in gids(gid), one row for each unordered pair."""
    inside = gids.select("gid").distinct()
    e = graph.edges
    e = e.join(inside, e.a_gid == inside.gid, "left_semi").join(inside, F.col("b_gid") == inside.gid, "left_semi")
    return e.groupBy("a_gid", "b_gid").agg(F.min("kind").alias("kind"))


def common_neighbours(graph: PropertyGraph, gids: list[str]) -> DataFrame:
    """Nodes next to all of gids: relational division; an unknown gid is an error."""
    wanted = sorted(set(gids))
    known = graph.nodes.where(F.col("gid").isin(wanted)).count()
    if known < len(wanted):
        raise LookupError("NotFound: one of the nodes does not exist")
    near = graph.adj.where(F.col("src").isin(wanted)).groupBy("dst").agg(F.count_distinct("src").alias("n"))
    return near.where(F.col("n") == len(wanted)).select(F.col("dst").alias("gid"))


def components(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """gid, component (its least gid) of nodes(gid) under undirected pairs(src, dst).

    Least labels spread along edges and jump to their label's label, so the rounds follow the
    logarithm of a component's diameter in the usual case, not the diameter.
    """
    both = cut(pairs.select("src", "dst").unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    label = cut(nodes.select("gid", F.col("gid").alias("component")))
    while True:
        near = both.join(label.select(F.col("gid").alias("dst"), F.col("component").alias("c")), "dst").groupBy("src").agg(F.min("c").alias("c"))
        low = label.join(near.withColumnRenamed("src", "gid"), "gid", "left").select(
            "gid", F.col("component").alias("old"), F.least("component", F.coalesce("c", "component")).alias("component")
        )
        up = label.select(F.col("gid").alias("component"), F.col("component").alias("cc"))
        after = cut(low.join(up, "component", "left").select("gid", "old", F.least("component", F.coalesce("cc", "component")).alias("component")))
        label = after.select("gid", "component")
        if after.where("component <> old").isEmpty():
            return label


def closure(seeds: DataFrame, arcs: DataFrame) -> DataFrame:
    """item, reached: reflexive transitive closure of arcs(src, dst) from seeds(item); cycles end.

    Arcs and what was found go by broadcast only where they were counted and are few: by the bytes of their files
    millions of them look small, and would pass through the driver in every round.
    """
    frontier = cut(seeds.select("item", F.col("item").alias("reached")).distinct())
    found, near_by = Grown(frontier), by_size(stored(arcs.select("src", "dst")))
    while True:
        near = frontier.join(near_by, F.col("reached") == F.col("src")).select("item", F.col("dst").alias("reached")).distinct()
        frontier = cut(near.join(found.rows.hint("merge"), ["item", "reached"], "left_anti"))
        if frontier.isEmpty():
            return found.rows
        found.add(frontier)
