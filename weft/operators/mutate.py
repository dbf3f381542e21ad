"""Changes to a property graph: each gives a new graph, or raises when a rule would break.

Rules are checked by queries over the change and what it touches; nothing is written in place. Only
the change itself is written: the new graph is the old one with rows added or left out, so a change
costs what it touches, not the graph. ``settled`` writes a graph after many changes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import names
from weft.plans.session import cut
from weft.sources.graph import ATTRS, PropertyGraph


class GraphError(ValueError):
    """A change that the graph's rules refuse."""


def _refuse(bad: DataFrame, why: str) -> None:
    rows = bad.limit(5).collect()
    if rows:
        raise GraphError(f"{why}: " + ", ".join(str(tuple(r)) for r in rows))


def create_nodes(graph: PropertyGraph, rows: DataFrame) -> PropertyGraph:
    """rows(gid, attrs): parents exist or come along; an existing node keeps its attributes."""
    _refuse(rows.where(~names.valid_path(F.col("gid"))).select("gid"), "no valid name")
    every = graph.base.unionByName(rows.select("gid", "attrs"))
    orphans = rows.select(names.parent(F.col("gid")).alias("p"), "gid").where("p is not null").join(every.select(F.col("gid").alias("p")), "p", "left_anti")
    _refuse(orphans.select("gid"), "the parent does not exist")
    fresh = rows.select("gid", F.coalesce("attrs", F.create_map().cast(ATTRS)).alias("attrs")).dropDuplicates(["gid"]).join(graph.base, "gid", "left_anti")
    return PropertyGraph(graph.base.unionByName(cut(fresh)), graph.links)


def settled(graph: PropertyGraph) -> PropertyGraph:
    """The same graph from tables of its own, without the changes that led to it."""
    return PropertyGraph(cut(graph.base), cut(graph.links), graph.unique)


def update_attributes(graph: PropertyGraph, rows: DataFrame) -> PropertyGraph:
    """rows(gid, attrs) replace whole maps; nodes that do not exist are passed over, a gid that comes twice is refused."""
    _refuse(rows.groupBy("gid").count().where("count > 1"), "a node is named twice")
    new = cut(rows.select("gid", F.coalesce("attrs", F.create_map().cast(ATTRS)).alias("attrs")).join(graph.base.select("gid"), "gid", "left_semi"))
    return PropertyGraph(graph.base.join(new, "gid", "left_anti").unionByName(new), graph.links)


def with_attribute(attrs: Column, key: str, value: str) -> Column:
    """attrs with a key set; its spelling is the one given now."""
    return F.map_concat(without_attribute(attrs, key), F.create_map(F.lit(key), F.lit(value)))


def without_attribute(attrs: Column, key: str) -> Column:
    return F.map_filter(attrs, lambda k, _: F.lower(k) != key.lower())


def slot_clashes(graph: PropertyGraph, links: DataFrame) -> DataFrame:
    """owner, local id of two different neighbours that share a local id, case ignored."""
    touched = links.select(F.explode(F.array("a_gid", "b_gid")).alias("src")).distinct()
    after = PropertyGraph(graph.base, graph.links.unionByName(links.select("a_gid", "b_gid")))
    near = after.adj.join(touched, "src", "left_semi")
    slots = near.select("src", F.lower(names.local_id(F.col("dst"))).alias("slot"), "dst").distinct()
    return slots.groupBy("src", "slot").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("src", "slot")


def connect(graph: PropertyGraph, rows: DataFrame) -> PropertyGraph:
    """rows(a_gid, b_gid): self links and missing ends are passed over; duplicates, ancestor links and taken slots refused."""
    gid = graph.base.select("gid")
    pair = rows.select(F.least("a_gid", "b_gid").alias("a_gid"), F.greatest("a_gid", "b_gid").alias("b_gid")).where("a_gid <> b_gid")
    pair = pair.join(gid, F.col("a_gid") == F.col("gid"), "left_semi").join(gid, F.col("b_gid") == F.col("gid"), "left_semi")
    _refuse(pair.where(names.is_descendant(F.col("b_gid"), F.col("a_gid")) | names.is_descendant(F.col("a_gid"), F.col("b_gid"))), "an ancestor cannot be linked")
    stored = graph.links.select(F.least("a_gid", "b_gid").alias("a_gid"), F.greatest("a_gid", "b_gid").alias("b_gid"))
    _refuse(
        pair.groupBy("a_gid", "b_gid").count().where("count > 1").unionByName(
            pair.join(stored, ["a_gid", "b_gid"], "left_semi").withColumn("count", F.lit(2).cast("long"))
        ),
        "the link exists"
    )
    pair = cut(pair)
    _refuse(slot_clashes(graph, pair), "a neighbour has this local id")
    return PropertyGraph(graph.base, graph.links.unionByName(pair))


def disconnect(graph: PropertyGraph, a: str, b: str) -> PropertyGraph:
    """Drop a link; between parent and child, move the child to its one other neighbour."""
    short, long = sorted((a, b), key=len)
    if long.startswith(short + "/"):
        if long.count("/") > short.count("/") + 1:
            raise GraphError("only a parent and its child can be disconnected")
        return relocate(graph, long)
    low, high = sorted((a, b))
    return PropertyGraph(graph.base, graph.links.where(~((F.least("a_gid", "b_gid") == low) & (F.greatest("a_gid", "b_gid") == high))))


def relocate(graph: PropertyGraph, gid: str) -> PropertyGraph:
    """Move a subtree under its only neighbour outside the hierarchy."""
    near = [r["dst"] for r in graph.adj.where((F.col("src") == gid) & (F.col("kind") == "link")).select("dst").distinct().limit(2).collect()]
    if len(near) != 1:
        raise GraphError(f"'{gid}' has {'no' if not near else 'more than one'} neighbour to move to")
    return move(graph, gid, f"{near[0]}/{gid.rsplit('/', 1)[-1]}")


def move(graph: PropertyGraph, old: str, new: str) -> PropertyGraph:
    """Rewrite a path prefix in nodes and links; a link that would join ancestor and descendant is refused.

    The node and its new parent must exist, and its new place must be free. The rules are read off the links that
    change and the nodes at the three places, in one job.
    """
    if new == old or new.startswith(old + "/"):
        raise GraphError("a subtree cannot move into itself")
    go = lambda c: names.moved(F.col(c), F.lit(old), F.lit(new))
    inside = lambda c: (F.col(c) == old) | names.is_descendant(F.col(c), F.lit(old))
    parent = new.rsplit("/", 1)[0] if "/" in new else None
    changed = graph.links.where(inside("a_gid") | inside("b_gid"))
    links = changed.select(F.least(go("a_gid"), go("b_gid")).alias("a_gid"), F.greatest(go("a_gid"), go("b_gid")).alias("b_gid"))
    if parent is not None:  # the link to the new parent becomes the hierarchy edge
        links = links.where(~(F.col("a_gid").isin(parent, new) & F.col("b_gid").isin(parent, new)))
    links = cut(links)
    ends = [x for x in (old, new, parent) if x is not None]
    there = graph.base.where(F.col("gid").isin(ends)).agg(*(F.count_if(F.col("gid") == x).alias(f"n{k}") for k, x in enumerate(ends)))
    faults = [F.when(F.col("n0") == 0, F.lit("the node does not exist")), F.when(F.col("n1") > 0, F.lit("the place is taken"))]
    faults += [F.when(F.col("n2") == 0, F.lit("the new parent does not exist"))] if parent is not None else []
    taken = there.select(F.explode(F.array(*faults)).alias("why"), F.lit(old).alias("a"), F.lit(new).alias("b")).where("why is not null")
    joined = links.where(names.is_descendant(F.col("b_gid"), F.col("a_gid")) | names.is_descendant(F.col("a_gid"), F.col("b_gid")))
    _refuse(
        taken.unionByName(joined.select(F.lit("a link would join a node with its ancestor").alias("why"), F.col("a_gid").alias("a"), F.col("b_gid").alias("b"))),
        "the subtree cannot move"
    )
    kept = graph.links.where(~(inside("a_gid") | inside("b_gid")))
    return PropertyGraph(graph.base.select(go("gid").alias("gid"), "attrs"), kept.unionByName(links))


def delete_subtrees(graph: PropertyGraph, gids: list[str]) -> PropertyGraph:
    """Drop nodes with all below them and every link into them; links are not followed."""
    if any(not g for g in gids):
        raise GraphError("the root cannot be deleted")
    inside = lambda c: reduce(Column.__or__, ((c == g) | names.is_descendant(c, F.lit(g)) for g in gids))
    return PropertyGraph(graph.base.where(~inside(F.col("gid"))), graph.links.where(~(inside(F.col("a_gid")) | inside(F.col("b_gid")))))


def add_neighbour(graph: PropertyGraph, owner: str, gid: str) -> PropertyGraph:
    """Link an existing node to owner; a neighbour of that name is an error."""
    if graph.neighbour(owner, gid.rsplit("/", 1)[-1]).count():
        raise GraphError(f"'{owner}' has this neighbour")
    return connect(graph, graph.spark.createDataFrame([(owner, gid)], "a_gid string, b_gid string"))


def remove_neighbour(graph: PropertyGraph, owner: str, gid: str) -> PropertyGraph:
    """Delete the neighbour when owner is its only one, else disconnect the two."""
    near = [r["dst"] for r in graph.neighbours_of(gid).limit(2).collect()]
    if owner not in near and not graph.neighbours_of(gid).where(F.col("dst") == owner).count():
        raise GraphError(f"'{gid}' is no neighbour of '{owner}'")
    return delete_subtrees(graph, [gid]) if near == [owner] else disconnect(graph, owner, gid)


def clear_neighbours(graph: PropertyGraph, owner: str) -> PropertyGraph:
    """Remove every neighbour below or beside owner, as remove_neighbour does, all at once."""
    near = graph.adj.where((F.col("src") == owner) & ~names.is_descendant(F.lit(owner), F.col("dst"))).select(F.col("dst").alias("gid")).distinct()
    around = graph.adj.join(near.select(F.col("gid").alias("src")), "src", "left_semi").groupBy("src").agg(F.count_distinct("dst").alias("n"))
    gone = cut(around.where("n = 1").select(F.col("src").alias("top")))
    # A node goes with all below it: its path or one of its ancestors' is gone.
    inside = graph.base.select(
        "gid", F.explode(F.concat(names.ancestors(F.col("gid")), F.array("gid"))).alias("top")
    ).join(gone, "top", "left_semi").select("gid").distinct()
    inside = cut(inside)
    left = graph.base.join(inside, "gid", "left_anti")
    links = graph.links.where((F.col("a_gid") != owner) & (F.col("b_gid") != owner))
    for end in ("a_gid", "b_gid"):
        links = links.join(inside.withColumnRenamed("gid", end), end, "left_anti")
    return PropertyGraph(left, links.select("a_gid", "b_gid"))


def attach(graph: PropertyGraph, parent: str, staged: PropertyGraph) -> PropertyGraph:
    """Write nodes and links built apart under a stored parent."""
    under = lambda c: F.concat(F.lit(parent + "/"), F.col(c))
    out = create_nodes(graph, staged.base.select(under("gid").alias("gid"), "attrs"))
    return connect(out, staged.links.select(under("a_gid").alias("a_gid"), under("b_gid").alias("b_gid")))
