"""The semantic layer: facets of nodes in a basis of types, n-ary edges, and changes to both.

    types(type_gid, element_kind, is_abstract, required, fields, slots)
    facets(node_gid, type_gid, witness_gid)      relations(rel_gid, type_gid, attrs)
    members(rel_gid, role, participant_gid)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import names
from weft.operators import mutate, traverse
from weft.plans.session import by_size, cut, stored
from weft.sources.graph import PropertyGraph

FIELD = "struct<name: string, value_kind: string, data_type: string, min: int, max: int, is_collection: boolean, node_type: string>"
SLOT = "struct<name: string, allowed: array<string>, min: int, max: int>"
TYPES = f"type_gid string, element_kind string, is_abstract boolean, required array<string>, fields array<{FIELD}>, slots array<{SLOT}>"
FACETS = "node_gid string, type_gid string, witness_gid string"
RELATIONS = "rel_gid string, type_gid string, attrs map<string, string>"
MEMBERS = "rel_gid string, role string, participant_gid string"
CATALOG = "NodeTypes"
# The relation types of every catalog and their roles.
BUILT_IN = {"InstanceOf": ["Instance", "Type"], "Requires": ["Derived", "Required"]}


class SemanticError(ValueError):
    """A reading or a change that the semantic rules refuse."""


def _refuse(bad: DataFrame, why: str) -> None:
    rows = bad.limit(5).collect()
    if rows:
        raise SemanticError(f"{why}: " + ", ".join(str(tuple(r)) for r in rows))


# Types.


def catalog(types: DataFrame, roots: list[str] | DataFrame | None = None) -> DataFrame:
    """Types in the catalog, or those named (a list, or a table of one column), and all that they refer to; by gid, case ignored."""
    if isinstance(roots, DataFrame):
        start = types.join(roots.toDF("type_gid"), "type_gid", "left_semi")
    else:
        start = types.where(F.col("type_gid").isin(roots)) if roots else types.where(F.col("type_gid").startswith(CATALOG + "/"))
    refs = types.select(
        F.col("type_gid").alias("src"),
        F.explode(F.concat(
            "required", F.filter(F.transform("fields", lambda f: f["node_type"]), lambda x: x.isNotNull()),
            F.flatten(F.transform("slots", lambda s: s["allowed"]))
        )).alias("dst")
    )
    got = traverse.closure(start.select(F.col("type_gid").alias("item")), refs).select(F.col("reached").alias("type_gid")).distinct()
    return types.join(got, "type_gid", "left_semi").orderBy(F.lower("type_gid"))


def is_type(graph: PropertyGraph, gid: str) -> bool:
    return gid != CATALOG and not graph.neighbours_of(gid).where(F.col("dst") == CATALOG).isEmpty()


def closure(types: DataFrame) -> DataFrame:
    """type_gid, reached over ``required``."""
    arcs = types.select(F.col("type_gid").alias("src"), F.explode("required").alias("dst")).distinct()
    return traverse.closure(types.select(F.col("type_gid").alias("item")), arcs).select(F.col("item").alias("type_gid"), "reached")


def effective_slots(types: DataFrame) -> DataFrame:
    """type_gid, slots: explicit slots and those that node-valued fields stand for, over the closure, in one order whatever the partitions."""
    derived = F.transform(
        F.filter("fields", lambda f: f["value_kind"] == "Node"),
        lambda f: F.struct(
            f["name"].alias("name"),
            F.when(f["node_type"].isNotNull(), F.array(f["node_type"])).otherwise(F.array().cast("array<string>")).alias("allowed"),
            f["min"].alias("min"), f["max"].alias("max")
        )
    )
    own = types.select(F.col("type_gid").alias("reached"), F.array_distinct(F.concat("slots", derived.cast(f"array<{SLOT}>"))).alias("slots"))
    return closure(types).join(by_size(own), "reached").groupBy("type_gid").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("slots")))).alias("slots"))


def ambiguous_slots(types: DataFrame) -> DataFrame:
    """type_gid, name of slots that two different definitions in a closure give overlapping types."""
    each = effective_slots(types).select("type_gid", "slots", F.posexplode("slots").alias("i", "s"))
    later = F.slice("slots", F.col("i") + 2, F.size("slots"))  # a pair is looked at in one row, so no second reading of the slots can number them otherwise
    clash = F.exists(later, lambda t: (F.lower(t["name"]) == F.lower(F.col("s.name"))) & (
        F.arrays_overlap(t["allowed"], F.col("s.allowed")) | (F.size(t["allowed"]) == 0) | (F.size(F.col("s.allowed")) == 0)
    ))
    return each.where(clash).select("type_gid", F.col("s.name").alias("name")).distinct()


def create_types(types: DataFrame, rows: DataFrame) -> DataFrame:
    """types with new rows; names, references, kinds and slots must hold."""
    after = cut(types.unionByName(rows))
    _refuse(after.groupBy(F.lower("type_gid").alias("k")).count().where("count > 1"), "the type exists")
    _refuse(rows.where(~names.valid_path(F.col("type_gid"))).select("type_gid"), "no valid name")
    kinds = after.select(F.col("type_gid").alias("r"), F.col("element_kind").alias("rk"))
    need = rows.select("type_gid", "element_kind", F.explode("required").alias("r")).join(kinds, "r", "left")
    _refuse(need.where("rk is null or rk <> element_kind").select("type_gid", "r"), "requires no type of its kind")
    field_names = F.transform("fields", lambda f: F.lower(f["name"]))
    _refuse(rows.where(F.size(F.array_distinct(field_names)) < F.size("fields")).select("type_gid"), "field names repeat")
    _refuse(ambiguous_slots(after), "ambiguous slots")
    return after


def require(types: DataFrame, type_gid: str, required: str) -> DataFrame:
    """Add a requirement; a known one changes nothing, one that is stored twice is an error."""
    both = types.where(F.col("type_gid").isin(type_gid, required)).select("type_gid", F.size(F.filter("required", lambda x: x == required)).alias("n")).collect()
    times = {r["type_gid"]: r["n"] for r in both}  # two rows at most
    if set(times) != {type_gid, required}:
        raise LookupError("NotFound: both ends of a requirement must be types")
    if times[type_gid] > 1:
        raise SemanticError(f"'{type_gid}' requires '{required}' more than once")
    return types.withColumn("required", F.when(F.col("type_gid") == type_gid, F.array_union("required", F.array(F.lit(required)))).otherwise(F.col("required")))


def built_in(spark) -> DataFrame:
    """The relation types every catalog has: a node is an instance of a type, a type requires another."""
    role = lambda name: (name, "Node", None, 1, 1, False, None)
    rows = [(f"{CATALOG}/{name}", "Edge", False, [], [role(r) for r in roles], []) for name, roles in BUILT_IN.items()]
    return spark.createDataFrame(rows, TYPES)


def without_built_in(types: DataFrame) -> DataFrame:
    """Types that the strict contract shows."""
    return types.where(~F.col("type_gid").isin([f"{CATALOG}/{name}" for name in BUILT_IN]))


def bootstrap(types: DataFrame, runtime: DataFrame) -> DataFrame:
    """Runtime types merged into the stored ones; stored definitions win, running it twice changes nothing."""
    return types.unionByName(runtime.join(types.select("type_gid"), "type_gid", "left_anti"))


# Facets.


def project(graph: PropertyGraph, types: DataFrame, witnesses: DataFrame, basis: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """facets of nodes in a basis: witnessed ones, and those read off links between node and type.

    A witness outranks a link; two witnesses of one facet, or a required type without a facet, are
    errors when read.
    """
    seen = types.where(F.col("type_gid").isin(basis)) if basis else types.where(F.col("type_gid").startswith(CATALOG + "/"))
    seen = seen.select("type_gid", "required")
    link = graph.adj.where("kind = 'link'").select(F.col("src").alias("node_gid"), F.col("dst").alias("type_gid"))
    link = link.join(by_size(types.select(F.col("type_gid").alias("node_gid"))), "node_gid", "left_anti")
    every = witnesses.select("node_gid", "type_gid", "witness_gid").unionByName(link.withColumn("witness_gid", F.lit(None).cast("string"))).join(
        by_size(seen.select("type_gid")), "type_gid", "left_semi"
    )
    if only is not None:
        every = every.where(F.col("node_gid").isin(only))
    one = every.groupBy("node_gid", "type_gid").agg(F.count("witness_gid").alias("n"), F.max("witness_gid").alias("witness_gid"))
    one = one.select(
        "node_gid", "type_gid",
        F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("two witnesses of one facet: "), F.col("node_gid")))).otherwise(F.col("witness_gid")).alias("witness_gid")
    )
    if types.where(F.size("required") > 0).isEmpty():
        return one
    lacking = missing_facets(types, one).groupBy("node_gid").agg(F.min("type_gid").alias("_lacks"))
    told = F.raise_error(F.concat(F.lit("missing materialized required types: "), F.col("node_gid"), F.lit(" lacks "), F.col("_lacks")))
    return one.join(lacking, "node_gid", "left").select("node_gid", F.when(F.col("_lacks").isNotNull(), told).otherwise(F.col("type_gid")).alias("type_gid"), "witness_gid")


def missing_facets(types: DataFrame, facets: DataFrame) -> DataFrame:
    """node_gid, type_gid of required types (closure) that a node has no facet of."""
    need = facets.select("node_gid", "type_gid").join(by_size(closure(types)), "type_gid").select("node_gid", F.col("reached").alias("type_gid")).distinct()
    return need.join(facets.select("node_gid", "type_gid"), ["node_gid", "type_gid"], "left_anti")


def has_any_type(facets: DataFrame, allowed: list[str]) -> DataFrame:
    return facets.where(F.col("type_gid").isin(allowed)).select("node_gid").distinct()


def slot_violations(graph: PropertyGraph, types: DataFrame, facets: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """node_gid, type_gid, slot, n: slots whose number of typed neighbours is outside the cardinality; of all nodes or only(node_gid)."""
    own, near = facets.select("node_gid", "type_gid"), graph.neighbours
    if only is not None:
        only = only.select("node_gid").distinct()
        own, near = own.join(only, "node_gid", "left_semi"), near.join(only.withColumnRenamed("node_gid", "src"), "src", "left_semi")
    s = own.join(by_size(stored(effective_slots(types))), "type_gid").select("node_gid", "type_gid", F.explode("slots").alias("s")).select(
        "node_gid", "type_gid", F.col("s.name").alias("slot"), F.col("s.allowed").alias("allowed"), F.col("s.min").alias("lo"),
        F.col("s.max").alias("hi")
    )
    typed = near.join(
        facets.select(F.col("node_gid").alias("dst"), F.col("type_gid").alias("t")), "dst"
    ).groupBy("src", "dst").agg(F.collect_set("t").alias("ts"))
    hits = s.join(
        typed, s.node_gid == typed.src
    ).where((F.size("allowed") == 0) | F.arrays_overlap("allowed", "ts")).groupBy("node_gid", "type_gid", "slot").agg(F.count_distinct("dst").alias("n"))
    out = s.join(hits, ["node_gid", "type_gid", "slot"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.where((F.col("n") < F.col("lo")) | (F.col("hi").isNotNull() & (F.col("n") > F.col("hi")))).select("node_gid", "type_gid", "slot", "n")


def unsatisfied(graph: PropertyGraph, types: DataFrame, facets: DataFrame) -> DataFrame:
    """node_gid of nodes that lack a required facet or break a slot."""
    return missing_facets(types, facets).select("node_gid").unionByName(slot_violations(graph, types, facets).select("node_gid")).distinct()


def assign(graph: PropertyGraph, types: DataFrame, facets: DataFrame, rows: DataFrame) -> DataFrame:
    """facets after assigning types to nodes, rows(node_gid, type_gid): the closure is made, once.

    Each new facet gets a witness name; abstract types and ambiguous slots are refused. Only the new facets are written,
    and only the named nodes' slots are counted.
    """
    rows = cut(rows.select("node_gid", "type_gid"))
    _refuse(rows.join(types.where("is_abstract").select("type_gid"), "type_gid", "left_semi"), "an abstract type cannot be assigned")
    _refuse(rows.join(types.select("type_gid"), "type_gid", "left_anti"), "no such type")
    _refuse(ambiguous_slots(types).join(rows, "type_gid", "left_semi"), "ambiguous slots")
    _refuse(rows.join(graph.base.select(F.col("gid").alias("node_gid")), "node_gid", "left_anti"), "no such node")
    full = rows.join(closure(types), "type_gid").select("node_gid", F.col("reached").alias("type_gid")).distinct()
    new = full.join(facets, ["node_gid", "type_gid"], "left_anti")
    witness = names.relation_name(names.local_id(F.col("type_gid")), names.local_id(F.col("node_gid")))
    after = facets.unionByName(cut(new.select("node_gid", "type_gid", witness.alias("witness_gid"))))
    _refuse(slot_violations(graph, types, after, rows), "a slot is not filled as its cardinality asks")
    return after


# Edges.


@dataclass(frozen=True)
class Edges:
    relations: DataFrame
    members: DataFrame


def edge_definition(types: DataFrame) -> DataFrame:
    """type_gid, role, member_id, node_type, min, max of edge types with two or more node fields."""
    f = types.where("element_kind = 'Edge'").select(
        "type_gid", F.filter("fields", lambda x: x["value_kind"] == "Node").alias("f")
    ).where("size(f) >= 2").select("type_gid", F.explode("f").alias("f"))
    return f.select(
        "type_gid", F.col("f.name").alias("role"), names.member_id(F.col("type_gid"), F.col("f.name")).alias("member_id"),
        F.col("f.node_type").alias("node_type"), F.col("f.min").alias("min"), F.col("f.max").alias("max")
    )


def endpoint_violations(types: DataFrame, facets: DataFrame, edges: Edges) -> DataFrame:
    """rel_gid, role, message: roles, cardinalities and endpoint types of relations."""
    d = by_size(edge_definition(types))
    want = edges.relations.select("rel_gid", "type_gid").join(d, "type_gid")
    n = edges.members.groupBy("rel_gid", "role").agg(F.count_distinct("participant_gid").alias("n"))
    counted = want.join(n, ["rel_gid", "role"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    wrong = counted.where((F.col("n") < F.col("min")) | (F.col("max").isNotNull() & (F.col("n") > F.col("max")))).select(
        "rel_gid", "role", F.lit("cardinality").alias("message")
    )
    typed = edges.members.join(want.where("node_type is not null").select("rel_gid", "role", "node_type"), ["rel_gid", "role"])
    untyped = typed.join(
        facets.select(F.col("node_gid").alias("participant_gid"), F.col("type_gid").alias("node_type")), ["participant_gid", "node_type"],
        "left_anti"
    ).select("rel_gid", "role", F.lit("type").alias("message"))
    odd = edges.members.join(want.select("rel_gid", "role"), ["rel_gid", "role"], "left_anti").select("rel_gid", "role", F.lit("role").alias("message"))
    return wrong.unionByName(untyped).unionByName(odd)


def read_edge(types: DataFrame, edges: Edges, rel_gid: str) -> DataFrame:
    """role, participants of one relation, roles without participants too."""
    want = edges.relations.where(F.col("rel_gid") == rel_gid).join(edge_definition(types), "type_gid").select("rel_gid", "role")
    return want.join(edges.members, ["rel_gid", "role"], "left").groupBy("role").agg(F.array_sort(F.collect_set("participant_gid")).alias("participants"))


def add_relations(types: DataFrame, facets: DataFrame, edges: Edges, relations: DataFrame, members: DataFrame) -> Edges:
    """edges with new rows, which alone are checked and written."""
    new = Edges(cut(relations), cut(members))
    _refuse(endpoint_violations(types, facets, new), "a relation breaks its type")
    return Edges(edges.relations.unionByName(new.relations), edges.members.unionByName(new.members))


def settled_edges(edges: Edges) -> Edges:
    """The same relations from tables of their own, after many changes."""
    return Edges(cut(edges.relations), cut(edges.members))


def change_edge_type(
    graph: PropertyGraph, types: DataFrame, facets: DataFrame, edges: Edges, type_gid: str, roles: dict[str, list[str]], rel_gid: str
) -> tuple[PropertyGraph, Edges]:
    """Make a typed relation of a raw edge, or of the one relation that has the same participants."""
    people = sorted(p for ps in roles.values() for p in ps)
    near = edges.members.where(F.col("participant_gid") == people[0]).select("rel_gid").distinct() if people else edges.members.select("rel_gid").limit(0)
    same = edges.members.join(near, "rel_gid", "left_semi").groupBy("rel_gid").agg(F.array_sort(F.collect_list("participant_gid")).alias("all")).where(F.col("all") == F.array(*(F.lit(p) for p in people)))
    old = [r["rel_gid"] for r in same.limit(2).collect()]
    if len(old) > 1:
        raise SemanticError("several relations have these participants")
    kept = Edges(edges.relations.where(~F.col("rel_gid").isin(old)), edges.members.where(~F.col("rel_gid").isin(old))) if old else edges
    rows = [(rel_gid, role, p) for role, ps in roles.items() for p in ps]
    after = add_relations(types, facets, kept, graph.spark.createDataFrame([(rel_gid, type_gid, {})], RELATIONS), graph.spark.createDataFrame(rows, MEMBERS))
    if len(people) == 2:
        graph = mutate.disconnect(graph, *people) if not (people[1].startswith(people[0] + "/")) else graph
    return graph, after


def delete_nodes(graph: PropertyGraph, edges: Edges, gids: list[str]) -> tuple[PropertyGraph, Edges]:
    """Drop nodes and, first, every relation in which they or relations so dropped take part; only what goes is written."""
    gone = cut(graph.spark.createDataFrame([(g,) for g in gids], "gid string"))
    while True:
        hit = edges.members.join(
            gone.withColumnRenamed("gid", "participant_gid"), "participant_gid", "left_semi"
        ).select(F.col("rel_gid").alias("gid")).distinct().join(gone, "gid", "left_anti")
        hit = cut(hit)
        if hit.isEmpty():
            break
        gone = cut(gone.unionByName(hit))
    rel = gone.withColumnRenamed("gid", "rel_gid")
    left = Edges(edges.relations.join(rel, "rel_gid", "left_anti"), edges.members.join(rel, "rel_gid", "left_anti"))
    return mutate.delete_subtrees(graph, gids), left


# The reified form: relation nodes, occurrence nodes below them, links to classifiers and participants.


def export_reified(edges: Edges) -> tuple[DataFrame, DataFrame]:
    """(nodes(gid, attrs), links(a_gid, b_gid)) that stand for the relations in a carrier graph."""
    role_gid = F.concat_ws("/", "rel_gid", names.member_id(F.col("type_gid"), F.col("role")))
    m = edges.members.join(edges.relations.select("rel_gid", "type_gid"), "rel_gid")
    none = F.create_map().cast("map<string,string>")
    nodes = edges.relations.select(F.col("rel_gid").alias("gid"), F.coalesce("attrs", none).alias("attrs")).unionByName(m.select(
        role_gid.alias("gid"), F.create_map(F.lit("role"), F.col("role")).alias("attrs")
    ).dropDuplicates(["gid"]))
    pair = lambda df, a, b: df.select(F.least(a, b).alias("a_gid"), F.greatest(a, b).alias("b_gid"))
    links = pair(edges.relations, F.col("rel_gid"), F.col("type_gid")).unionByName(pair(m, role_gid, F.col("participant_gid"))).distinct()
    return nodes, links


def import_reified(graph: PropertyGraph, types: DataFrame) -> Edges:
    """Relations read from a carrier graph: the node of one edge type, its occurrences, their neighbours.

    A relation with two classifiers in the catalog is an error when read.
    """
    d = edge_definition(types)
    link = graph.adj.where("kind = 'link'").select("src", "dst")
    of_type = link.join(by_size(d.select(F.col("type_gid").alias("dst")).distinct()), "dst", "left_semi")
    rel = of_type.join(by_size(types.select(F.col("type_gid").alias("src"))), "src", "left_anti")
    rel = rel.groupBy(F.col("src").alias("rel_gid")).agg(F.count_distinct("dst").alias("n"), F.min("dst").alias("t"))
    rel = stored(rel.select("rel_gid", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("several classifiers: "), F.col("rel_gid")))).otherwise(F.col("t")).alias("type_gid")))
    # Occurrences lie below relations and have one of few names, so other nodes and other nodes' links are not moved.
    member = by_size(d.select("type_gid", "member_id", "role"))
    named = by_size(d.select("member_id").distinct())
    occ = graph.nodes.where("parent_gid is not null").select(F.col("gid").alias("occ"), F.col("parent_gid").alias("rel_gid"), F.col("local_id").alias("member_id"))
    occ = occ.join(named, "member_id", "left_semi").join(rel, "rel_gid").join(member, ["type_gid", "member_id"])
    ends = link.select(F.col("src").alias("occ"), F.col("dst").alias("participant_gid"), names.local_id(F.col("src")).alias("member_id"))
    members = occ.select("occ", "rel_gid", "type_gid", "role").join(
        ends.join(named, "member_id", "left_semi").select("occ", "participant_gid"), "occ"
    ).where("participant_gid <> rel_gid and participant_gid <> type_gid").select("rel_gid", "role", "participant_gid").distinct()
    attrs = graph.base.select(F.col("gid").alias("rel_gid"), "attrs")
    return Edges(rel.join(attrs, "rel_gid").select("rel_gid", "type_gid", "attrs"), members)


def to_strict(types: DataFrame, facets: DataFrame, graph: PropertyGraph, edges: Edges) -> tuple[DataFrame, DataFrame]:
    """(types, elements) of the strict contract; types that it cannot say raise instead of being guessed.

    What the graph holds beside its relations is told by ``carrier.unsupported_elements``.
    """
    from weft.functions import scalars
    from weft.operators import carrier, typed

    typed.require_none(carrier.unsupported_types(types))
    kind = F.lit(None).cast("string")
    for alias in scalars.ALIASES:
        try:
            kind = F.when(F.lower(F.element_at(F.split(F.col("f.data_type"), r"\."), -1)) == alias, scalars.kind_of(alias)).otherwise(kind)
        except NotImplementedError:
            continue
    f = types.select("type_gid", F.explode("fields").alias("f"))
    attribute = f.where("f.value_kind <> 'Node'").select(
        "type_gid",
        F.struct(
            F.col("f.name").alias("name"),
            F.coalesce(kind, F.raise_error(F.concat(F.lit("Unsupported: no scalar kind for "), F.col("f.name")))).alias("kind"),
            (F.col("f.min") > 0).alias("required")
        ).alias("a")
    )
    attribute = attribute.groupBy("type_gid").agg(F.array_sort(F.collect_list("a")).alias("attributes"))
    member = f.where("f.value_kind = 'Node'").join(
        types.where("element_kind = 'Edge'").select("type_gid"), "type_gid", "left_semi"
    ).groupBy("type_gid").agg(F.array_sort(F.collect_list(F.struct(
        F.col("f.name").alias("name"), F.col("f.node_type").alias("type_id"), F.col("f.min").alias("min"), F.col("f.max").alias("max")
    ))).alias("members"))
    spark = types.sparkSession
    shape = spark.createDataFrame([], typed.TYPES).schema
    out = types.join(attribute, "type_gid", "left").join(member, "type_gid", "left").select(
        F.col("type_gid").alias("type_id"), F.when(
            F.col("element_kind") == "Edge", typed.RELATION
        ).otherwise(typed.INSTANCE).alias("kind"), "is_abstract", F.col("required").alias("required_type_ids"),
        F.coalesce("members", F.array().cast(shape["members"].dataType)).alias("members"), F.coalesce(
            "attributes", F.array().cast(shape["attributes"].dataType)
        ).alias("attributes"),
    )
    inst = facets.groupBy("node_gid").agg(F.array_sort(F.collect_set("type_gid")).alias("type_ids")).join(graph.base, F.col("node_gid") == F.col("gid")).select(
        F.col("node_gid").alias("id"), F.lit(typed.INSTANCE).alias("kind"), "type_ids", F.col("attrs").alias("attributes"),
        F.create_map().cast("map<string,array<string>>").alias("members")
    )
    roles = edges.members.groupBy("rel_gid", "role").agg(F.array_sort(F.collect_set("participant_gid")).alias("ps")).groupBy("rel_gid").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "ps")))).alias("members")
    )
    rels = edges.relations.join(roles, "rel_gid", "left").select(
        F.col("rel_gid").alias("id"), F.lit(typed.RELATION).alias("kind"), F.array("type_gid").alias("type_ids"),
        F.col("attrs").alias("attributes"), F.coalesce("members", F.create_map().cast("map<string,array<string>>")).alias("members")
    )
    return out, inst.unionByName(rels)
