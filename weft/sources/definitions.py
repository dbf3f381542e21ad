"""Type definitions kept inside a graph: ``<type>/Definition`` with ``Fields`` and ``Slots`` below it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import names, text
from weft.operators import semantic
from weft.sources.graph import PropertyGraph

# Node names and attribute keys of the stored form.
DEFINITION, FIELDS, SLOTS = "Definition", "Fields", "Slots"
IS_ABSTRACT, ELEMENT_KIND, VALUE_KIND, DATA_TYPE = "isAbstract", "elementKind", "valueKind", "clrType"
MIN, MAX, IS_COLLECTION, NODE_TYPE, ALLOWED = "min", "max", "isCollection", "nodeTypePath", "allowedTypePaths"


def _attrs(**values):
    pairs = [x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def stored(types: DataFrame) -> DataFrame:
    """gid, attrs of the nodes that hold the definitions; slots that a field stands for are left out."""
    at = lambda *parts: F.concat_ws("/", "type_gid", *(F.lit(p) if p in (DEFINITION, FIELDS, SLOTS) else F.col(p) for p in parts))
    none = F.create_map().cast("map<string,string>")
    head = types.select(
        at(DEFINITION).alias("gid"),
        _attrs(**{IS_ABSTRACT: F.initcap(F.col("is_abstract").cast("string")), ELEMENT_KIND: F.col("element_kind")}).alias("attrs")
    )
    groups = types.select(F.explode(F.array(at(DEFINITION, FIELDS), at(DEFINITION, SLOTS))).alias("gid"), none.alias("attrs"))
    f = types.select("type_gid", F.explode("fields").alias("f"))
    fields = f.select(
        at(DEFINITION, FIELDS, "f.name").alias("gid"),
        _attrs(**{
            VALUE_KIND: F.col("f.value_kind"), DATA_TYPE: F.coalesce("f.data_type", F.lit("node")), MIN: F.col("f.min"),
            MAX: F.col("f.max"), IS_COLLECTION: F.initcap(F.col("f.is_collection").cast("string")), NODE_TYPE: F.col("f.node_type")
        }).alias("attrs")
    )
    same = f.where("f.value_kind = 'Node'").select(
        "type_gid", F.col("f.name").alias("n"), F.col("f.min").alias("lo"), F.col("f.max").alias("hi"),
        F.when(F.col("f.node_type").isNull(), F.array().cast("array<string>")).otherwise(F.array("f.node_type")).alias("al")
    )
    s = types.select("type_gid", F.explode("slots").alias("s")).select(
        "type_gid", "s", F.col("s.name").alias("n"), F.col("s.min").alias("lo"), F.col("s.max").alias("hi"),
        F.array_sort("s.allowed").alias("al")
    )
    alike = [s.type_gid == same.type_gid, s.n == same.n, s.lo == same.lo, s.hi.eqNullSafe(same.hi), s.al == same.al]
    slots = s.join(same, alike, "left_anti").select(
        at(DEFINITION, SLOTS, "s.name").alias("gid"),
        _attrs(**{MIN: F.col("s.min"), MAX: F.col("s.max"), ALLOWED: F.to_json("s.allowed")}).alias("attrs")
    )
    return head.unionByName(groups).unionByName(fields).unionByName(slots)


def read(graph: PropertyGraph, requires: DataFrame | None = None) -> DataFrame:
    """Types defined in the graph; requires(type_gid, required) comes from the relations of that type.

    A field or slot without its kind or least number is an error when it is read.
    """
    n = graph.nodes
    get = lambda key: text.lookup(F.col("attrs"), key)
    must = lambda key: F.coalesce(get(key), F.raise_error(F.concat(F.lit(f"'{key}' is missing in "), F.col("gid"))))
    flag = lambda key: F.coalesce(F.lower(F.trim(get(key))) == "true", F.lit(False))
    heads = n.where((F.col("local_id") == DEFINITION) & F.col("parent_gid").isNotNull()).select(
        F.col("parent_gid").alias("type_gid"), must(ELEMENT_KIND).alias("element_kind"), flag(IS_ABSTRACT).alias("is_abstract")
    )
    below = n.withColumn(
        "owner", names.parent(F.col("parent_gid"))
    ).where(names.local_id(F.col("owner")) == DEFINITION).withColumn("type_gid", names.parent(F.col("owner"))).withColumn(
        "part", names.local_id(F.col("parent_gid"))
    )
    high = F.when(F.trim(get(MAX)) != "", get(MAX).cast("int"))
    field = F.struct(
        F.col("local_id").alias("name"), must(VALUE_KIND).alias("value_kind"),
        F.when(F.lower(must(VALUE_KIND)) != "node", must(DATA_TYPE)).alias("data_type"), must(MIN).cast("int").alias("min"),
        high.alias("max"), flag(IS_COLLECTION).alias("is_collection"), get(NODE_TYPE).alias("node_type")
    )
    slot = F.struct(
        F.col("local_id").alias("name"),
        F.coalesce(F.from_json(get(ALLOWED), "array<string>"), F.array().cast("array<string>")).alias("allowed"),
        must(MIN).cast("int").alias("min"), high.alias("max")
    )
    fields = below.where(F.col("part") == FIELDS).groupBy("type_gid").agg(F.array_sort(F.collect_list(field)).alias("fields"))
    slots = below.where(F.col("part") == SLOTS).groupBy("type_gid").agg(F.array_sort(F.collect_list(slot)).alias("slots"))
    out = heads.join(fields, "type_gid", "left").join(slots, "type_gid", "left")
    if requires is not None:
        out = out.join(requires.groupBy("type_gid").agg(F.array_sort(F.collect_set("required")).alias("required")), "type_gid", "left")
    else:
        out = out.withColumn("required", F.lit(None).cast("array<string>"))
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    return out.select(
        "type_gid", "element_kind", "is_abstract", empty("required", "array<string>"), empty("fields", f"array<{semantic.FIELD}>"),
        empty("slots", f"array<{semantic.SLOT}>")
    )
