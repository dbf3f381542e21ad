"""The strict typed graph: types, instances, relations, and their integrity as queries.

Every rule is a query for its violations, rows of (id, code, message); a change is accepted when
the rows it adds violate nothing. Nothing is checked row by row on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.functions import names, scalars
from weft.operators import traverse
from weft.plans.session import by_size, cut, stored

TYPES = "type_id string, kind string, is_abstract boolean, required_type_ids array<string>, members array<struct<name: string, type_id: string, min: int, max: int>>, attributes array<struct<name: string, kind: string, required: boolean>>"
ELEMENTS = "id string, kind string, type_ids array<string>, attributes map<string, string>, members map<string, array<string>>"
INSTANCE, RELATION = "Instance", "Relation"
INVALID, NOT_FOUND, CONFLICT, UNSUPPORTED, CORRUPT = "Invalid", "NotFound", "Conflict", "Unsupported", "Corrupt"
#: Fixed value: HTTP status of each class of error.
STATUS = {INVALID: 400, NOT_FOUND: 404, CONFLICT: 409, UNSUPPORTED: 501, CORRUPT: 500}
# Type ids the semantic layer keeps for itself.
RESERVED = ["InstanceOf", "Requires", "Definition", "Fields", "Slots"]
_SHOWN = 20


class ContractError(ValueError):
    def __init__(self, code: str, rows: list):
        super().__init__(f"{code}: " + "; ".join(f"{r['id']}: {r['message']}" for r in rows))
        self.code, self.rows, self.status = code, rows, STATUS[code]


def require_none(violations: DataFrame) -> None:
    """Raise with the first few violations, if there are any."""
    rows = violations.orderBy("id", "code", "message").limit(_SHOWN).collect()
    if rows:
        raise ContractError(rows[0]["code"], rows)


def _bad(df: DataFrame, test: Column, identifier: str, code: str, message: str | Column) -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return df.where(test).select(F.col(identifier).alias("id"), F.lit(code).alias("code"), text.alias("message"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _low(array: Column) -> Column:
    return F.transform(array, lambda x: F.lower(x))


def _repeats(array: Column) -> Column:
    return F.size(F.array_distinct(_low(array))) < F.size(array)


def closure(types: DataFrame) -> DataFrame:
    """type_id, reached: each type with all it requires, itself included; diamonds once, cycles end."""
    arcs = types.select(F.col("type_id").alias("src"), F.explode("required_type_ids").alias("dst")).distinct()
    return traverse.closure(types.select(F.col("type_id").alias("item")), arcs).select(F.col("item").alias("type_id"), "reached")


def effective(types: DataFrame) -> DataFrame:
    """type_id, members, attributes gathered over each type's closure."""
    c = closure(types)
    t = types.select(F.col("type_id").alias("reached"), "members", "attributes")
    return c.join(by_size(t), "reached").groupBy("type_id").agg(
        F.array_sort(F.flatten(F.collect_list("members"))).alias("members"),
        F.array_sort(F.flatten(F.collect_list("attributes"))).alias("attributes")
    )


def type_violations(types: DataFrame) -> DataFrame:
    """Shape of types, and what they refer to."""
    t = types
    member_names, attribute_names = F.transform("members", lambda m: m["name"]), F.transform("attributes", lambda a: a["name"])
    relation = F.col("kind") == RELATION
    refs = t.select("type_id", "kind", F.explode("required_type_ids").alias("ref"))
    known = t.select(F.col("type_id").alias("ref"), F.col("kind").alias("ref_kind")).distinct()
    member_refs = t.select("type_id", F.explode("members").alias("m")).where("m.type_id is not null").select("type_id", F.col("m.type_id").alias("ref"))
    return _union([
        _bad(t, ~names.valid_path(F.col("type_id")), "type_id", INVALID, "the id is no valid name"),
        _bad(t, names.local_id(F.col("type_id")).isin(RESERVED), "type_id", UNSUPPORTED, "the name is reserved"),
        _bad(t, ~F.col("kind").isin(INSTANCE, RELATION), "type_id", UNSUPPORTED, "unknown kind"),
        _bad(
            t, ~F.forall(member_names, names.valid_segment) | ~F.forall(attribute_names, names.valid_segment), "type_id", INVALID,
            "a member or attribute has no valid name"
        ),
        _bad(t, _repeats(member_names) | _repeats(attribute_names), "type_id", INVALID, "names repeat"),
        _bad(t, F.arrays_overlap(_low(member_names), _low(attribute_names)), "type_id", INVALID, "a name is both member and attribute"),
        _bad(t, ~relation & (F.size("members") > 0), "type_id", INVALID, "an instance type has members"),
        _bad(t, relation & (F.size("members") < 2), "type_id", INVALID, "a relation type has fewer than two members"),
        _bad(t, relation & (F.size("required_type_ids") > 0), "type_id", UNSUPPORTED, "a relation type requires types"),
        _bad(t, F.exists("members", lambda m: (m["min"] < 0) | (m["max"].isNotNull() & (m["max"] < m["min"]))), "type_id", INVALID, "a cardinality is empty"),
        _bad(t, ~F.forall("attributes", lambda a: a["kind"].isin(scalars.KINDS)), "type_id", UNSUPPORTED, "unknown scalar kind"),
        _bad(refs.join(known, "ref", "left"), F.col("ref_kind").isNull(), "type_id", NOT_FOUND, F.concat(F.lit("requires unknown type "), F.col("ref"))),
        _bad(refs.join(known, "ref", "left"), F.col("ref_kind") != F.col("kind"), "type_id", INVALID, F.concat(F.lit("requires a type of another kind: "), F.col("ref"))),
        _bad(member_refs.join(known, "ref", "left"), F.col("ref_kind").isNull(), "type_id", NOT_FOUND, F.concat(F.lit("a member's type is unknown: "), F.col("ref"))),
    ])


def id_collisions(types: DataFrame, elements: DataFrame) -> DataFrame:
    """Ids that differ in case at most, among types and elements together."""
    every = types.select(F.col("type_id").alias("id")).unionByName(elements.select("id"))
    twice = every.groupBy(F.lower("id").alias("k")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.select("id", F.lit(CONFLICT).alias("code"), F.lit("the id is taken").alias("message"))


_KNOWN = "array<struct<t: string, t_kind: string>>"


def _beside_types(types: DataFrame, elements: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """elements, and beside each what its types say: unknown, known(t, t_kind), all_abstract, declared, asked and, with reached, lacking.

    Elements are many and the lists of their types few, so each list is looked at once, and no element is moved to the
    types it has. ``declared`` and ``asked`` hold the attributes and the roles of all types, as often as they are given.
    """
    shapes = stored(elements.select("type_ids").distinct())
    has = shapes.select("type_ids", F.explode("type_ids").alias("t"))
    info = types.select(F.col("type_id").alias("t"), F.col("kind").alias("t_kind"), "is_abstract", "attributes", "members")
    found = has.join(by_size(info), "t", "left").groupBy("type_ids").agg(
        F.collect_list(F.when(F.col("t_kind").isNull(), F.col("t"))).alias("unknown"),
        F.collect_list(F.when(F.col("t_kind").isNotNull(), F.struct("t", "t_kind"))).cast(_KNOWN).alias("known"),
        F.bool_and("is_abstract").alias("all_abstract"), F.flatten(F.collect_list("attributes")).alias("declared"),
        F.flatten(F.collect_list(F.when(F.col("t_kind") == RELATION, F.col("members")))).alias("asked")
    )
    if reached is not None:
        needs = has.join(by_size(reached.select(F.col("type_id").alias("t"), "reached")), "t").select("type_ids", F.col("reached").alias("t")).distinct()
        lacking = needs.join(has, ["type_ids", "t"], "left_anti").groupBy("type_ids").agg(F.collect_list("t").alias("lacking"))
        found = found.join(lacking, "type_ids", "left")
    out = elements.join(by_size(stored(found)), "type_ids", "left")
    return out.withColumns({k: F.coalesce(k, F.array().cast(found.schema[k].dataType)) for k in ("declared", "asked")})


def scalar_violations(types: DataFrame, elements: DataFrame) -> DataFrame:
    """Attributes against the declarations of an element's types."""
    return _scalar_rules(_beside_types(types, elements))


def _scalar_rules(beside: DataFrame) -> DataFrame:
    kinds_of = lambda test: F.array_distinct(F.transform(F.filter("declared", test), lambda a: a["kind"]))
    low = F.array_distinct(F.transform("declared", lambda a: F.lower(a["name"])))
    odd = beside.select("id", F.explode(F.filter(low, lambda k: F.size(kinds_of(lambda a: F.lower(a["name"]) == k)) > 1)).alias("k"))
    lacks = beside.select("id", F.explode(F.transform(
        F.filter("declared", lambda a: a["required"] & F.try_element_at(F.col("attributes"), a["name"]).isNull()), lambda a: a["name"]
    )).alias("name"))
    given = beside.select("id", "declared", F.explode("attributes").alias("name", "value"))
    matched = given.select("id", "name", "value", F.explode_outer(kinds_of(lambda a: a["name"] == F.col("name"))).alias("scalar"))
    return _union([
        _bad(odd, F.lit(True), "id", INVALID, F.concat(F.lit("types disagree about the kind of "), F.col("k"))),
        _bad(lacks, F.lit(True), "id", INVALID, F.concat(F.lit("a required attribute is missing: "), F.col("name"))),
        _bad(matched, F.col("scalar").isNull(), "id", INVALID, F.concat(F.lit("no type declares the attribute "), F.col("name"))),
        _bad(
            matched, F.col("scalar").isNotNull() & ~scalars.is_valid(F.col("scalar"), F.col("value")), "id", INVALID,
            F.concat(F.lit("the value is no "), F.col("scalar"), F.lit(": "), F.col("name"))
        ),
    ])


def participants(elements: DataFrame) -> DataFrame:
    """rel, role, participant, at: one row for each participant of each relation."""
    return elements.where(F.col("kind") == RELATION).select(
        F.col("id").alias("rel"), F.explode("members").alias("role", "ids")
    ).select("rel", "role", F.posexplode("ids").alias("at", "participant"))


def relation_violations(types: DataFrame, elements: DataFrame) -> DataFrame:
    """Roles, cardinalities and participants of relations; a participant may be a relation."""
    return _relation_rules(_beside_types(types, elements.where(F.col("kind") == RELATION)), elements)


def _relation_rules(beside: DataFrame, elements: DataFrame) -> DataFrame:
    rel = beside.where(F.col("kind") == RELATION).select("id", "members", F.transform("asked", lambda m: F.struct(
        m["name"].alias("role"), m["type_id"].alias("needs"), m["min"].alias("lo"), m["max"].alias("hi")
    )).alias("asked"))
    declared = rel.select("id", "members", F.inline("asked"))
    counts = declared.select("id", "role", "lo", "hi", F.size(F.coalesce(F.try_element_at("members", "role"), F.array().cast("array<string>"))).alias("n"))
    extra = rel.select("id", F.explode(F.array_except(F.map_keys("members"), F.transform("asked", lambda m: m["role"]))).alias("role"))
    absent = declared.where(~F.map_contains_key("members", F.col("role")))
    given = rel.select(F.col("id").alias("rel"), "asked", F.explode("members").alias("role", "ids"))
    twice = given.where(F.size(F.array_distinct("ids")) < F.size("ids")).select("rel", "role", F.explode("ids").alias("participant"))
    repeated = twice.groupBy("rel", "role", "participant").count().where("count > 1")
    needs = F.array_distinct(F.filter(F.transform(F.filter("asked", lambda m: m["role"] == F.col("role")), lambda m: m["needs"]), lambda n: n.isNotNull()))
    given = given.select("rel", F.explode("ids").alias("participant"), needs.alias("needs"))
    # Participants are looked up once, with what is asked of them; relations come back to those that fall short alone.
    people = elements.select(F.col("id").alias("participant"), F.col("type_ids").alias("have"))
    wanted = given.select("participant", F.explode_outer("needs").alias("need")).distinct().join(people, "participant", "left")
    short = stored(wanted.where(F.col("have").isNull() | ~F.array_contains("have", F.col("need"))).select("participant", "need", F.col("have").isNull().alias("none")))
    short = by_size(short.withColumnRenamed("participant", "who"))
    asked = given.select("rel", "participant", F.explode_outer("needs").alias("asked"))
    hit = asked.join(short, F.col("participant").eqNullSafe(F.col("who")) & F.col("asked").eqNullSafe(F.col("need")))
    # Two needs of one role look for the same participant; that there is none is said once.
    none = given.select("rel", "participant", F.get("needs", F.lit(0)).alias("asked")).join(short.where("none"), F.col("participant").eqNullSafe(F.col("who")) & F.col("asked").eqNullSafe(F.col("need")))
    other = hit.where("not none")
    return _union([
        _bad(
            counts, (F.col("n") < F.col("lo")) | (F.col("hi").isNotNull() & (F.col("n") > F.col("hi"))), "id", INVALID,
            F.concat(F.lit("wrong number of participants: "), F.col("role"))
        ),
        _bad(extra, F.lit(True), "id", INVALID, F.concat(F.lit("unexpected role "), F.col("role"))),
        _bad(absent, F.lit(True), "id", INVALID, F.concat(F.lit("the role is missing: "), F.col("role"))),
        _bad(repeated, F.lit(True), "rel", INVALID, F.concat(F.lit("a participant repeats: "), F.col("participant"))),
        _bad(none, F.lit(True), "rel", INVALID, F.concat(F.lit("no such participant: "), F.col("participant"))),
        _bad(other, F.lit(True), "rel", INVALID, F.concat(F.lit("a participant is no "), F.col("need"), F.lit(": "), F.col("participant"))),
    ])


def element_violations(types: DataFrame, elements: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """Types of elements (kind, closure, abstract alone), attributes and relations."""
    reached = closure(types) if reached is None else reached
    beside = _beside_types(types, elements, reached)
    known = beside.select("id", "kind", F.inline("known"))
    return _union([
        _bad(elements, F.size("type_ids") < 1, "id", INVALID, "no type"),
        _bad(elements, ~names.valid_path(F.col("id")), "id", INVALID, "the id is no valid name"),
        _bad(beside.select("id", F.explode("unknown").alias("t")), F.lit(True), "id", NOT_FOUND, F.concat(F.lit("unknown type "), F.col("t"))),
        _bad(known, F.col("t_kind") != F.col("kind"), "id", INVALID, F.concat(F.lit("a type of another kind: "), F.col("t"))),
        _bad(beside, F.col("all_abstract"), "id", INVALID, "only abstract types"),
        _bad(beside.select("id", F.explode("lacking").alias("t")), F.lit(True), "id", CORRUPT, F.concat(F.lit("a required type is not stored: "), F.col("t"))),
        _scalar_rules(beside), _relation_rules(beside, elements),
    ])


def incident_relations(elements: DataFrame, ids: list[str]) -> DataFrame:
    """Relations in which any of ids takes part, by id."""
    hit = participants(elements).where(F.col("participant").isin(ids)).select(F.col("rel").alias("id")).distinct()
    return elements.join(hit, "id", "left_semi").orderBy("id")


def same_participants(elements: DataFrame, ids: list[str]) -> DataFrame:
    """Relations whose participants, roles aside, are exactly this multiset."""
    per = participants(elements).groupBy("rel").agg(F.array_sort(F.collect_list("participant")).alias("all"))
    return per.where(F.col("all") == F.array(*(F.lit(x) for x in sorted(ids)))).select(F.col("rel").alias("id"))


class TypedGraph:
    """An immutable version of the store; each change gives the next version or raises.

    A change is checked with what it touches -- the new rows, the participants they name, the ids
    that differ in case at most -- and only it is written: a version is the one before with rows
    added or left out. Every SETTLE changes the elements get a table of their own.
    """

    SETTLE = 64

    def __init__(self, types: DataFrame, elements: DataFrame, changes: int = 0):
        self.spark: SparkSession = types.sparkSession
        self.types = types
        self.elements, self.changes = (cut(elements), 0) if changes >= self.SETTLE else (elements, changes)

    @classmethod
    def empty(cls, spark: SparkSession) -> "TypedGraph":
        return cls(spark.createDataFrame([], TYPES), spark.createDataFrame([], ELEMENTS))

    def _next(self, elements: DataFrame) -> "TypedGraph":
        return TypedGraph(self.types, elements, self.changes + 1)

    def _alike(self, ids: DataFrame) -> DataFrame:
        """Stored elements whose id is one of ids(id), case ignored."""
        return self.elements.join(ids.select(F.lower("id").alias("_low")).distinct(), F.lower("id") == F.col("_low"), "left_semi")

    def _with_ends(self, rows: DataFrame) -> DataFrame:
        """Elements and the stored participants that they name."""
        named = participants(rows).select(F.col("participant").alias("id")).distinct().join(rows.select("id"), "id", "left_anti")
        return rows.unionByName(self.elements.join(named, "id", "left_semi").select(rows.columns))

    def create_types(self, rows: DataFrame) -> "TypedGraph":
        """New types; types of one call may refer to each other."""
        after = cut(self.types.unionByName(rows))
        new = rows.select(F.col("type_id").alias("id"))
        require_none(id_collisions(after, self._alike(new)).unionByName(type_violations(after).join(new, "id", "left_semi")))
        return TypedGraph(after, self.elements, self.changes)

    def _created(self, rows: DataFrame, kind: str) -> "TypedGraph":
        reached = cut(closure(self.types))
        asked = rows.select("id", F.explode("type_ids").alias("type_id"))
        unknown = asked.join(self.types.select("type_id"), "type_id", "left_anti")
        require_none(_bad(unknown, F.lit(True), "id", NOT_FOUND, F.concat(F.lit("unknown type "), F.col("type_id"))))
        full = asked.join(reached, "type_id").groupBy("id").agg(F.array_sort(F.collect_set("reached")).alias("type_ids"))
        none = self.types.where(F.col("is_abstract")).select("type_id")
        direct = asked.join(none, "type_id", "left_semi")
        none_given = F.create_map().cast("map<string,array<string>>")
        new = rows.select("id", "attributes", "members").join(full, "id", "left").select(
            "id", F.lit(kind).alias("kind"), F.coalesce("type_ids", F.array().cast("array<string>")).alias("type_ids"), F.coalesce(
                "attributes", F.create_map().cast("map<string,string>")
            ).alias("attributes"),
            F.transform_values(F.coalesce("members", none_given), lambda _, v: F.array_sort(v)).alias("members"),
        )
        new = cut(new)
        ids = new.select("id")
        bad = _union([
            id_collisions(self.types, self._alike(ids).select(new.columns).unionByName(new)), _bad(
                direct, F.lit(True), "id", INVALID, F.concat(F.lit("an abstract type is assigned: "), F.col("type_id"))
            ),
            element_violations(self.types, self._with_ends(new), reached).join(ids, "id", "left_semi"),
        ])
        require_none(bad)
        return self._next(self.elements.unionByName(new))

    def create_instances(self, rows: DataFrame) -> "TypedGraph":
        """rows(id, type_ids, attributes): the closure of the types is stored."""
        return self._created(rows.withColumn("members", F.create_map().cast("map<string,array<string>>")), INSTANCE)

    def create_relations(self, rows: DataFrame) -> "TypedGraph":
        """rows(id, type_ids, attributes, members); parallel relations stay apart."""
        return self._created(rows, RELATION)

    def replace_attributes(self, rows: DataFrame) -> "TypedGraph":
        """rows(id, attributes): whole maps are replaced; an id that comes twice is refused."""
        twice = rows.groupBy("id").count().where("count > 1")
        require_none(_bad(twice, F.lit(True), "id", INVALID, "the element is named twice"))
        new = rows.select("id", F.col("attributes").alias("new"))
        missing = new.join(self.elements, "id", "left_anti")
        require_none(_bad(missing, F.lit(True), "id", NOT_FOUND, "no such element"))
        changed = cut(self.elements.join(new, "id").withColumn("attributes", F.coalesce("new", "attributes")).drop("new").select(self.elements.columns))
        require_none(scalar_violations(self.types, changed))
        return self._next(self.elements.join(changed.select("id"), "id", "left_anti").select(self.elements.columns).unionByName(changed))

    def delete(self, ids: list[str]) -> "TypedGraph":
        """RESTRICT: an element that takes part in another relation stays."""
        gone = F.col("id").isin(ids)
        found = self.elements.where(gone).count()
        if found < len(set(ids)):
            raise ContractError(NOT_FOUND, [{"id": x, "message": "no such element"} for x in sorted(set(ids))[:1]])
        require_none(self.held(ids))
        return self._next(self.elements.where(~gone))

    def held(self, ids: list[str]) -> DataFrame:
        """What keeps elements from being deleted: a row for each of them and each other relation in which it takes part."""
        held = participants(self.elements.where(~F.col("id").isin(ids))).where(F.col("participant").isin(ids))
        return _bad(held, F.lit(True), "participant", CONFLICT, F.concat(F.lit("takes part in "), F.col("rel"))).distinct()

    def get(self, identifier: str) -> DataFrame:
        """The element, or an error if it is stored corrupt; it is read with its participants alone."""
        one = self.elements.where(F.col("id") == identifier)
        bad = element_violations(self.types, self._with_ends(one)).where(F.col("id") == identifier)
        rows = bad.limit(_SHOWN).collect()
        if rows:
            raise ContractError(CORRUPT, rows)
        return one

    def get_types(self) -> DataFrame:
        return self.types.orderBy("type_id")

    def incident(self, ids: list[str]) -> DataFrame:
        return incident_relations(self.elements, ids)

    def violations(self) -> DataFrame:
        return _union([type_violations(self.types), id_collisions(self.types, self.elements), element_violations(self.types, self.elements)])
