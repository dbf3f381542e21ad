import pytest
from pyspark.sql import functions as F

from weft.operators import message_passing as mp
from weft.operators import typed
from weft.sources.graph import PropertyGraph


def types(spark, rows):
    full = [(r[0], r[1], r[2] if len(r) > 2 else False, r[3] if len(r) > 3 else [], r[4] if len(r) > 4 else [], r[5] if len(r) > 5 else []) for r in rows]
    return spark.createDataFrame(full, typed.TYPES)


@pytest.fixture
def store(spark):
    members = [("Owner", "Item", 1, 1), ("Items", "Item", 0, None)]
    evidence = [("Fact", "Contains", 1, 1), ("Source", "Item", 1, 1)]
    rows = [("Entity", "Instance", True), ("Item", "Instance", False, ["Entity"], [], [("Count", "Int32", False)]), ("Contains", "Relation", False, [], members), ("Evidence", "Relation", False, [], evidence)]
    g = typed.TypedGraph.empty(spark).create_types(types(spark, rows))
    return g.create_instances(spark.createDataFrame([("a", ["Item"], {}), ("b", ["Item"], {"Count": "3"})], "id string, type_ids array<string>, attributes map<string,string>"))


def relation(spark, *rows):
    return spark.createDataFrame([(i, [t], {}, m) for i, t, m in rows], "id string, type_ids array<string>, attributes map<string,string>, members map<string,array<string>>")


def test_roles_parallel_relations_and_restrict(spark, store):
    assert store.elements.where("id = 'a'").first()["type_ids"] == ["Entity", "Item"]
    g = store.create_relations(relation(spark, ("r1", "Contains", {"Owner": ["a"], "Items": ["b"]}), ("r2", "Contains", {"Owner": ["a"], "Items": ["b"]})))
    assert [r["id"] for r in g.incident(["a"]).collect()] == ["r1", "r2"]
    assert {r["id"] for r in typed.same_participants(g.elements, ["b", "a"]).collect()} == {"r1", "r2"}
    with pytest.raises(typed.ContractError) as e:
        g.delete(["a"])
    assert e.value.code == "Conflict"
    assert g.delete(["r1", "r2"]).delete(["a"]).elements.count() == 1
    higher = g.create_relations(relation(spark, ("ev1", "Evidence", {"Fact": ["r1"], "Source": ["b"]})))
    with pytest.raises(typed.ContractError):
        higher.delete(["r1"])
    assert g.violations().count() == 0


@pytest.mark.parametrize("members,code", [({"Owner": ["a"], "Items": ["zz"]}, "Invalid"), ({"Owner": ["a"], "Items": ["b", "b"]}, "Invalid"), ({"Owner": ["a"], "Items": [], "Odd": ["b"]}, "Invalid"), ({"Items": ["b"]}, "Invalid")])
def test_invalid_relations(spark, store, members, code):
    with pytest.raises(typed.ContractError) as e:
        store.create_relations(relation(spark, ("r", "Contains", members)))
    assert e.value.code == code and store.elements.count() == 2


def test_ids_scalars_and_types(spark, store):
    one = lambda *r: spark.createDataFrame([r], "id string, type_ids array<string>, attributes map<string,string>")
    for row, code in [(("A", ["Item"], {}), "Conflict"), (("c", ["Item"], {"Count": "NaN"}), "Invalid"), (("c", ["Entity"], {}), "Invalid"), (("c", ["Nope"], {}), "NotFound"), (("CON", ["Item"], {}), "Invalid"), (("c", ["Item"], {"count": "1"}), "Invalid")]:
        with pytest.raises(typed.ContractError) as e:
            store.create_instances(one(*row))
        assert e.value.code == code, row
    with pytest.raises(typed.ContractError):
        store.replace_attributes(spark.createDataFrame([("b", {"Count": "x"})], "id string, attributes map<string,string>"))
    assert store.replace_attributes(spark.createDataFrame([("b", {"Count": " 7 "})], "id string, attributes map<string,string>")).get("b").first()["attributes"] == {"Count": " 7 "}


def test_closure_of_diamond_and_cycle(spark):
    t = types(spark, [("Leaf", "Instance", False, ["Left", "Right"]), ("Left", "Instance", False, ["Root"]), ("Right", "Instance", False, ["Root"]), ("Root", "Instance", False, ["Leaf"])])
    got = {r["reached"] for r in typed.closure(t).where("type_id = 'Leaf'").collect()}
    assert got == {"Leaf", "Left", "Right", "Root"}
    stale = spark.createDataFrame([("x", "Instance", ["Leaf"], {}, {})], typed.ELEMENTS)
    assert {r["code"] for r in typed.element_violations(t, stale).collect()} == {"Corrupt"}


def test_scalar_kinds(spark):
    from weft.functions import scalars

    good = [("Boolean", " TRUE "), ("Int32", " 12 "), ("Int64", "-9"), ("Double", "1e3"), ("Decimal", "-1.50"), ("Guid", "01234567-89ab-cdef-0123-456789abcdef"), ("DateTime", "2024-02-03T04:05:06.1234567Z"), ("String", "")]
    bad = [("Boolean", "yes"), ("Int32", "1e3"), ("Int32", "3000000000"), ("Int64", "1,000"), ("Double", "NaN"), ("Decimal", "1e3"), ("Guid", "{x}"), ("DateTime", "2024-02-03"), ("Odd", "x")]
    df = spark.createDataFrame([(k, v, True) for k, v in good] + [(k, v, False) for k, v in bad], "k string, v string, ok boolean")
    assert df.where(scalars.is_valid(F.col("k"), F.col("v")) != F.col("ok")).collect() == []


def snapshot(spark, nodes, rels):
    n = spark.createDataFrame([(k, ["t"], [float(v) for v in x]) for k, x in nodes.items()], mp.NODES)
    return n, spark.createDataFrame([(k, t, a, b, float(w)) for k, t, a, b, w in rels], mp.RELATIONS)


def test_full_layer_and_types(spark):
    n, r = snapshot(spark, {"a": [2, -1], "b": [-3, 4]}, [("e", "t", "a", "b", 0.5)])
    y = {x["key"]: list(x["y"]) for x in mp.apply_layer(n, r, mp.Layer(2, 2, {"t": [[1, 2], [3, 4]]}, [[1, 0], [0, 1]], [-1, 1], "ReLU")).collect()}
    assert y == {"a": [1, 0], "b": [0, 5]}
    n, r = snapshot(spark, {"left": [2], "right": [3], "target": [0]}, [("1", "z-type", "left", "target", 1), ("2", "a-type", "right", "target", 1)])
    layer = mp.Layer(1, 1, {"z-type": [[10]], "a-type": [[100]]})
    assert mp.apply_layer(n, r, layer).where("key = 'target'").first()["y"] == [320]
    empty = mp.apply_layer(n.where("false"), r.where("false"), layer)
    assert empty.columns == ["key", "y"] and empty.count() == 0


def test_csr_parallel_and_chunks(spark):
    n, r = snapshot(spark, {"a": [10], "b": [20], "c": [30]}, [("second", "t", "c", "b", 2), ("first", "t", "a", "b", 1)])
    off = [(x["start"], x["end"]) for x in mp.csr_offsets(n, r).orderBy("row").collect()]
    assert off == [(0, 0), (0, 2), (2, 2)]
    assert [(x["col"], x["w"]) for x in mp.csr_entries(n, r).orderBy("row", "pos").collect()] == [(0, 1), (2, 2)]
    n, r = snapshot(spark, {"a": [2], "b": [0]}, [("r1", "t", "a", "b", 1), ("r2", "t", "a", "b", 3)])
    assert mp.apply_layer(n, r, mp.Layer(1, 1, {"t": [[1]]})).where("key = 'b'").first()["y"] == [8]
    n, r = snapshot(spark, {"a": [1], "b": [2], "c": [3]}, [("1", "t", "a", "b", 1), ("2", "t", "b", "c", 1)])
    c = {}
    for x in mp.chunks(n, r, 1).collect():
        c.setdefault(x["chunk"], set()).add(x["key"])
    assert sorted(map(sorted, c.values())) == [["a"], ["a", "b"], ["b", "c"]]


def test_diagnostics_come_together(spark):
    n = spark.createDataFrame([("a", ["t"], [float("nan")]), ("a", ["t"], [1.0]), ("b", [], [1.0, 2.0])], mp.NODES)
    r = spark.createDataFrame([("r", "t", "a", "zz", float("inf")), ("r", "", "a", "b", 1.0)], mp.RELATIONS)
    got = {x["code"] for x in mp.diagnostics(n, r, mp.Layer(1, 0, {"t": [[1, 2]]}, activation="tanh")).collect()}
    assert got == {
        "snapshot.node.feature.non_finite", "snapshot.node.key.duplicate", "snapshot.node.type.required", "snapshot.node.feature_width", "snapshot.relation.target.missing", "snapshot.relation.weight.non_finite",
        "snapshot.relation.key.duplicate", "snapshot.relation.type.required", "spec.output_width", "spec.relation_transform.shape", "spec.activation", "spec.relation_transform.missing",
    }


def test_lowering_and_run(spark):
    g = PropertyGraph.of(spark, {"a": {"x": "1"}, "b": {"x": "2"}, "c": {"x": "3"}, "far": {"x": "9"}}, [("a", "b"), ("b", "c"), ("c", "far")])
    n = g.nodes.where("gid <> 'far'").select(F.col("gid").alias("key"))
    low = mp.lower_edges(n, g.edges, "e")
    assert {(x["key"], x["src"], x["dst"]) for x in low.collect()} == {("e/0/forward", "a", "b"), ("e/0/reverse", "b", "a"), ("e/1/forward", "b", "c"), ("e/1/reverse", "c", "b")}
    y = mp.run_graph(g, ["a"], 2, F.array(F.element_at("attrs", "x").cast("float")), "e", mp.Layer(1, 1, {"e": [[1.0]]}))
    assert {x["key"]: x["y"][0] for x in y.collect()} == {"a": 2, "b": 4, "c": 2}


def test_rules_about_types_move_no_element(spark):
    """Types made by the driver have no known size; elements are not shuffled to the few types they have, nor sorted in one task."""
    types = spark.createDataFrame([("A", "Instance", False, [], [], [("Size", "Int32", True)])], typed.TYPES)
    rows = [("x", "Instance", ["A"], {"Size": "one"}, {}), ("y", "Instance", ["A"], {"Other": "1"}, {}), ("z", "Instance", ["A", "B"], {"Size": "1"}, {})]
    bad = typed.scalar_violations(types, spark.createDataFrame(rows, typed.ELEMENTS))
    assert sorted((r["id"], r["message"]) for r in bad.collect()) == [
        ("x", "the value is no Int32: Size"), ("y", "a required attribute is missing: Size"), ("y", "no type declares the attribute Other")
    ]
    assert "Exchange hashpartitioning" not in bad._jdf.queryExecution().executedPlan().toString()
