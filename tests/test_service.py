import json

from weft.operators import semantic, typed
from weft.plans.contracts import TypeBuilder
from weft.service import Service
from weft.sources import definitions
from weft.sources.graph import PropertyGraph
from weft.tools import Tools


def test_graph_requests(spark):
    s = Service(PropertyGraph.of(spark, {"a": {"k": "1"}, "b": {}}, [("a", "b")]))
    assert s.handle("POST", "/api/graph/nodes", {"parent": "a", "localId": "c", "attributes": {"x": "y"}})[0] == 201
    assert s.handle("POST", "/api/graph/nodes", {"parent": "nowhere", "localId": "c"})[0] == 400
    status, body = s.handle("GET", "/api/graph/nodes", globalId="a/c")
    assert status == 200 and body["attrs"] == {"x": "y"} and [e["neighbor"] for e in body["edges"]] == ["a"]
    assert s.handle("GET", "graph/nodes", globalId="zz")[0] == 404
    assert s.handle("GET", "graph/nodes/neighbor", globalId="a", localId="b")[1]["gid"] == "b"
    status, lines = s.handle("POST", "graph/search/nodes", {"return": ["x"], "where": {"kind": "connected", "left": {"kind": "var", "name": "x"}, "right": {"kind": "literal", "name": "a"}}})
    assert status == 200 and [json.loads(x)["node"] for x in lines] == ["a/c", "b"]
    assert s.handle("POST", "graph/search/nodes", {"where": {"kind": "odd"}})[0] == 400
    assert s.handle("POST", "graph/connections", {"source": "b", "target": "a"})[0] == 400
    assert s.handle("DELETE", "graph/connections", {"source": "b", "target": "a"})[0] == 204
    status, out = s.handle("POST", "graph/subgraph", {"roots": ["a"], "maxDepth": 1})
    assert status == 200 and len(list(out["nodes"])) == 2 and len(list(out["edges"])) == 1
    assert s.handle("POST", "graph/subgraph", {"roots": ["zz"]})[0] == 404
    assert s.handle("PUT", "graph/nodes", {"attributes": {}}, globalId="a/c")[0] == 204 and s.handle("DELETE", "graph/nodes", globalId="a")[0] == 204
    assert {r["gid"] for r in s.graph.base.collect()} == {"b"}
    gate = Service(s.graph, profile="Semantic")
    assert gate.handle("POST", "graph/search/nodes", {"where": {"kind": "attribute", "node": {"kind": "var", "name": "n"}, "key": "k", "value": "1"}})[0] == 400


def test_typed_requests(spark):
    s = Service(PropertyGraph.of(spark, ["x"]), typed.TypedGraph.empty(spark))
    assert s.handle("POST", "typed-graph/types", {"type_id": "Item", "kind": "Instance"})[0] == 201
    assert s.handle("POST", "typed-graph/types", {"type_id": "item", "kind": "Instance"})[0] == 409
    two = [{"name": "A", "type_id": "Item", "min": 1, "max": 1}, {"name": "B", "type_id": "Item", "min": 0}]
    assert s.handle("POST", "typed-graph/types", {"type_id": "Has", "kind": "Relation", "members": two})[0] == 201
    for i in "pq":
        assert s.handle("POST", "typed-graph/instances", {"id": i, "type_ids": ["Item"]})[0] == 201
    assert s.handle("POST", "typed-graph/relations", {"id": "r", "type_ids": ["Has"], "members": {"A": ["p"], "B": ["q"]}})[0] == 201
    assert [json.loads(x)["id"] for x in s.handle("GET", "typed-graph/relations/incident", participantId="q")[1]] == ["r"]
    assert s.handle("DELETE", "typed-graph/elements", id="q")[0] == 409 and s.handle("DELETE", "typed-graph/elements", id="zz")[0] == 404
    assert s.handle("PUT", "typed-graph/elements/attributes", {"attributes": {"odd": "1"}}, id="q")[0] == 400
    assert s.handle("GET", "typed-graph/types")[0] == 200 and s.handle("GET", "typed-graph/types/item", id="no")[0] == 404


def test_definitions_round_trip(spark):
    b = TypeBuilder("NodeTypes/Ship", "Edge").requires("NodeTypes/Thing").field("Goods", node_type="NodeTypes/Thing").field("Size", "int", "optional").slot("Goods", "NodeTypes/Thing").slot("Port", "NodeTypes/Thing", card="many")
    types = spark.createDataFrame([b.row(), TypeBuilder("NodeTypes/Thing").abstract().row()], semantic.TYPES)
    nodes = definitions.stored(types)
    assert not nodes.where("gid = 'NodeTypes/Ship/Definition/Slots/Goods'").count()  # its field stands for it
    g = PropertyGraph(nodes, spark.createDataFrame([], "a_gid string, b_gid string"))
    back = {r["type_gid"]: r for r in definitions.read(g, spark.createDataFrame([("NodeTypes/Ship", "NodeTypes/Thing")], "type_gid string, required string")).collect()}
    ship = back["NodeTypes/Ship"]
    assert ship["element_kind"] == "Edge" and ship["required"] == ["NodeTypes/Thing"] and back["NodeTypes/Thing"]["is_abstract"]
    assert [(f["name"], f["value_kind"], f["data_type"], f["min"], f["max"], f["node_type"]) for f in ship["fields"]] == [("Goods", "Node", None, 1, 1, "NodeTypes/Thing"), ("Size", "Primitive", "int", 0, 1, None)]
    assert [(s["name"], s["allowed"], s["min"], s["max"]) for s in ship["slots"]] == [("Port", ["NodeTypes/Thing"], 0, None)]


def semantic_service(spark):
    t = [TypeBuilder("NodeTypes/Thing").abstract().row(), TypeBuilder("NodeTypes/Ship").requires("NodeTypes/Thing").field("Name").field("Home", card="optional", node_type="NodeTypes/Port").row()]
    t += [TypeBuilder("NodeTypes/Port").row(), TypeBuilder("NodeTypes/Calls", "Edge").field("Ship", node=True).field("Port", node=True).row()]
    g = PropertyGraph.of(spark, ["p", "q", "s"], [("p", "s")])
    return Service(g, types=spark.createDataFrame(t, semantic.TYPES))


def test_types_of_nodes_and_edges(spark):
    s = semantic_service(spark)
    status, body = s.handle("PUT", "/api/graph/nodes/type", {"internalId": "p", "typeGlobalId": "NodeTypes/Port"})
    assert status == 200 and [x["type_gid"] for x in body["types"]] == ["NodeTypes/Port"] and [n["gid"] for n in body["nodes"]] == ["p"]
    assert s.handle("PUT", "graph/nodes/type", {"internalId": "zz", "typeGlobalId": "NodeTypes/Port"})[0] == 404
    assert s.handle("PUT", "graph/nodes/type", {"internalId": "p", "typeGlobalId": "NodeTypes/Thing"})[0] == 400  # abstract
    status, body = s.handle("PUT", "graph/edges/type", {"node1InternalId": "s", "node2InternalId": "p", "typeGlobalId": "NodeTypes/Calls"})
    assert status == 200 and body["edges"] == [] and s.graph.links.count() == 0
    assert {(r["role"], r["participant_gid"]) for r in s.edges.members.where(f"rel_gid = '{body['relation']}'").collect()} == {("Ship", "s"), ("Port", "p")}
    assert s.handle("PUT", "graph/edges/type", {"node1InternalId": "s", "node2InternalId": "p", "typeGlobalId": "NodeTypes/Port"})[0] == 400


def test_tool_profiles(spark):
    s = semantic_service(spark)
    t = Tools(s)
    assert t.profile == "Semantic" and t.names() == ["CreateNode", "CreateType", "GetNode", "GetTypeDefinitions"]
    made = t.call("CreateNode", localId="Gull", type="NodeTypes/Ship", path=["p"], fields={"Name": "Gull", "Home": "q"})
    assert made["internalId"] == "p/Gull" and [x["type"] for x in made["types"]] == ["NodeTypes/Ship", "NodeTypes/Thing"] and all(x["witness"] for x in made["types"])
    assert "error" in t.call("CreateNode", localId="x", type="NodeTypes/Ship", fields={}) and "error" in t.call("CreateNode", localId="x", type="NodeTypes/Ship", fields={"Name": "x", "Home": "nowhere"})
    assert "error" in t.call("DeleteNode", path=["p"])  # of the other profile
    assert t.call("CreateType", localId="Tug", fields={"Pull": {"clrType": "int"}}, slots=[{"name": "tow", "allowedType": "NodeTypes/Ship", "cardinality": "many"}], requires=["NodeTypes/Ship"]) == {"type": "NodeTypes/Tug"}
    assert "error" in t.call("CreateType", localId="Odd", requires=["NodeTypes/Nothing"])
    tug = {d["type_gid"]: d for d in t.call("GetTypeDefinitions")}["NodeTypes/Tug"]
    assert tug["required"] == ["NodeTypes/Ship"] and tug["slots"][0]["allowed"] == ["NodeTypes/Ship"]
    raw = Tools(s, "raw")
    assert raw.call("CreateNode", localId="n", path=["p"])["gid"] == "p/n" and raw.call("ConnectNodes", sourceGlobalId=["p", "n"], targetGlobalId=["q"]) == {"ok": True}
    found = raw.call("SearchNodes", query={"return": ["x"], "where": {"kind": "connected", "left": {"kind": "var", "name": "x"}, "right": {"kind": "literal", "name": "Q"}}})
    assert sorted(x["node"] for x in found) == ["p/Gull", "p/n"]
    assert len(list(raw.call("GetSubgraph", rootPaths=[["p"]])["nodes"])) == 4 and raw.call("GetNode", path=["p", "n"])["gid"] == "p/n"
    assert raw.call("DisconnectNodes", sourceGlobalId=["p", "n"], targetGlobalId=["q"]) == {"ok": True} and raw.call("DeleteNode", path=["p", "n"]) == {"ok": True}
    assert "error" in raw.call("GetNode", path=["p", "n"]) and "error" in raw.call("CreateType", localId="x")
