"""Storage backends, leases, strict and chunked layers, basis loading, selections, identity."""

import hashlib
import json
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft import selection
from weft.functions import names, scalars
from weft.operators import measure, message_passing as mp, semantic, view
from weft.live import Links, Neighbours
from weft.operators.mutate import GraphError, clear_neighbours
from weft.plans import compile as plans
from weft.plans import contracts
from weft.plans.contracts import TypeBuilder
from weft.plans.session import cancel, cancellable
from weft.service import Service
from weft.sources import records, storage
from weft.sources.graph import PropertyGraph
from weft.streaming import changes


def links(g):
    return sorted((r["a_gid"], r["b_gid"]) for r in g.links.collect())


def test_storage_backends(spark, tmp_path):
    g = PropertyGraph.of(spark, {"a": {"k": "v"}, "b": {}}, [("a", "b")])
    for name, args in (("memory", ()), ("tables", (str(tmp_path / "t"),)), ("document", (str(tmp_path / "d"),))):
        s = storage.open_storage(spark, name, *args)
        if name != "document":
            assert s.load().base.count() == 0
        s.save(g)
        s.save(PropertyGraph(g.base.where("gid = 'a'").unionByName(g.base.where("gid = 'b'")), g.links))
        assert links(s.load()) == [("a", "b")] and s.load().base.count() == 2
    broken = storage.open_storage(spark, "tables", str(tmp_path / "t"))
    g.base.limit(1).write.parquet(str(tmp_path / "t" / "nodes" / "v=00000003"))  # its links were never written
    assert broken.load().base.count() == 2
    storage.register("own", lambda spark, n: n)
    assert storage.open_storage(spark, "OWN", 7) == 7
    with pytest.raises(LookupError):
        storage.open_storage(spark, "nothing")


def test_one_holder_of_a_store(spark, tmp_path):
    path = str(tmp_path / "store")
    records.open_store(spark, path)
    with records.lease(spark, path, "first"):
        with pytest.raises(records.FormatError, match="first"):
            with records.lease(spark, path, "second"):
                pass
    with pytest.raises(ValueError):
        with records.lease(spark, path, "third"):
            raise ValueError("the lease goes with its holder")
    records.lease(spark, path, "dead").__enter__()
    records.break_lease(spark, path)
    with records.lease(spark, path, "fourth"):
        pass


def test_document_on_one_line_is_read_too(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"version": 1, "nodes": [{"path": ["a"], "attributes": {"k": "{\"path\""}}, {"path": ["b"], "attributes": {}}], "edges": [{"source": ["b"], "target": ["a"]}]}))
    g = records.load_backup(spark, str(tmp_path / "one.json"))
    assert links(g) == [("a", "b")]
    records.save_backup(g, str(tmp_path / "again"))
    assert links(records.load_backup(spark, str(tmp_path / "again"))) == [("a", "b")]
    empty = PropertyGraph.of(spark, [])
    records.save_backup(empty, str(tmp_path / "none"))
    assert records.load_backup(spark, str(tmp_path / "none")).base.count() == 0


def random_program(spark, seed=3, n=40, edges=300):
    r = np.random.default_rng(seed)
    x = (r.random((n, 3)) * 10).astype(np.float32)
    nodes = spark.createDataFrame([(f"n{k:02}", ["t"], [float(v) for v in x[k]]) for k in range(n)], mp.NODES)
    rel = [(f"e{k:03}", "ab"[k % 2], f"n{r.integers(n):02}", f"n{min(r.integers(n), r.integers(n)):02}", float(np.float32(r.random()))) for k in range(edges)]
    m = lambda i, o: [[float(np.float32(v)) for v in row] for row in r.normal(size=(i, o))]
    return x, nodes, spark.createDataFrame(rel, mp.RELATIONS), rel, mp.Layer(3, 2, {"a": m(3, 2), "b": m(3, 2)}, m(3, 2), [0.1, -0.2], "relu")


def sequential(x, rel, layer):
    """One number after the other, in 32 bits."""
    f = np.float32
    out = np.zeros((len(x), layer.outputs), f)
    for v in range(len(x)):
        for o in range(layer.outputs):
            s = f(layer.bias[o])
            for i in range(layer.inputs):
                s = f(s + f(x[v, i] * f(layer.own[i][o])))
            for t in sorted(layer.relations):
                for _, _, src, _, w in sorted((e for e in rel if e[1] == t and e[3] == f"n{v:02}"), key=lambda e: (e[2], e[0])):
                    for i in range(layer.inputs):
                        s = f(s + f(f(f(w) * x[int(src[1:]), i]) * f(layer.relations[t][i][o])))
            out[v, o] = max(f(0), s)
    return out


def test_strict_layer_adds_in_order(spark):
    x, nodes, relations, rel, layer = random_program(spark)
    want = sequential(x, rel, layer)
    got = {r["key"]: r["y"] for r in mp.strict_layer(nodes, relations, layer).collect()}
    assert all(np.float32(got[f"n{k:02}"][o]) == want[k, o] for k in range(len(x)) for o in (0, 1))
    free = {r["key"]: r["y"] for r in mp.apply_layer(nodes, relations, layer).collect()}
    assert all(abs(free[k][o] - got[k][o]) < 1e-2 for k in got for o in (0, 1))
    with pytest.raises(Exception, match="spec.relation_transform.missing"):
        mp.strict_layer(nodes, relations, mp.Layer(3, 2, {"a": layer.relations["a"]})).collect()
    with pytest.raises(Exception, match="spec.relation_transform.missing"):
        mp.apply_layer(nodes, relations, mp.Layer(3, 2, {"a": layer.relations["a"]})).collect()


def test_chunks_give_what_the_whole_gives(spark):
    _, nodes, relations, _, layer = random_program(spark)
    whole = {r["key"]: r["y"] for r in mp.apply_layer(nodes, relations, layer).collect()}
    for core in (1, 7, 100):
        got = {r["key"]: r["y"] for r in mp.apply_chunked(nodes, relations, layer, core).collect()}
        assert set(got) == set(whole) and all(got[k] == pytest.approx(whole[k]) for k in whole)
    twice = nodes.unionByName(nodes.limit(1))
    with pytest.raises(Exception):
        mp.apply_chunked(twice, relations, layer, 7).collect()


def test_basis_is_loaded_from_its_roots(spark):
    g = PropertyGraph.of(spark, ["NodeTypes", "NodeTypes/Ship", "NodeTypes/Ship/Definition", "NodeTypes/Port", "EdgeTypes", "EdgeTypes/Calls", "x"])
    got = {(r["type_gid"], r["kind"], r["label"]) for r in view.load_basis(g, "NodeTypes", "EdgeTypes").collect()}
    assert got == {("NodeTypes/Ship", "Node", "Ship"), ("NodeTypes/Port", "Node", "Port"), ("EdgeTypes/Calls", "Edge", "Calls")}
    assert view.load_basis(g, " ", None).count() == 0
    stray = PropertyGraph(g.base, spark.createDataFrame([("NodeTypes/Ship", "x")], "a_gid string, b_gid string"))
    with pytest.raises(Exception, match="no type of the basis"):
        view.load_basis(stray, "NodeTypes").collect()


def test_requirements_and_built_in_types(spark):
    t = spark.createDataFrame([TypeBuilder("NodeTypes/A").requires("NodeTypes/B", "NodeTypes/B").row(), TypeBuilder("NodeTypes/B").row(), TypeBuilder("NodeTypes/C").row()], semantic.TYPES)
    assert semantic.require(semantic.require(t, "NodeTypes/C", "NodeTypes/B"), "NodeTypes/C", "NodeTypes/B").where("type_gid = 'NodeTypes/C'").first()["required"] == ["NodeTypes/B"]
    with pytest.raises(semantic.SemanticError):
        semantic.require(t, "NodeTypes/A", "NodeTypes/B")
    with pytest.raises(LookupError):
        semantic.require(t, "NodeTypes/C", "NodeTypes/Nothing")
    own = semantic.built_in(spark)
    assert {(r["type_gid"], r["role"]) for r in semantic.edge_definition(own).collect()} == {("NodeTypes/InstanceOf", "Instance"), ("NodeTypes/InstanceOf", "Type"), ("NodeTypes/Requires", "Derived"), ("NodeTypes/Requires", "Required")}
    assert semantic.without_built_in(semantic.bootstrap(t, own)).count() == 3


def test_selection_commands(spark):
    t = [TypeBuilder("NodeTypes/Port").row(), TypeBuilder("NodeTypes/Calls", "Edge").field("A", node=True).field("B", node=True).row()]
    s = Service(PropertyGraph.of(spark, ["p", "q"]), types=spark.createDataFrame(t, semantic.TYPES))
    nodes, none = selection.Selection(["p", "q"]), selection.Selection()
    assert selection.offered(none) == ["create-node"] and selection.offered(nodes) == ["create-node", "clear-selection", "delete-selection", "assign-node-type"]
    assert selection.offered(selection.Selection([], [("p", "q")])) == ["clear-selection", "delete-selection", "assign-edge-type"]
    assert selection.run(s, "create-node", nodes, local_id="n", type_gid="NodeTypes/Port")[0] == 200 and links(s.graph) == [("n", "p"), ("n", "q")]
    assert selection.run(s, "assign-node-type", nodes, type_gid="NodeTypes/Port")[0] == 200 and s.facets.count() == 3
    assert selection.run(s, "assign-edge-type", selection.Selection([], [("n", "p")]), type_gid="NodeTypes/Calls")[0] == 200 and links(s.graph) == [("n", "q")]
    assert selection.run(s, "connect-nodes", selection.Selection(["p"]), target="q")[0] == 200 and ("p", "q") in links(s.graph)
    assert selection.run(s, "connect-nodes", nodes, target="q")[0] == 400 and selection.run(s, "delete-selection", nodes)[0] == 400
    assert selection.run(s, "delete-selection", selection.Selection(["p"], [("n", "q")]), confirmed=True) == (200, none)
    assert links(s.graph) == [] and sorted(r["gid"] for r in s.graph.base.collect()) == ["n", "q"]
    assert selection.run(s, "clear-selection", nodes) == (204, none)
    assert s.handle("GET", "/api/ui/settings")[1]["basis"] == {"nodeTypeRoot": "NodeTypes"}


def test_nodes_of_one_name_are_told_apart_by_their_paths(spark):
    g = PropertyGraph.of(spark, ["a", "b", "a/Same", "b/same", "z"], [("a/Same", "z"), ("b/same", "z")])
    v = lambda n: {"kind": "var", "name": n}
    found = lambda where, *r: sorted(tuple(x[c] for c in r) for x in plans.solutions(g, {"return": list(r), "where": where}).collect())
    assert found({"kind": "connected", "left": v("x"), "right": {"kind": "literal", "name": "Z"}}, "x") == [("a/Same",), ("b/same",)]
    assert found({"kind": "connected", "left": {"kind": "literal", "name": "A/sAME"}, "right": v("x")}, "x") == [("a",), ("z",)]
    pair = {"kind": "all", "expressions": [{"kind": "connected", "left": v("x"), "right": v("z")}, {"kind": "same", "left": v("z"), "right": {"kind": "literal", "name": "Z"}}]}
    assert found(pair, "x") == [("a/Same",), ("b/same",)]
    unlike = {"kind": "all", "expressions": [{"kind": "connected", "left": v("x"), "right": {"kind": "literal", "name": "z"}}, {"kind": "notSame", "left": v("x"), "right": {"kind": "literal", "name": "A/SAME"}}]}
    assert found(unlike, "x") == [("b/same",)]


def test_clear_neighbours_takes_what_lies_below(spark):
    g = PropertyGraph.of(spark, ["o", "lonely", "lonely/x", "lonely/x/y", "shared", "t"], [("lonely", "o"), ("shared", "o"), ("shared", "t"), ("lonely/x/y", "t")])
    out = clear_neighbours(g, "o")
    assert "lonely" in {r["gid"] for r in out.base.collect()}  # it has a child beside the owner
    alone = PropertyGraph.of(spark, ["o", "lonely", "shared", "t"], [("lonely", "o"), ("shared", "o"), ("shared", "t")])
    out = clear_neighbours(alone, "o")
    assert {r["gid"] for r in out.base.collect()} == {"o", "shared", "t"} and links(out) == [("shared", "t")]
    assert issubclass(GraphError, ValueError)


def test_live_collections(spark):
    s = Service(PropertyGraph.of(spark, ["o", "o/c", "p", "p/Q", "q", "t"], [("o", "p"), ("p", "t")]))
    near, edges = Neighbours(s, "o"), Links(s, "o")
    assert list(near) == ["o/c", "p"] and "p" in near and "q" not in near
    near.add("q")
    assert near.create("d", {"k": "v"}) == "o/d" and list(near) == ["o/c", "o/d", "p", "q"]
    for bad in (lambda: near.add("q"), lambda: near.add("p/Q"), lambda: near.create("c"), lambda: edges.remove("t"), lambda: near.remove("t")):
        with pytest.raises(GraphError):
            bad()
    near.remove("p")  # it has others beside it
    near.remove("q")  # it has not
    assert list(near) == ["o/c", "o/d"] and "p" in {r["gid"] for r in s.graph.base.collect()} and "q" not in {r["gid"] for r in s.graph.base.collect()}
    edges.add("t")
    assert list(edges) == [("o", "t")] and ("t", "o") in edges
    edges.remove("t")
    edges.add("p")
    edges.clear()
    assert list(edges) == [] and list(Links(s, "p")) == [("p", "t")]


def test_one_record_is_read_by_its_name(spark, tmp_path):
    store = tmp_path / "store"
    records.open_store(spark, str(store))
    place = store / "elements"
    place.mkdir()
    one = {"id": "e", "kind": "Instance", "type_ids": ["T"], "attributes": {"k": "v"}, "members": {}}
    name = place / f"{hashlib.sha256(b'e').hexdigest()}.json"
    name.write_text(json.dumps(one))
    assert records.read_element(spark, str(place), "e").first()["attributes"] == {"k": "v"}
    assert [r["id"] for r in records.read_elements(spark, str(place)).collect()] == ["e"]
    with pytest.raises(LookupError):
        records.read_element(spark, str(place), "f")
    name.write_text(json.dumps({**one, "id": "E"}))
    with pytest.raises(Exception, match="Corrupt"):
        records.read_element(spark, str(place), "e").collect()
    name.write_text(json.dumps(one)[:-2] + "}, \"members\": {}}")
    with pytest.raises(Exception, match="Corrupt"):
        records.read_elements(spark, str(place)).collect()
    (store / f".{records.MARKER}.crc").unlink()
    (store / records.MARKER).write_text(json.dumps({"version": 9}))
    with pytest.raises(records.FormatError):
        records.read_element(spark, str(place), "e")


def test_types_from_schemas_and_the_register(spark):
    from pyspark.sql.types import _parse_datatype_string

    b = contracts.from_schema("Ship", _parse_datatype_string("name string not null, size int, tags array<string>, home struct<x: int>, price decimal(9,2)"))
    assert [(f[0], f[1], f[2], f[3], f[4]) for f in b.fields] == [("name", "Primitive", "string", 1, 1), ("size", "Primitive", "int", 0, 1), ("tags", "Primitive", "string", 0, None), ("home", "Node", None, 0, 1), ("price", "Primitive", "decimal", 0, 1)]
    contracts.register_type(b)
    contracts.register_type({"name": "Port", "fields": [{"name": "depth", "clrType": "int"}]})
    with pytest.raises(contracts.ContractTextError):
        contracts.register_type(TypeBuilder("NodeTypes/SHIP"))
    rows = [r for r in contracts.registered() if r[0] in ("NodeTypes/Ship", "NodeTypes/Port")]
    assert [r[0] for r in rows] == ["NodeTypes/Port", "NodeTypes/Ship"] and spark.createDataFrame(rows, semantic.TYPES).count() == 2


def test_statistics(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(1, 11)] + [("b", 5.0), ("b", None)], "op string, v double")
    got = {r["op"]: r for r in measure.statistics(df, ["op"], df["v"]).collect()}
    assert (got["a"]["n"], got["a"]["least"], got["a"]["mean"], got["a"]["p50"], got["a"]["p95"], got["a"]["most"]) == (10, 1.0, 5.5, 5.5, pytest.approx(9.55), 10.0)
    assert got["b"]["n"] == 1 and got["b"]["p95"] == 5.0
    assert measure.statistics(df, ["op"], df["v"], accuracy=100).where("op = 'a'").first()["p50"] in (5.0, 6.0)


def test_late_changes_are_left_out(spark, tmp_path):
    place = tmp_path / "in"
    place.mkdir()
    schema = "ts timestamp, op string, a_gid string, b_gid string"
    rows = lambda *ts: "".join(json.dumps({"ts": f"2024-01-01T{t}:00Z", "op": "add", "a_gid": "a", "b_gid": "b"}) + "\n" for t in ts)
    for k, ts in enumerate([("10:01", "10:02"), ("12:30",), ("12:31",), ("10:03",)]):  # 10:03 comes two hours late
        (place / f"{k}.json").write_text(rows(*ts))
        time.sleep(1.1)  # files are taken by their times
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(place))
    got = {r["window"]["start"].strftime("%H:%M"): r["n"] for r in changes.window_table(stream(), str(tmp_path / "w"), "1 hour", "10 minutes").collect()}
    assert got == {"10:00": 2, "12:00": 2}
    slid = {r["window"]["start"].strftime("%H:%M"): r["n"] for r in changes.window_table(stream(), str(tmp_path / "s"), "1 hour", "10 minutes", "30 minutes").collect()}
    assert slid == {"09:30": 2, "10:00": 2, "12:00": 2, "12:30": 2}
    again = changes.window_table(stream(), str(tmp_path / "w"), "1 hour", "10 minutes")  # nothing new came
    assert sorted(r["n"] for r in again.collect()) == [2, 2]


def test_running_work_can_be_cancelled(spark):
    failed: list[str] = []

    def work():
        with cancellable(spark, "slow"):
            try:
                spark.range(0, 8, 1, 8).selectExpr("count(java_method('java.lang.Thread', 'sleep', cast(20000 as bigint)))").collect()
            except Exception as e:
                failed.append(str(e))

    t = threading.Thread(target=work)
    t.start()
    for _ in range(100):
        time.sleep(0.2)
        if cancel(spark, "slow") or not t.is_alive():
            break
    t.join(30)
    assert failed and not t.is_alive()


def test_small_helpers(spark):
    assert scalars.spark_type("System.Int32") == "INT" and scalars.kind_of("long") == "Int64" and scalars.kind_of("guid") == "Guid"
    with pytest.raises(ValueError):
        scalars.spark_type("nothing")
    with pytest.raises(NotImplementedError):
        scalars.kind_of("timespan")
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (1, ["c"]), (2, [])], "k int, t array<string>")
    assert [r[0] for r in df.select(mp.canonical_types(df["t"])).collect()] == [["a", "b"], ["c"], []]
    assert view.chosen_first(df, ["k"], ["t"]).count() == 2
    one, two = (spark.createDataFrame([(t,)], "t array<string>").select(names.fingerprint(F.col("t"))).first()[0] for t in (["b", "a"], ["a", "b"]))
    assert one == two and len(one) == 64


def test_reading_a_node_without_its_required_facets_is_an_error(spark):
    g = PropertyGraph.of(spark, ["a", "b"])
    types = spark.createDataFrame([("NodeTypes/P", "Node", False, [], [], []), ("NodeTypes/C", "Node", False, ["NodeTypes/P"], [], [])], semantic.TYPES)
    facets = spark.createDataFrame([("a", "NodeTypes/C", "w1"), ("a", "NodeTypes/P", "w2"), ("b", "NodeTypes/C", "w3")], semantic.FACETS)
    with pytest.raises(Exception, match="missing materialized required types: b lacks NodeTypes/P"):
        semantic.project(g, types, facets).collect()
    assert {r["type_gid"] for r in semantic.project(g, types, facets, only=["a"]).collect()} == {"NodeTypes/C", "NodeTypes/P"}


def test_changes_refuse_repeated_rows_and_missing_ends(spark):
    from weft.operators import mutate, typed

    g = PropertyGraph.of(spark, ["a", "a/b", "c"], [("a/b", "c")])
    rows = spark.createDataFrame([("a", {"k": "1"}), ("a", {"k": "2"})], "gid string, attrs map<string,string>")
    with pytest.raises(GraphError, match="named twice"):
        mutate.update_attributes(g, rows)
    for old, new, why in (("a/b", "nowhere/b", "parent does not exist"), ("x", "c/x", "node does not exist"), ("a/b", "c", "place is taken")):
        with pytest.raises(GraphError, match=why):
            mutate.move(g, old, new)
    assert sorted(r["gid"] for r in mutate.move(g, "a/b", "top").base.collect()) == ["a", "c", "top"]
    types = spark.createDataFrame([("T", "Instance", False, [], [], [("k", "String", False)])], typed.TYPES)
    store = typed.TypedGraph(types, spark.createDataFrame([("e", "Instance", ["T"], {"k": "0"}, {})], typed.ELEMENTS))
    twice = spark.createDataFrame([("e", {"k": "1"}), ("e", {"k": "2"})], "id string, attributes map<string,string>")
    with pytest.raises(typed.ContractError, match="named twice"):
        store.replace_attributes(twice)
    assert store.replace_attributes(twice.limit(1)).elements.count() == 1
