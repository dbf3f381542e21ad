"""Mutations, the semantic layer, views, records, contracts and streams on tiny graphs."""

import json
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from weft.functions import names
from weft.operators import mutate, semantic, traverse, view
from weft.plans import contracts
from weft.plans.compile import search
from weft.sources import records, sinks
from weft.sources.graph import PropertyGraph
from weft.streaming import changes


def gids(df):
    return {r["gid"] for r in df.select("gid").collect()}


def pairs(df):
    return {(r["a_gid"], r["b_gid"]) for r in df.select("a_gid", "b_gid").collect()}


def link(spark, *rows):
    return spark.createDataFrame(list(rows), "a_gid string, b_gid string")


def test_subgraph_and_traverse(spark):
    g = PropertyGraph.of(spark, ["first", "second", "third", "fourth", "root", "root/weapons", "root/weapons/ak_47"], [("first", "second"), ("second", "third"), ("third", "fourth")])
    assert gids(traverse.subgraph(g, ["first"], 2)) == {"first", "second", "third"}
    assert gids(traverse.subgraph(g, ["root"], 2)) == {"root", "root/weapons", "root/weapons/ak_47"}
    assert gids(traverse.subgraph(g, [], 0)) == {"first", "second", "third", "fourth", "root"}
    assert gids(traverse.subgraph(g, ["first"], -1)) == {"first"}
    with pytest.raises(LookupError):
        traverse.subgraph(g, ["first", "nowhere"], 1)
    assert gids(traverse.traverse(g, "first")) == {"first", "second", "third", "fourth"}
    assert gids(g.resolve("root/weapons")) == {"root/weapons"} and gids(g.resolve("first/second/third")) == {"third"}


def test_changes_to_a_graph(spark):
    g = PropertyGraph.of(spark, ["a", "a/x", "a/x/deep", "b", "c"], [("a/x", "b"), ("a/x/deep", "c")])
    moved = mutate.disconnect(g, "a", "a/x")  # a hierarchy edge: the child moves to its one other neighbour
    assert gids(moved.base) == {"a", "b", "b/x", "b/x/deep", "c"} and pairs(moved.links) == {("b/x/deep", "c")}
    assert pairs(mutate.delete_subtrees(g, ["a/x"]).links) == set() and gids(mutate.delete_subtrees(g, ["a/x"]).base) == {"a", "b", "c"}
    for bad in [("a", "a/x/deep"), ("b", "a/x")]:
        with pytest.raises(mutate.GraphError):
            mutate.connect(g, link(spark, bad))
    h = PropertyGraph.of(spark, ["o", "p", "p/n", "q", "q/N"], [("o", "p/n")])
    with pytest.raises(mutate.GraphError):  # the slot is taken, case ignored
        mutate.connect(h, link(spark, ("o", "q/N")))
    assert pairs(mutate.connect(h, link(spark, ("o", "o"), ("o", "zz"), ("q", "o"))).links) == {("o", "p/n"), ("o", "q")}
    t = PropertyGraph.of(spark, ["s", "s/m", "s/m/k", "t"], [("s/m", "t"), ("s/m/k", "t")])
    with pytest.raises(mutate.GraphError):  # the link to t would join ancestor and descendant
        mutate.relocate(t, "s/m")
    assert gids(mutate.remove_neighbour(g, "c", "a/x/deep").base) == gids(g.base)
    alone = PropertyGraph.of(spark, ["u", "v"], [("u", "v")])
    assert gids(mutate.remove_neighbour(alone, "u", "v").base) == {"u"} and gids(mutate.clear_neighbours(alone, "u").base) == {"u"}
    staged = PropertyGraph.of(spark, ["one", "two"], [("one", "two")])
    assert gids(mutate.attach(alone, "u", staged).base) == {"u", "v", "u/one", "u/two"}
    with pytest.raises(mutate.GraphError):
        mutate.create_nodes(alone, spark.createDataFrame([("zz/y", {})], "gid string, attrs map<string,string>"))
    with pytest.raises(mutate.GraphError):
        mutate.create_nodes(alone, spark.createDataFrame([("CON", {})], "gid string, attrs map<string,string>"))


def semantic_types(spark, *builders):
    return spark.createDataFrame([b.row() for b in builders], semantic.TYPES)


def test_facets_edges_and_cascade(spark):
    B = contracts.TypeBuilder
    t = semantic_types(
        spark, B("NodeTypes/Root"), B("NodeTypes/Left").requires("NodeTypes/Root"), B("NodeTypes/Leaf").requires("NodeTypes/Left"), B("NodeTypes/Base").abstract(),
        B("NodeTypes/Ship", "Edge").field("Goods", node_type="NodeTypes/Leaf").field("To", node=True, card="oneOrMore").field("Note", card="optional"),
    )
    g = PropertyGraph.of(spark, ["NodeTypes", "n", "m", "k"], [])
    none = spark.createDataFrame([], semantic.FACETS)
    rows = spark.createDataFrame([("n", "NodeTypes/Leaf")], "node_gid string, type_gid string")
    f = semantic.assign(g, t, none, rows)
    assert {r["type_gid"] for r in f.collect()} == {"NodeTypes/Leaf", "NodeTypes/Left", "NodeTypes/Root"}
    assert semantic.assign(g, t, f, rows).count() == 3
    later = semantic.require(t, "NodeTypes/Root", "NodeTypes/Base")
    assert {(r["node_gid"], r["type_gid"]) for r in semantic.missing_facets(later, f).collect()} == {("n", "NodeTypes/Base")}
    with pytest.raises(semantic.SemanticError):
        semantic.assign(g, t, none, spark.createDataFrame([("n", "NodeTypes/Base")], "node_gid string, type_gid string"))
    empty = semantic.Edges(spark.createDataFrame([], semantic.RELATIONS), spark.createDataFrame([], semantic.MEMBERS))
    rel = lambda i: spark.createDataFrame([(i, "NodeTypes/Ship", {})], semantic.RELATIONS)
    mem = lambda *r: spark.createDataFrame(list(r), semantic.MEMBERS)
    e = semantic.add_relations(t, f, empty, rel("r"), mem(("r", "Goods", "n"), ("r", "To", "m"), ("r", "To", "k")))
    assert {r["role"]: r["participants"] for r in semantic.read_edge(t, e, "r").collect()} == {"Goods": ["n"], "To": ["k", "m"]}
    for bad in [(("x", "Goods", "m"), ("x", "To", "k")), (("x", "Goods", "n"),), (("x", "Goods", "n"), ("x", "To", "m"), ("x", "Odd", "m"))]:
        with pytest.raises(semantic.SemanticError):
            semantic.add_relations(t, f, e, rel("x"), mem(*bad))
    g2, left = semantic.delete_nodes(g, e, ["m"])
    assert left.relations.count() == left.members.count() == 0 and gids(g2.base) == {"NodeTypes", "n", "k"}
    raw = PropertyGraph.of(spark, ["n", "k"], [("k", "n")])
    g3, e3 = semantic.change_edge_type(raw, t, f, empty, "NodeTypes/Ship", {"Goods": ["n"], "To": ["k"]}, "s")
    assert g3.links.count() == 0 and e3.relations.first()["rel_gid"] == "s"
    types, elements = semantic.to_strict(t.where("type_gid <> 'NodeTypes/Base'"), f, g, e)
    assert elements.where("id = 'r'").first()["members"] == {"Goods": ["n"], "To": ["k", "m"]} and types.where("kind = 'Relation'").first()["attributes"][0]["kind"] == "String"
    # A link between a node and a type is a facet; a type outside the basis is not seen.
    linked = PropertyGraph.of(spark, ["NodeTypes", "NodeTypes/Root", "Other", "n"], [("n", "NodeTypes/Root"), ("n", "Other")])
    t2 = semantic_types(spark, B("NodeTypes/Root"), B("Other"))
    assert {r["type_gid"] for r in semantic.project(linked, t2, none).collect()} == {"NodeTypes/Root"}
    assert {r["type_gid"] for r in semantic.project(linked, t2, none, ["Other"]).collect()} == {"Other"}
    assert semantic.is_type(linked, "NodeTypes/Root") and not semantic.is_type(linked, "n")
    assert semantic.bootstrap(t2, t2).count() == 2


def test_views(spark):
    basis = spark.createDataFrame([("T/Link", "Edge", "link", 40.0, True, True, []), ("T/Item", "Node", "item", 60.0, True, False, ["name"])], view.BASIS)
    nodes = {"a": {"name": "A"}, "b": {}, "T": {}, "T/Item": {}, "T/Link": {}, "r": {}, "r/s": {"role": "source"}, "r/t": {"role": "target"}}
    g = PropertyGraph.of(spark, nodes, [("a", "T/Item"), ("b", "T/Item"), ("r", "T/Link"), ("r/s", "a"), ("r/t", "b")])
    e = g.edges.select("a_gid", "b_gid")
    r = view.relations(g.nodes, e, basis).collect()
    assert [(x["rel_gid"], x["type_gid"], x["a_gid"], x["b_gid"]) for x in r] == [("r", "T/Link", "a", "b")]
    n, edges = view.project(g.nodes, e, basis)
    assert gids(n) == {"a", "b", "T", "T/Item"} and n.where("gid = 'a'").first()["label"] == "item"
    assert [tuple(x) for x in edges.where("projected").select("a_gid", "b_gid", "type_gid").collect()] == [("a", "b", "T/Link")]
    assert {(x["node_gid"], x["value"]) for x in view.record_fields(g.nodes, e, basis).collect()} >= {("a", "A"), ("b", "")}
    chain = PropertyGraph.of(spark, list("abcd"), [("a", "b"), ("b", "c"), ("c", "d"), ("b", "d")])
    ce = chain.edges.select("a_gid", "b_gid")
    assert gids(view.collapse(chain.nodes, ce, "a", "b")) == {"b", "c", "d"} and gids(view.collapse(chain.nodes, ce, "b", "c")) == set()
    roots = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "2"), ("d", "2")], "gid string, root_component string")
    assert gids(view.collapse(chain.nodes, ce, "a", "b", roots)) == {"c", "d"}
    ranked, _ = view.rank(spark.createDataFrame([("a", "t", None), ("b", None, 5.0)], "gid string, type_gid string, type_rank double"), spark.createDataFrame([("a", "b", None, True)], "a_gid string, b_gid string, type_rank double, projected boolean"), "a", "b")
    import math

    assert {x["gid"]: x["rank"] for x in ranked.collect()} == {"a": round(50 + 8 * math.log1p(35) + 18 + 12.25, 1), "b": round(5 + 8 * math.log1p(35) + 30, 1)}
    p = spark.createDataFrame([("a", 0.0, 0.0, 0.0, 0.0), ("b", 200.0, 0.0, 0.0, 0.0)], "gid string, x double, y double, vx double, vy double")
    after = {x["gid"]: x for x in view.force_step(p, link(spark, ("a", "b")), 200, 100).collect()}
    assert after["a"]["x"] > 0 and after["b"]["x"] < 200


def test_records_and_backup(spark, tmp_path):
    from weft.operators import typed

    path = tmp_path / "types"
    path.mkdir()
    good = {"type_id": "T", "kind": "Instance", "is_abstract": False, "required_type_ids": [], "members": [], "attributes": []}
    import hashlib

    name = hashlib.sha256(b"T").hexdigest() + ".json"
    (path / name).write_text(json.dumps(good))
    assert records.read_types(spark, str(path)).first()["type_id"] == "T"
    for bad in [json.dumps({**good, "extra": 1}), json.dumps(good)[:-1] + ', "kind": "Instance"}', json.dumps({**good, "kind": None}), "{"]:
        (path / name).write_text(bad)
        with pytest.raises(Exception, match="Corrupt"):
            records.read_types(spark, str(path)).collect()
    (path / name).write_text(json.dumps({**good, "type_id": "U"}))
    with pytest.raises(Exception, match="Corrupt"):  # not the file of this id
        records.read_types(spark, str(path)).collect()
    assert typed.STATUS["Unsupported"] == 501
    store = str(tmp_path / "store")
    records.open_store(spark, store)
    records.open_store(spark, store)
    with pytest.raises(records.FormatError):
        records.open_store(spark, str(path))
    g = PropertyGraph.of(spark, {"p": {}, "p/c": {}, "source": {"label": "x"}, "target": {}}, [("source", "target")])
    records.save_backup(g, str(tmp_path / "backup"))
    back = records.load_backup(spark, str(tmp_path / "backup"))
    assert {r["gid"]: r["attrs"] for r in back.base.collect()} == {"p": {}, "p/c": {}, "source": {"label": "x"}, "target": {}} and pairs(back.links) == {("source", "target")}
    (tmp_path / "bad.json").write_text(json.dumps({"version": 1, "nodes": [{"path": ["a"], "attributes": {}}], "edges": [{"source": ["a"], "target": ["b"]}]}))
    with pytest.raises(records.FormatError):
        records.load_backup(spark, str(tmp_path / "bad.json"))
    sinks.write_version(g.base, str(tmp_path / "table"))
    sinks.write_version(g.base.limit(1), str(tmp_path / "table"))
    assert sinks.read_latest(spark, str(tmp_path / "table")).count() == 1
    assert json.loads(next(sinks.stream_lines(search(g, {"return": ["n"], "limit": 1}))))["n"] == "p"


def test_contracts():
    assert [contracts.cardinality(x) for x in ("required", "optional", "many", "oneOrMore", "2..5", "1..*", {"min": 1, "max": 2})] == [(1, 1), (0, 1), (0, None), (1, None), (2, 5), (1, None), (1, 2)]
    for bad in ("5..2", "some", {"min": -1}):
        with pytest.raises(contracts.ContractTextError):
            contracts.cardinality(bad)

    @dataclass
    class Country:
        name: str

    @dataclass
    class Maker:
        home: Country
        aliases: list[str]
        founded: int
        site: str | None = None

    Maker.__annotations__ = {"home": Country, "aliases": list[str], "founded": int, "site": str | None}
    b = contracts.from_dataclass(Maker)
    assert [(f[0], f[1], f[3], f[4]) for f in b.fields] == [("home", "Node", 1, 1), ("aliases", "Primitive", 0, None), ("founded", "Primitive", 1, 1), ("site", "Primitive", 0, 1)]
    attrs, links = contracts.creation_plan(b.fields, {"Home": "c", "aliases": ["x", "y"], "founded": 1900})
    assert attrs == {"aliases": '["x", "y"]', "founded": "1900"} and links == {"home": ["c"]}
    for bad in ({"home": "c"}, {"home": "c", "founded": 1, "odd": 2}, {"home": ["c", "d"], "founded": 1}):
        with pytest.raises(contracts.ContractTextError):
            contracts.creation_plan(b.fields, bad)
    t = contracts.parse_type({"name": "X", "fields": [{"name": "f", "nodeType": "NodeTypes/Y", "cardinality": "many"}, {"name": "g", "clrType": "System.Int32"}], "slots": [{"name": "s", "allowedTypes": ["NodeTypes/Y"]}]})
    assert t.type_gid == "NodeTypes/X" and t.fields[0][5] and t.slots == [("s", ["NodeTypes/Y"], 1, 1)]
    assert contracts.profile(None, "raw") == "Raw" and contracts.profile("", None) == "Semantic"


def test_name_functions(spark):
    df = spark.createDataFrame([("SemanticWeapon", ["p-1", "p-3"], r"\a\b/")], "n string, taken array<string>, raw string")
    row = df.select(names.kebab(F.col("n")), names.next_free("p", F.col("taken")), names.normalized(F.col("raw")), names.stripped_type_name(F.lit("WeaponNodeType"))).first()
    assert tuple(row) == ("semantic-weapon", "p-2", "a/b", "Weapon")
    words = [("ok name", True), (" lead", False), ("dot.", False), ("a#b", False), ("com1.txt", False), ("..", False), ("Ünï-1_x", True)]
    got = spark.createDataFrame(words, "n string, ok boolean").select((names.valid_segment(F.col("n")) == F.col("ok")).alias("same")).collect()
    assert all(x["same"] for x in got)


def test_change_stream(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "add", "b", "a"), ("2024-01-01 00:00:05", "remove", "a", "b"), ("2024-01-01 00:01:30", "add", "c", "d")]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "ts string, op string, a_gid string, b_gid string").select(F.col("ts").cast("timestamp").alias("ts"), "op", "a_gid", "b_gid").write.parquet(src)
    seen = []
    stream = lambda: spark.readStream.schema(changes.CHANGES).parquet(src)
    q = changes.on_batches(stream(), lambda df, n: seen.append(sorted(tuple(r) for r in df.collect())), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert seen == [[("a", "b", "remove"), ("c", "d", "add")]]
    q = changes.windowed(stream(), "1 minute", "10 seconds").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck2")).start()
    q.awaitTermination(60)
    assert sum(r["n"] for r in spark.table("w").collect()) == 3
    assert pairs(changes.applied(link(spark, ("a", "b"), ("x", "y")), spark.read.parquet(src))) == {("x", "y"), ("c", "d")}


def test_slots_come_in_one_order(spark):
    """Ambiguous slots are pairs by place, so the places must not depend on which type a task meets first."""
    slot = lambda k: [("load", [f"NodeTypes/Box-{k}", "NodeTypes/Box"], 0, k)]
    made = [(f"NodeTypes/Car-{k}", "Node", False, [], [], slot(k)) for k in range(6)]
    van = ("NodeTypes/Van", "Node", False, [m[0] for m in made], [], [])
    read = lambda rows: {r["type_gid"]: [s["max"] for s in r["slots"]] for r in semantic.effective_slots(spark.createDataFrame(rows, semantic.TYPES).coalesce(1)).collect()}
    one, two = read([van, *made]), read([*made[::-1], van])
    assert one == two and one["NodeTypes/Van"] == list(range(6))
    assert [tuple(r) for r in semantic.ambiguous_slots(spark.createDataFrame([van, *made], semantic.TYPES)).collect()] == [("NodeTypes/Van", "load")]


def test_line_pairs_are_made_distinct_by_tasks_of_bounded_rows(spark, monkeypatch):
    """No hash table before the rows are moved, and more tasks than partitions where there are more rows; suppliers are the small side."""
    from weft.plans import session

    monkeypatch.setattr(session, "DISTINCT_ROWS", 10)
    df = spark.range(95).selectExpr("id % 30 as a", "id % 2 as b")
    got = session.distinct_of(df, 95)
    assert got.rdd.getNumPartitions() == 10 and sorted(map(tuple, got.collect())) == sorted((k, k % 2) for k in range(30))
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Aggregate" in plan and "Aggregate" not in plan[plan.index("Exchange"):]
