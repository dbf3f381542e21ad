"""What grows with a table is neither brought together nor moved where it need not be."""

import pytest
from pyspark.sql import functions as F

from tests.test_search import All, Attr, Conn, V
from weft.operators import message_passing as mp
from weft.operators import view
from weft.plans import compile as plans
from weft.plans import conjunction, session, templates
from weft.sources import placed, records
from weft.sources.graph import PropertyGraph


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def star(spark, names):
    nodes = {n: {"kind": n[0].lower()} for n in names}
    return PropertyGraph.of(spark, nodes, [(a, b) for a in names for b in names if a < b and a[0] != b[0]])


CHAIN = {"return": ["a", "b", "c"], "where": All(Conn(V("a"), V("b")), Conn(V("b"), V("c")), *(Attr(V(v), "kind", v) for v in "abc"))}


def test_matches_with_keys_of_their_own_are_not_brought_together(spark):
    g = star(spark, ["A1", "A2", "B1", "B2", "C1"])
    found = plans.solutions(g, CHAIN)
    assert "matched" not in "".join(x for x in plan(found).splitlines() if "Aggregate" in x)
    assert sorted((r["a"], r["b"], r["c"]) for r in found.collect()) == [(a, b, "C1") for a in ("A1", "A2") for b in ("B1", "B2")]


def test_matches_that_differ_in_case_are_one(spark):
    g = star(spark, ["A1", "a1", "B1", "C1"])
    assert not g.told_apart
    assert [(r["a"], r["b"], r["c"]) for r in plans.solutions(g, CHAIN).collect()] == [("A1", "B1", "C1")]


@pytest.mark.parametrize("ahead", [1, 4])
def test_limited_search_keeps_few_rows(spark, monkeypatch, ahead):
    """With the whole range brought together, one group for each solution is made; with the least rows, no more than these."""
    names = [f"A{k:02d}" for k in range(12)] + ["B1", "b1"]
    q = templates.neighbour_connected(7)
    want = [tuple(r) for r in plans.solutions(star(spark, names), q).orderBy("ord").limit(7).select("n", "x", "z").collect()]
    monkeypatch.setattr(plans, "AHEAD", ahead)
    sizes, firsts = [], plans._firsts
    monkeypatch.setattr(plans, "_firsts", lambda df, q: (sizes.append(df.count()), firsts(df, q))[1])
    assert [tuple(r) for r in plans.search(star(spark, names), q).select("n", "x", "z").collect()] == want
    assert sizes[0] <= 7 * ahead


def test_a_candidate_table_too_large_to_broadcast_meets_what_the_other_side_left(spark, monkeypatch):
    """Else Spark moves the whole adjacency for the semi-join."""
    for module in (conjunction, placed):
        monkeypatch.setattr(module, "SMALL", 3)
    names = ["A1", *(f"B{k}" for k in range(4)), *(f"C{k}" for k in range(6))]
    g = star(spark, names)
    assert g.placed.hub
    made, within = [], conjunction.Conjunction._within
    monkeypatch.setattr(conjunction.Conjunction, "_within", lambda self, df, sides: (made.append(within(self, df, sides)), made[-1])[1])
    assert plans.solutions(g, CHAIN).count() == 24
    text = plan(made[0])
    assert "LeftSemi" in text and text.index("LeftSemi") < text.index("Join Inner")


def test_view_moves_the_ends_of_edges_alone(spark):
    g = PropertyGraph.of(spark, {n: {} for n in ("T", "U", "T/x", "n", "m")}, [("n", "T"), ("n", "m"), ("T/x", "m"), ("U", "m")])
    basis = spark.createDataFrame([("T", "Node", "T", None, True, True, []), ("U", "Node", "U", None, False, False, [])], view.BASIS)
    rows = lambda **o: sorted(tuple(r) for r in view.project(g.nodes, g.edges, basis, **o)[1].collect())
    edges = view.project(g.nodes, g.edges, basis, unique=True)[1]
    assert "first(" not in plan(edges)
    assert rows(unique=True) == rows() == [("m|n", "m", "n", None, False)]


def test_view_makes_one_edge_of_a_key_that_two_pairs_share(spark):
    g = PropertyGraph.of(spark, {n: {} for n in ("a|b", "c", "a", "b|c")}, [("a|b", "c"), ("a", "b|c")])
    empty = spark.createDataFrame([], view.BASIS)
    assert [r["key"] for r in view.project(g.nodes, g.edges, empty, unique=True)[1].collect()] == ["a|b|c"]


def test_a_backup_is_parsed_once(spark, tmp_path):
    records.save_backup(star(spark, ["A1", "B1", "C1"]), f"file://{tmp_path}/b")
    back = records.load_backup(spark, f"file://{tmp_path}/b")
    assert "from_json" not in plan(back.links) and "from_json" not in plan(back.base)
    assert back.base.count() == 3 and back.links.count() == 3


def test_index_lists_blocks(spark):
    g = PropertyGraph.of(spark, {f"Order-{k:06d}": {"kind": "order"} for k in range(2000)})
    index = g.text_index
    assert index.postings.count() < 3 * 2000  # each node has more than ten
    e = plans.ast.parse({"where": {"kind": "name", "node": {"kind": "var", "name": "n"}, "operator": "contains", "value": "R-000129"}}).where
    assert sorted(r["gid"] for r in index.candidates([e]).collect()) == ["Order-000129"]
    assert index.postings.where(F.length("gram") != 3).isEmpty()


@pytest.fixture()
def indexed_nodes(spark, monkeypatch):
    """Five nodes, more than are broadcast, and their relations: their files are small, as those of millions of sorted keys are."""
    monkeypatch.setattr(session, "SMALL", 3)
    n = spark.createDataFrame([(f"n{k}", ["t"], [float(k)]) for k in range(5)], mp.NODES)
    return n, spark.createDataFrame([(f"r{k}", "t", f"n{k}", f"n{(k + 3) % 5}", 1.0) for k in range(5)], mp.RELATIONS)


def test_positions_of_many_nodes_are_not_broadcast(indexed_nodes):
    n, r = indexed_nodes
    for df, joins in ((mp.csr_entries(n, r), 2), (mp.csr_offsets(n, r), 1), (mp.chunks(n, r, 2), 2)):
        assert plan(df).count("strategy=merge") >= joins
    assert sorted((x["col"], x["row"]) for x in mp.csr_entries(n, r).collect()) == [(k, (k + 3) % 5) for k in range(5)]


def test_cores_of_chunks_are_not_broadcast(indexed_nodes):
    n, r = indexed_nodes
    assert "strategy=merge" in plan(mp.chunk_relations(n, r, 2))
    layer = mp.Layer(1, 1, {"t": [[1.0]]})
    y = mp.apply_chunked(n, r, layer, 2)
    assert plan(y).count("strategy=merge") >= 2
    assert sorted(tuple(x) for x in y.collect()) == sorted(tuple(x) for x in mp.apply_layer(n, r, layer).collect())


def test_many_nodes_of_a_view_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(session, "SMALL", 2)
    g = PropertyGraph.of(spark, {n: {} for n in ("T", "T/x", "n", "m", "o")}, [("n", "m"), ("m", "o"), ("T/x", "m")])
    basis = spark.createDataFrame([("T", "Node", "T", None, True, True, [])], view.BASIS)
    edges = view.project(g.nodes, g.edges, basis, unique=True)[1]
    assert plan(edges).count("strategy=merge") >= 4  # each end of edges and of relations
    assert sorted(r["key"] for r in edges.collect()) == ["m|n", "m|o"]


def test_a_backups_many_nodes_are_not_broadcast(spark, monkeypatch, tmp_path):
    asked = []
    monkeypatch.setattr(records, "by_size", lambda df: (asked.append(df.count()), df.hint("merge"))[1], raising=False)
    records.save_backup(star(spark, ["A1", "B1", "C1"]), f"file://{tmp_path}/b")
    assert records.load_backup(spark, f"file://{tmp_path}/b").base.count() == 3
    assert asked == [3]
