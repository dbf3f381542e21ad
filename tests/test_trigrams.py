"""The trigram index gives what the scan gives, and looks at less."""

import random

import pytest

from tests.test_search import All, Attr, Conn, V
from weft.plans import ast
from weft.plans import compile as plans
from weft.sources import trigrams
from weft.sources.graph import PropertyGraph

NODES = {
    "Café noir": {"Note": "Crème brûlée"}, "cafe": {"note": "plain"}, "Straße": {"k": "Hauptstrasse"}, "strasse": {}, "日本語 text": {"note": "cafeteria"}, "ab": {"k": "x"},
    "box/Ærø": {"note": "island cafe\tnoir"}, "box": {"NOTE": ""}, "a b c": {"k": "a b"}, "deep steel": {"k": "frame"}, "frame": {"steel": "deep"}, "école": {"k": "cole"}, "empty": {}
}


def name(value, op="contains"):
    return {"kind": "name", "node": V("x"), "operator": op, "value": value}


def text(value):
    return {"kind": "text", "node": V("x"), "value": value}


@pytest.mark.parametrize("where", [
    name("CAFE"), name("café"), name("strasse"), name("straße"), name("ab"), name("ærø"), name("日本語"), name("nowhere"), name("a", "startsWith"), name("ecole"),
    Attr(V("x"), "note", "cafe", "contains"), Attr(V("x"), "NOTE", "brulee", "contains"), Attr(V("x"), "k", "ab", "contains"), text("cafe noir"), text("steel frame"), text("deep"),
    text("a b"), text("steel ab"), text("  Frame "), text("creme"), All(text("steel"), Attr(V("x"), "k", "FRA", "contains")), All(name("cafe"), Conn(V("x"), V("y")), name("noir"))
])
def test_index_equals_scan(spark, where, indexed):
    q = ast.parse({"return": ["x"], "where": where})
    plain = PropertyGraph.of(spark, NODES, [("cafe", "Café noir"), ("ab", "frame")])
    rows = lambda g: sorted(map(str, plans.solutions(g, q).collect()))
    assert rows(indexed) == rows(plain)


@pytest.fixture(scope="module")
def indexed(spark):
    g = PropertyGraph.of(spark, NODES, [("cafe", "Café noir"), ("ab", "frame")])
    assert g.text_index
    return g


def test_few_nodes_are_read(spark):
    r = random.Random(0)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    g = PropertyGraph.of(spark, {f"{word()} {k}": {"v": word()} for k in range(400)} | {"zürich": {}, "münchen": {"v": "Zurich west"}})
    e = ast.parse({"where": {"kind": "text", "node": {"kind": "var", "name": "n"}, "value": "zurich"}}).where
    assert g.text_index.odd.count() == 0
    assert sorted(x["gid"] for x in g.text_index.candidates([e]).collect()) == ["münchen", "zürich"]
    assert {x["n"] for x in plans.search(g, {"where": {"kind": "text", "node": {"kind": "var", "name": "n"}, "value": "ZURICH"}}).collect()} == {"münchen", "zürich"}


def test_what_a_condition_needs():
    needs = lambda kind, **args: trigrams.needed(ast.Expr(kind, {}, args))
    assert needs("text", value="ab cde") == {"cde"} and needs("text", value="a b") == {"a b"} and needs("text", value="ab cd") == set()
    assert needs("text", value="straße weg") == set() and needs("name", operator="contains", value="Éco") == {"eco"}
    assert needs("name", operator="startsWith", value="long") == set() and needs("attribute", operator="CONTAINS", value="wxyz") == {"wxy", "xyz"}
