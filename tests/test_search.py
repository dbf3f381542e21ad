import random

import pytest

from tests.naive import Naive
from weft.plans import ast
from weft.plans.compile import matches, search, solutions
from weft.sources.graph import PropertyGraph

V = lambda n: {"kind": "var", "name": n}
L = lambda n: {"kind": "literal", "name": n}


def All(*e):
    return {"kind": "all", "expressions": list(e)}


def Any(*e):
    return {"kind": "any", "expressions": list(e)}


def Not(e):
    return {"kind": "not", "expression": e}


def Exists(e):
    return {"kind": "exists", "variables": [], "expression": e}


def Conn(a, b):
    return {"kind": "connected", "left": a, "right": b}


def Attr(n, key, value, op="equals"):
    return {"kind": "attribute", "node": n, "key": key, "value": value, "operator": op}


def Path(a, b, lo, hi, me=False):
    return {"kind": "path", "left": a, "right": b, "minDepth": lo, "maxDepth": hi, "includeSelf": me}


def check(spark, nodes, links, where, returns=("x",)):
    nodes = nodes if isinstance(nodes, dict) else {n: {} for n in nodes}
    q = ast.parse({"return": list(returns), "where": where})
    got = {tuple(r[v] for v in returns): (r["score"], r["matched_by"]) for r in solutions(PropertyGraph.of(spark, nodes, links), q).collect()}
    want = Naive(nodes, links).solutions(q)
    assert got == want
    return {k[0] if len(k) == 1 else k for k in got}


def test_isolated(spark):
    nodes, links = ["isolated", "connected", "neighbor"], [("connected", "neighbor")]
    alone = Not(Exists(Conn(V("x"), V("y"))))
    assert check(spark, nodes, links, All({"kind": "node", "node": V("x")}, alone)) == {"isolated"}
    assert check(spark, nodes, links, alone) == {"isolated"}


def test_self_and_zero_path(spark):
    assert check(spark, ["self"], [("self", "self")], Conn(V("x"), V("x"))) == set()
    assert check(spark, ["first", "second"], [], Path(V("x"), V("x"), 0, 0, True)) == {"first", "second"}


def test_anchors(spark):
    nodes = {"a": {}, "b": {}, "c": {}, "target": {"role": "candidate"}, "partial": {"Role": "Candidate"}}
    links = [("target", "a"), ("target", "b"), ("target", "c"), ("partial", "a"), ("partial", "b")]
    role = Attr(V("x"), "role", "candidate")
    assert check(spark, nodes, links, All(role, *(Conn(V("x"), L(k)) for k in "abc"))) == {"target"}
    assert check(spark, nodes, links, All(role, Any(Conn(V("x"), L("c")), Conn(V("x"), L("b"))))) == {"target", "partial"}
    assert check(spark, nodes, links, Attr(V("x"), "role", "other", "notEquals")) == {"target", "partial"}


def test_paths_within_three(spark):
    nodes = {n: {} for n in ["a", "b", "m1", "m2", "m3", "n1", "n2", "n3", "n4", "p1"]} | {n: {"role": "candidate"} for n in ("target", "far", "partial")}
    links = [("target", "m1"), ("m1", "m2"), ("m2", "a"), ("target", "m3"), ("m3", "b"), ("far", "n1"), ("n1", "n2"), ("n2", "n3"), ("n3", "a"), ("far", "n4"), ("n4", "b"), ("partial", "p1"), ("p1", "a")]
    where = All(Attr(V("x"), "role", "candidate"), Path(V("x"), L("a"), 1, 3), Path(V("x"), L("b"), 1, 3))
    assert check(spark, nodes, links, where) == {"target"}


def test_hierarchy_and_text(spark):
    nodes = ["weapons", "weapons/pistols", "weapons/pistols/revolvers", "weapons/pistols/revolvers/smith-wesson", "vehicles"]
    assert check(spark, nodes, [], {"kind": "descendant", "ancestor": L("weapons"), "descendant": V("x"), "maxDepth": 2}) == {"weapons/pistols", "weapons/pistols/revolvers"}
    nodes = {"alpha": {"kind": "weapon", "description": "steel frame"}, "beta": {"kind": "weapon", "description": "polymer"}}
    assert check(spark, nodes, [], All(Attr(V("x"), "kind", "weapon"), {"kind": "text", "node": V("x"), "value": "steel"})) == {"alpha"}


def test_two_variables(spark):
    nodes, links = {"source": {}, "marker": {"id": "Y"}, "unrelated": {"id": "Y"}}, [("source", "marker")]
    assert check(spark, nodes, links, All(Conn(V("n"), V("x")), Attr(V("x"), "id", "Y")), ("n", "x")) == {("source", "marker")}


def test_accents_and_limit(spark):
    g = PropertyGraph.of(spark, {"Café noir": {}, "b": {}, "c": {}})
    q = {"return": ["x"], "where": {"kind": "name", "node": V("x"), "operator": "CONTAINS", "value": "CAFE"}}
    assert [r["x"] for r in search(g, q).collect()] == ["Café noir"]
    assert [r["x"] for r in search(g, {"return": ["x"], "limit": 2}).collect()] == ["Café noir", "b"]
    assert matches(search(g, q), q).first()["bindings"] == {"x": "Café noir"}


def test_bad_queries():
    for bad in ['{"return": []}', '{"where": {"kind": "what"}}', '{"where": {"kind": "any", "expressions": []}}', '{"where": {"kind": "all", "kind": "any"}}', "{"]:
        with pytest.raises(ast.QueryError):
            ast.parse(bad)
    for where in [Path(V("x"), V("y"), 3, 1), Attr(V("x"), "k", None), {"kind": "degree", "node": V("x"), "value": -1}, {"kind": "name", "node": V("x"), "operator": "exists", "value": "a"}]:
        with pytest.raises(ast.QueryError):
            ast.parse({"where": where})
    with pytest.raises(ast.QueryError):
        ast.forbid({"where": All(Not(Attr(V("x"), "k", "v")))})


def random_where(r, depth=2):
    sel = lambda: V(r.choice("xyz")) if r.random() < 0.8 else L(r.choice(["a", "a/b", "c", "nope"]))
    if depth and r.random() < 0.7:
        k = r.choice(["all", "all", "any", "not", "exists"])
        if k in ("all", "any"):
            return {"kind": k, "expressions": [random_where(r, depth - 1) for _ in range(r.choice([1, 2, 2]))]}
        return {"kind": k, "expression": random_where(r, depth - 1)}
    return r.choice([
        lambda: {"kind": "node", "node": sel()}, lambda: {"kind": "name", "node": sel(), "operator": r.choice(["contains", "startsWith", "notEquals"]), "value": r.choice("abc")},
        lambda: Attr(sel(), "k", "1", r.choice(["equals", "notEquals", "exists"])), lambda: {"kind": "text", "node": sel(), "value": r.choice(["a", "k 1"])},
        lambda: Conn(sel(), sel()), lambda: Path(sel(), sel(), r.choice([0, 1]), 2, r.random() < 0.5), lambda: {"kind": "descendant", "ancestor": sel(), "descendant": sel()},
        lambda: {"kind": "degree", "node": sel(), "operator": "greaterThan", "value": 1}, lambda: {"kind": "same", "left": sel(), "right": sel()}, lambda: {"kind": "notSame", "left": sel(), "right": sel()},
    ])()


@pytest.mark.parametrize("seed", range(16))
def test_random_queries_match_the_interpreter(spark, seed):
    r = random.Random(seed)
    nodes = {"a": {"K": "1"}, "a/b": {}, "a/b/d": {"k": "2"}, "c": {"k": "1"}, "e": {}}
    links = [x for x in [("c", "a/b"), ("c", "e"), ("e", "a")] if r.random() < 0.7]
    check(spark, nodes, links, random_where(r), r.choice([("x",), ("x", "y")]))
