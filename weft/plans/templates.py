"""Ready-made query documents."""

from __future__ import annotations


# The documents of the ready-made queries, in the vocabulary of the query language.


def _var(name: str) -> dict:
    return {"kind": "var", "name": name}


def _lit(name: str) -> dict:
    return {"kind": "literal", "name": name}


def every(limit: int = 50) -> dict:
    return {"return": ["n"], "where": {"kind": "node", "node": _var("n")}, "limit": limit}


def text(value: str) -> dict:
    return {"return": ["n"], "where": {"kind": "text", "node": _var("n"), "value": value}}


def connected(to: str) -> dict:
    return {"return": ["n"], "where": {"kind": "connected", "left": _var("n"), "right": _lit(to)}}


def neighbour_by_id(key: str, value: str) -> dict:
    return {
        "return": ["n", "x"],
        "where": {
            "kind": "all",
            "expressions": [
                {"kind": "connected", "left": _var("n"), "right": _var("x")},
                {"kind": "attribute", "node": _var("x"), "key": key, "operator": "equals", "value": value}
            ]
        }
    }


def neighbour_connected(limit: int = 50) -> dict:
    return {
        "return": ["n", "x", "z"],
        "where": {
            "kind": "all",
            "expressions": [{"kind": "connected", "left": _var("n"), "right": _var("x")}, {"kind": "connected", "left": _var("x"), "right": _var("z")}]
        },
        "limit": limit,
    }


def isolated(limit: int = 50) -> dict:
    lonely = {"kind": "exists", "variables": ["y"], "expression": {"kind": "connected", "left": _var("x"), "right": _var("y")}}
    return {"return": ["x"], "where": {"kind": "all", "expressions": [{"kind": "node", "node": _var("x")}, {"kind": "not", "expression": lonely}]}, "limit": limit}
