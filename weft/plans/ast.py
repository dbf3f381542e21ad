"""The query document: parse, validate, gate.

    {"return": ["x"], "where": {"kind": "all", "expressions": [...]}, "limit": 50}
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from weft.functions.text import NUMBER_OPS, TEXT_OPS, operator

DEFAULT_LIMIT, MAX_LIMIT = 50, 500


class QueryError(ValueError):
    """A query document that cannot be run."""


@dataclass(frozen=True)
class Var:
    name: str

    @property
    def key(self) -> str:
        return self.name.lower()


@dataclass(frozen=True)
class Literal:
    name: str


@dataclass(frozen=True)
class Expr:
    """One predicate: its kind, its node selectors by role, its other arguments, its children."""

    kind: str
    nodes: dict = field(default_factory=dict)
    args: dict = field(default_factory=dict)
    children: tuple["Expr", ...] = ()


@dataclass(frozen=True)
class Query:
    returns: tuple[str, ...]
    where: Expr | None
    limit: int


# For each kind its node roles, and its arguments with their defaults.
KINDS: dict[str, tuple[tuple[str, ...], dict]] = {
    "all": ((), {}), "any": ((), {}), "not": ((), {}), "exists": ((), {}),
    "node": (("node",), {}),
    "name": (("node",), {"operator": "equals", "value": None}),
    "attribute": (("node",), {"key": None, "operator": "equals", "value": None}),
    "text": (("node",), {"value": None}),
    "connected": (("left", "right"), {}),
    "path": (("left", "right"), {"minDepth": 1, "maxDepth": 1, "includeSelf": False}),
    "descendant": (("ancestor", "descendant"), {"minDepth": 1, "maxDepth": 8}),
    "degree": (("node",), {"operator": "equals", "value": 0}),
    "same": (("left", "right"), {}),
    "notSame": (("left", "right"), {}),
}
LEAVES = tuple(k for k in KINDS if k not in ("all", "any", "not", "exists"))


def _unique(pairs):
    out = {}
    for k, v in pairs:
        if k in out:
            raise QueryError(f"Property '{k}' is given twice.")
        out[k] = v
    return out


def parse(document: str | dict) -> Query:
    """A validated query; duplicated properties, unknown kinds and bad arguments raise QueryError."""
    try:
        d = json.loads(document, object_pairs_hook=_unique) if isinstance(document, str) else document
    except json.JSONDecodeError as e:
        raise QueryError(f"The query is not JSON: {e}") from e
    returns = d.get("return", ["n"])
    if not isinstance(returns, list) or not returns:
        raise QueryError("'return' needs at least one variable.")
    names: dict[str, str] = {}
    for r in returns:
        if isinstance(r, str) and r.strip():
            names.setdefault(r.strip().lower(), r.strip())
    if not names:
        raise QueryError("'return' needs at least one variable.")
    where = d.get("where")
    limit = d.get("limit") or 0
    return Query(tuple(names.values()), _expr(where) if where is not None else None, DEFAULT_LIMIT if limit <= 0 else min(limit, MAX_LIMIT))


def _selector(d) -> Var | Literal:
    kind = (d or {}).get("kind") if isinstance(d, dict) else None
    if kind == "var":
        if not str(d.get("name") or "").strip():
            raise QueryError("A variable needs a name.")
        return Var(d["name"])
    if kind == "literal":
        return Literal(str(d.get("name") or ""))
    raise QueryError(f"Unknown node selector '{kind}'.")


def _expr(d: dict) -> Expr:
    kind = d.get("kind") if isinstance(d, dict) else None
    if kind not in KINDS:
        raise QueryError(f"Unknown expression kind '{kind}'.")
    roles, defaults = KINDS[kind]
    if kind in ("all", "any"):
        children = tuple(_expr(x) for x in d.get("expressions") or [])
        if kind == "any" and not children:
            raise QueryError("'any' needs at least one expression.")
        return Expr(kind, children=children)
    if kind in ("not", "exists"):
        if d.get("expression") is None:
            raise QueryError(f"'{kind}' needs an expression.")
        return Expr(kind, children=(_expr(d["expression"]),))
    nodes = {r: _selector(d.get(r)) for r in roles}
    args = {k: d.get(k, v) for k, v in defaults.items()}
    _check(kind, args)
    return Expr(kind, nodes, args)


def _check(kind: str, args: dict) -> None:
    try:
        if kind in ("name", "text") and not str(args.get("value") or "").strip():
            raise QueryError(f"'{kind}' needs a value.")
        if kind == "name":
            args["operator"] = args["operator"] if operator(args["operator"], TEXT_OPS) else ""
        if kind == "attribute":
            if not str(args["key"] or "").strip():
                raise QueryError("'attribute' needs a key.")
            if args["operator"].lower() != "exists":
                operator(args["operator"], TEXT_OPS)
                if args["value"] is None:
                    raise QueryError("'attribute' needs a value.")
        if kind == "degree":
            operator(args["operator"], NUMBER_OPS)
            if args["value"] < 0:
                raise QueryError("A degree is not negative.")
    except QueryError:
        raise
    except ValueError as e:
        raise QueryError(str(e)) from e
    if kind in ("path", "descendant") and not 0 <= args["minDepth"] <= args["maxDepth"]:
        raise QueryError("Depths need 0 <= minDepth <= maxDepth.")


def variables(e: Expr) -> set[str]:
    """All variables, through every kind."""
    return {s.key for s in e.nodes.values() if isinstance(s, Var)}.union(*(variables(c) for c in e.children)) if e.children or e.nodes else set()


def bindable(e: Expr | None) -> set[str]:
    """Variables that evaluation can bind: none behind ``not`` or ``exists``."""
    if e is None or e.kind in ("not", "exists"):
        return set()
    return variables(Expr(e.kind, e.nodes)) | set().union(*(bindable(c) for c in e.children))


def effective(q: Query) -> Expr:
    """``where`` between binders: unbindable return variables first, all of them last."""
    bind = lambda v: Expr("node", {"node": Var(v)})
    known = bindable(q.where)
    first = [bind(v) for v in q.returns if v.lower() not in known]
    return Expr("all", children=(*first, *([q.where] if q.where else []), *(bind(v) for v in q.returns)))


def forbid(document: str | dict, kind: str = "attribute") -> None:
    """The semantic profile's gate: no nested expression may be of this kind."""
    d = json.loads(document) if isinstance(document, str) else document

    def walk(x):
        if isinstance(x, dict):
            if str(x.get("kind", "")).lower() == kind:
                raise QueryError(f"'{kind}' predicates are not available in this profile.")
            for v in x.values():
                walk(v)
        elif isinstance(x, list):
            for v in x:
                walk(v)

    walk(d)
