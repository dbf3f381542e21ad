"""Type definitions: the builder, the JSON contracts of tools, dataclasses, creation plans."""

from __future__ import annotations

import dataclasses
import re
import types as pytypes
import typing
from dataclasses import dataclass, field

from weft.functions.scalars import spark_type

# Cardinality words.
WORDS = {"required": (1, 1), "optional": (0, 1), "many": (0, None), "oneormore": (1, None)}


class ContractTextError(ValueError):
    """A definition that cannot be read."""


def cardinality(text) -> tuple[int, int | None]:
    """``required | optional | many | oneOrMore | a..b | a..* | {min, max}``."""
    if isinstance(text, dict):
        lo, hi = text.get("min", 0), text.get("max")
    elif isinstance(text, str) and text.strip().lower() in WORDS:
        return WORDS[text.strip().lower()]
    else:
        m = re.fullmatch(r"\s*(\d+)\s*\.\.\s*(\d+|\*)\s*", str(text))
        if not m:
            raise ContractTextError(f"Unknown cardinality '{text}'.")
        lo, hi = int(m[1]), None if m[2] == "*" else int(m[2])
    if not isinstance(lo, int) or lo < 0 or hi is not None and hi < lo:
        raise ContractTextError(f"The cardinality '{text}' is empty.")
    return lo, hi


def contains(card: tuple[int, int | None], n: int) -> bool:
    return n >= card[0] and (card[1] is None or n <= card[1])


@dataclass
class TypeBuilder:
    """Fluent construction of a row of the semantic layer's types table."""

    type_gid: str
    element_kind: str = "Node"
    is_abstract: bool = False
    required: list = field(default_factory=list)
    fields: list = field(default_factory=list)
    slots: list = field(default_factory=list)

    def abstract(self) -> "TypeBuilder":
        self.is_abstract = True
        return self

    def requires(self, *types: str) -> "TypeBuilder":
        self.required += [t for t in types if t not in self.required]
        return self

    def slot(self, name: str, *allowed: str, card="required") -> "TypeBuilder":
        self.slots.append((name, list(allowed), *cardinality(card)))
        return self

    def field(self, name: str, data_type: str = "string", card="required", node_type: str | None = None, node: bool = False) -> "TypeBuilder":
        lo, hi = cardinality(card)
        is_node = node or node_type is not None
        self.fields.append((name, "Node" if is_node else "Primitive", None if is_node else data_type, lo, hi, hi is None or hi > 1, node_type))
        return self

    def row(self) -> tuple:
        return (self.type_gid, self.element_kind, self.is_abstract, self.required, self.fields, self.slots)


def parse_type(d: dict) -> TypeBuilder:
    """A type from its JSON contract: name, elementKind, abstract, requires, fields, slots."""
    name = str(d.get("name") or "").strip()
    if not name:
        raise ContractTextError("A type needs a name.")
    b = TypeBuilder(name if "/" in name else f"NodeTypes/{name}", d.get("elementKind", "Node"), bool(d.get("abstract", False)))
    b.requires(*d.get("requires", []))
    seen = set()
    for f in d.get("fields", []):
        key = str(f.get("name") or "").strip()
        if not key or key.lower() in seen:
            raise ContractTextError(f"Field '{key}' is blank or repeats.")
        seen.add(key.lower())
        node, primitive = f.get("nodeType"), f.get("clrType") or f.get("dataType")
        if node and primitive:
            raise ContractTextError(f"Field '{key}' is both node and primitive.")
        is_node = bool(node) or str(f.get("kind", "")).lower() == "node"
        if not is_node:
            spark_type(primitive or "string")
        b.field(key, primitive or "string", f.get("cardinality", "required"), node, is_node)
    for s in d.get("slots", []):
        b.slot(s["name"], *s.get("allowedTypes", []), card=s.get("cardinality", "required"))
    return b


def from_dataclass(cls: type, prefix: str = "NodeTypes") -> TypeBuilder:
    """A type from a dataclass: Optional is optional, list is many, another dataclass is a node."""
    b = TypeBuilder(f"{prefix}/{cls.__name__}")
    hints = typing.get_type_hints(cls)
    for f in dataclasses.fields(cls):
        t, card = hints[f.name], "required"
        if typing.get_origin(t) in (typing.Union, pytypes.UnionType):
            t = next(x for x in typing.get_args(t) if x is not type(None))
            card = "optional"
        if typing.get_origin(t) in (list, set, tuple):
            t, card = typing.get_args(t)[0], "many"
        if dataclasses.is_dataclass(t):
            b.field(f.name, card=card, node_type=f"{prefix}/{t.__name__}")
        elif t is object:
            b.field(f.name, card=card, node=True)
        else:
            b.field(f.name, {str: "string", int: "long", float: "double", bool: "bool"}.get(t, getattr(t, "__name__", "string").lower()), card)
    return b


def from_schema(name: str, schema, prefix: str = "NodeTypes") -> TypeBuilder:
    """A type from a Spark schema: nullable is optional, an array is many, a struct is a node of its own type."""
    from pyspark.sql import types as T

    b = TypeBuilder(f"{prefix}/{name}")
    alias = {"string": "string", "int": "int", "bigint": "long", "smallint": "short", "tinyint": "byte", "float": "float", "double": "double", "boolean": "bool", "timestamp": "datetime"}
    for f in schema.fields:
        kind, card = f.dataType, "optional" if f.nullable else "required"
        if isinstance(kind, T.ArrayType):
            kind, card = kind.elementType, "many"
        if isinstance(kind, T.StructType):
            b.field(f.name, card=card, node_type=f"{prefix}/{f.name}")
        else:
            b.field(f.name, "decimal" if isinstance(kind, T.DecimalType) else alias.get(kind.simpleString(), kind.simpleString()), card)
    return b


_REGISTERED: dict[str, TypeBuilder] = {}


def register_type(source, prefix: str = "NodeTypes") -> TypeBuilder:
    """Make a type known to every catalog that is bootstrapped later: a builder, a dataclass or a JSON contract."""
    b = source if isinstance(source, TypeBuilder) else parse_type(source) if isinstance(source, dict) else from_dataclass(source, prefix)
    if b.type_gid.lower() in {k.lower() for k in _REGISTERED if k != b.type_gid}:
        raise ContractTextError(f"Type '{b.type_gid}' is registered in another case.")
    _REGISTERED[b.type_gid] = b
    return b


def registered() -> list[tuple]:
    """Rows of the registered types, by name."""
    return [_REGISTERED[k].row() for k in sorted(_REGISTERED)]


def creation_plan(effective_fields: list[tuple], given: dict) -> tuple[dict, dict]:
    """(attributes, links) of a node of a type; missing, unknown and surplus fields are errors.

    Values become invariant strings; collections of primitives become JSON text.
    """
    import json

    by_name: dict[str, list] = {}
    for f in effective_fields:
        by_name.setdefault(f[0].lower(), []).append(f)
    unclear = sorted(k for k, fs in by_name.items() if len({f[1:] for f in map(tuple, fs)}) > 1)
    if unclear:
        raise ContractTextError(f"Ambiguous fields: {unclear}")
    low = {k.lower(): v for k, v in given.items()}
    if len(low) < len(given):
        raise ContractTextError("A field is given twice.")
    unknown = sorted(set(low) - set(by_name))
    if unknown:
        raise ContractTextError(f"Unknown fields: {unknown}")
    attributes, links = {}, {}
    for key, fs in by_name.items():
        name, kind, _, lo, hi, many, _ = fs[0]
        value = low.get(key)
        values = [] if value is None else value if isinstance(value, list) else [value]
        if not contains((lo, hi), len(values)):
            raise ContractTextError(f"Field '{name}' needs {lo}..{'*' if hi is None else hi} values, got {len(values)}.")
        if not values:
            continue
        if kind == "Node":
            links[name] = values
        else:
            text = [str(v).lower() if isinstance(v, bool) else repr(v) if isinstance(v, float) else str(v) for v in values]
            attributes[name] = json.dumps(text) if many else text[0]
    return attributes, links


def profile(environment: str | None, configured: str | None) -> str:
    """Tool profile: environment before configuration before ``Semantic``."""
    for value in (environment, configured):
        for known in ("Semantic", "Raw"):
            if value and value.strip().lower() == known.lower():
                return known
    return "Semantic"
