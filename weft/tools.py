"""The operations of a tool server as calls: a profile's names, and ``call`` with plain arguments.

``Semantic`` works with types: what it creates is checked against a type's fields and gets its
facets. ``Raw`` works with the graph alone. Answers are plain data; errors are ``{"error": ...}``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import mutate, semantic
from weft.plans import ast, contracts
from weft.plans import compile as plans
from weft.service import Service
from weft.sources.graph import NODES


class Tools:
    """Calls on a service's current graph, types and facets."""

    def __init__(self, service: Service, profile: str | None = None):
        self.service, self.profile = service, contracts.profile(None, profile)

    def names(self) -> list[str]:
        return sorted(_TOOLS[self.profile])

    def call(self, name: str, **args):
        """The answer of a tool of the profile; a tool of another profile is unknown."""
        tool = _TOOLS[self.profile].get(name)
        if tool is None:
            return {"error": f"unknown tool {name}"}
        try:
            return tool(self, **args)
        except (LookupError, TypeError, ast.QueryError, contracts.ContractTextError, mutate.GraphError, semantic.SemanticError) as e:
            return {"error": str(e)}

    # Both profiles.

    def _answer(self, answer):
        status, body = answer
        return body if status < 300 else {"error": (body or {}).get("error", status)}

    def _handled(self, method: str, path: str, body: dict | None = None, **query):
        answer = self._answer(self.service.handle(method, path, body, **query))
        return {"ok": True} if answer is None else answer

    @staticmethod
    def _gid(path: list[str]) -> str:
        return "/".join(path)

    # Raw.

    def get_node(self, path: list[str]):
        return self._handled("GET", "graph/nodes", globalId=self._gid(path))

    def create_node(self, localId: str, path: list[str] | None = None):
        return self._handled("POST", "graph/nodes", {"localId": localId, "parent": self._gid(path or [])})

    def delete_node(self, path: list[str]):
        return self._handled("DELETE", "graph/nodes", globalId=self._gid(path))

    def connect_nodes(self, sourceGlobalId: list[str], targetGlobalId: list[str]):
        return self._handled("POST", "graph/connections", {"source": self._gid(sourceGlobalId), "target": self._gid(targetGlobalId)})

    def disconnect_nodes(self, sourceGlobalId: list[str], targetGlobalId: list[str]):
        return self._handled("DELETE", "graph/connections", {"source": self._gid(sourceGlobalId), "target": self._gid(targetGlobalId)})

    def get_subgraph(self, rootPaths: list[list[str]], maxDepth: int = 1):
        return self._handled("POST", "graph/subgraph", {"roots": [self._gid(p) for p in rootPaths], "maxDepth": maxDepth})

    def search_nodes(self, query: dict):
        q = ast.parse(query)
        return [r.asDict(True) for r in plans.matches(plans.search(self.service.graph, q), q).collect()]  # at most the query's limit

    # Semantic.

    def get_typed_node(self, path: list[str], basisTypes: list[str] | None = None):
        s, gid = self.service, self._gid(path)
        node = self._handled("GET", "graph/nodes", globalId=gid)
        if "error" in node:
            return node
        found = semantic.project(s.graph, s.types, s.facets, basisTypes, [node["gid"]]).orderBy("type_gid").collect()
        return {"localId": node["gid"].rsplit("/", 1)[-1], "internalId": node["gid"], "types": [{"type": r["type_gid"], "witness": r["witness_gid"]} for r in found]}

    def create_typed_node(self, localId: str, type: str, path: list[str] | None = None, fields: dict | None = None):
        """A node of a type: fields are checked before anything is written, and nodes they name must exist."""
        s = self.service
        if s.types.where(F.col("type_gid") == type).isEmpty():
            raise LookupError(f"NotFound: {type}")
        reached = [r["reached"] for r in semantic.closure(s.types).where(F.col("type_gid") == type).collect()]
        known = [tuple(f) for r in s.types.where(F.col("type_gid").isin(reached)).select("fields").collect() for f in r["fields"]]
        attributes, links = contracts.creation_plan(known, fields or {})
        gid = self._gid([*(path or []), localId])
        ends = sorted({v for vs in links.values() for v in vs})
        there = {r["gid"] for r in s.graph.base.where(F.col("gid").isin(ends)).select("gid").collect()} if ends else set()
        if set(ends) - there:
            raise LookupError(f"NotFound: {', '.join(sorted(set(ends) - there))}")
        graph = mutate.create_nodes(s.graph, s.spark.createDataFrame([(gid, attributes)], NODES))
        if ends:
            graph = mutate.connect(graph, s.spark.createDataFrame([(gid, e) for e in ends], "a_gid string, b_gid string"))
        facets = semantic.assign(graph, s.types, s.facets, s.spark.createDataFrame([(gid, type)], "node_gid string, type_gid string"))
        s.graph, s.facets = graph, facets
        return self.get_typed_node(gid.split("/"))

    def create_type(self, localId: str, isAbstract: bool = False, fields=None, slots=None, requires: list[str] | None = None):
        s = self.service
        listed = lambda x: [{"name": k, **v} for k, v in x.items()] if isinstance(x, dict) else list(x or [])
        slot = lambda d: {**d, "allowedTypes": d.get("allowedTypes") or ([d["allowedType"]] if d.get("allowedType") else [])}
        b = contracts.parse_type({
            "name": localId, "abstract": isAbstract, "fields": listed(fields), "slots": [slot(d) for d in listed(slots)],
            "requires": requires or []
        })
        named = {x for x in [*b.required, *(f[6] for f in b.fields), *(x for c in b.slots for x in c[1])] if x}
        missing = named - {b.type_gid} - {r["type_gid"] for r in s.types.where(F.col("type_gid").isin(sorted(named))).select("type_gid").collect()}
        if missing:
            raise LookupError(f"NotFound: {', '.join(sorted(missing))}")
        s.types = semantic.create_types(s.types, s.spark.createDataFrame([b.row()], semantic.TYPES))
        return {"type": b.type_gid}

    def get_type_definitions(self):
        return [r.asDict(True) for r in semantic.catalog(self.service.types).collect()]  # the types, which are few


# The tools of each profile.
_TOOLS = {
    "Raw": {
        "GetNode": Tools.get_node, "CreateNode": Tools.create_node, "DeleteNode": Tools.delete_node, "ConnectNodes": Tools.connect_nodes,
        "DisconnectNodes": Tools.disconnect_nodes, "GetSubgraph": Tools.get_subgraph, "SearchNodes": Tools.search_nodes,
    },
    "Semantic": {
        "GetNode": Tools.get_typed_node, "CreateNode": Tools.create_typed_node, "CreateType": Tools.create_type,
        "GetTypeDefinitions": Tools.get_type_definitions
    },
}
