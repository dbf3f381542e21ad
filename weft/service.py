"""The request surface without a server: each request is answered with (status, body).

``Service`` holds the current version of a graph and of a typed store; requests that change
something set the next version. Bodies are plain data; a search answers with an iterator of lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators import mutate, semantic, traverse, typed, view
from weft.plans import ast
from weft.plans import compile as plans
from weft.sources import sinks
from weft.sources.graph import NODES, PropertyGraph

_RELATED = "id string, type_ids array<string>, attributes map<string,string>, members map<string,array<string>>"


#: Changes after which the graph is written anew.
SETTLE = 16


class Service:
    def __init__(
        self, graph: PropertyGraph, store: typed.TypedGraph | None = None, edges: semantic.Edges | None = None, profile: str = "Raw",
        types: DataFrame | None = None, facets: DataFrame | None = None,
    ):
        self.graph, self.store, self.edges, self.profile = graph, store, edges, profile
        self.spark = spark = graph.spark
        self._seen, self._steps = graph, 0
        self.types = spark.createDataFrame([], semantic.TYPES) if types is None else types
        self.facets = spark.createDataFrame([], semantic.FACETS) if facets is None else facets

    def handle(self, method: str, path: str, body: dict | None = None, **query):
        """Answer one request; errors become their status codes."""
        action = _ROUTES.get((method.upper(), path.strip("/").removeprefix("api/")))
        if action is None:
            return 404, {"error": f"{method} {path}"}
        try:
            answer = action(self, body or {}, query)
            if method.upper() != "GET":
                self._settle()
            return answer
        except typed.ContractError as e:
            return e.status, {"error": e.code, "message": str(e)}
        except LookupError as e:
            return 404, {"error": str(e)}
        except (ast.QueryError, mutate.GraphError, semantic.SemanticError, KeyError, TypeError) as e:
            return 400, {"error": str(e)}

    def _settle(self) -> None:
        """Write the graph once it has been changed often, so that its plan stays short."""
        self._steps += self.graph is not self._seen
        if self._steps >= SETTLE:
            self.graph, self._steps = mutate.settled(self.graph), 0
        self._seen = self.graph

    def _one(self, gids: DataFrame):
        rows = view.responses(self.graph, gids).limit(1).collect()
        return (200, rows[0].asDict(True)) if rows else (404, {"error": "NotFound"})

    def get_node(self, _, q):
        return self._one(self.graph.resolve(q["globalId"]))

    def get_neighbour(self, _, q):
        return self._one(self.graph.neighbour(q["globalId"], q["localId"]))

    def create_node(self, b, _):
        gid = f"{b['parent']}/{b['localId']}" if b.get("parent") else b["localId"]
        self.graph = mutate.create_nodes(self.graph, self.spark.createDataFrame([(gid, b.get("attributes") or {})], NODES))
        status, body = self._one(self.graph.get(gid).select("gid"))
        return (201 if status == 200 else status), body

    def update_node(self, b, q):
        self.graph = mutate.update_attributes(self.graph, self.spark.createDataFrame([(q["globalId"], b.get("attributes") or {})], NODES))
        return 204, None

    def delete_node(self, _, q):
        if self.graph.get(q["globalId"]).isEmpty():
            return 404, {"error": "NotFound"}
        if self.edges is None:
            self.graph = mutate.delete_subtrees(self.graph, [q["globalId"]])
        else:
            self.graph, self.edges = semantic.delete_nodes(self.graph, self.edges, [q["globalId"]])
        return 204, None

    def connect(self, b, _):
        self.graph = mutate.connect(self.graph, self.spark.createDataFrame([(b["source"], b["target"])], "a_gid string, b_gid string"))
        return 204, None

    def disconnect(self, b, _):
        self.graph = mutate.disconnect(self.graph, b["source"], b["target"])
        return 204, None

    def assign_type(self, b, _):
        rows = self.spark.createDataFrame([(b["internalId"], b["typeGlobalId"])], "node_gid string, type_gid string")
        if self.graph.get(b["internalId"]).isEmpty():
            return 404, {"error": "NotFound"}
        self.facets = semantic.assign(self.graph, self.types, self.facets, rows)
        return self._with_types([b["internalId"]])

    def change_edge_type(self, b, _):
        """The edge of two nodes becomes a relation; the type's roles take them in the order of its fields."""
        ends, type_gid = [b["node1InternalId"], b["node2InternalId"]], b["typeGlobalId"]
        roles = self.types.where(F.col("type_gid") == type_gid).select(F.filter("fields", lambda f: f["value_kind"] == "Node").alias("f")).collect()
        if not roles or any(self.graph.get(g).isEmpty() for g in ends):
            return 404, {"error": "NotFound"}
        if len(roles[0]["f"]) != 2:
            return 400, {"error": f"{type_gid} does not join two nodes"}
        if self.edges is None:
            self.edges = semantic.Edges(self.spark.createDataFrame([], semantic.RELATIONS), self.spark.createDataFrame([], semantic.MEMBERS))
        name = "-".join([type_gid.rsplit("/", 1)[-1].lower(), *(g.rsplit("/", 1)[-1] for g in ends)])
        given = {f["name"]: [g] for f, g in zip(roles[0]["f"], ends)}
        self.graph, self.edges = semantic.change_edge_type(self.graph, self.types, self.facets, self.edges, type_gid, given, name)
        status, body = self._with_types(ends)
        return status, {**body, "relation": name}

    def _with_types(self, gids: list[str]):
        """A few nodes, the edges among them, and their facets."""
        some = self.graph.nodes.where(F.col("gid").isin(gids)).select("gid")
        plain = lambda df: [r.asDict(True) for r in df.collect()]  # noqa: E731  as many rows as nodes were named, or pairs of them
        types = self.facets.where(F.col("node_gid").isin(gids)).orderBy("node_gid", "type_gid")
        return 200, {
            "nodes": plain(self.graph.nodes.where(F.col("gid").isin(gids)).orderBy("gid")),
            "edges": plain(traverse.induced_edges(self.graph, some)), "types": plain(types)
        }

    def subgraph(self, b, _):
        near = traverse.subgraph(self.graph, b.get("roots") or [], int(b.get("maxDepth", 1)))
        nodes = view.responses(self.graph, near.select("gid"))
        edges = traverse.induced_edges(self.graph, near)
        return 200, {"nodes": sinks.stream_lines(nodes), "edges": sinks.stream_lines(edges)}

    def settings(self, _, __):
        """Names a view needs: the root of the types, and that of the stored nodes."""
        return 200, {"systemNodeIds": {"nodeTypeRoot": semantic.CATALOG, "storageRoot": ""}, "basis": {"nodeTypeRoot": semantic.CATALOG}}

    def search(self, b, _):
        if self.profile == "Semantic":
            ast.forbid(b)
        q = ast.parse(b)
        return 200, sinks.stream_lines(plans.matches(plans.search(self.graph, q), q))

    def _rows(self, df: DataFrame, many: bool = True):
        rows = [r.asDict(True) for r in df.collect()]
        return (200, rows) if many else (200, rows[0]) if rows else (404, {"error": typed.NOT_FOUND})

    def types(self, _, __):
        return self._rows(self.store.get_types())

    def type(self, _, q):
        return self._rows(self.store.types.where(F.col("type_id") == q["id"]), False)

    def create_type(self, b, _):
        members = [(m["name"], m.get("type_id"), m.get("min", 0), m.get("max")) for m in b.get("members", [])]
        attributes = [(a["name"], a["kind"], bool(a.get("required"))) for a in b.get("attributes", [])]
        row = (b["type_id"], b["kind"], bool(b.get("is_abstract")), b.get("required_type_ids", []), members, attributes)
        self.store = self.store.create_types(self.spark.createDataFrame([row], typed.TYPES))
        return 201, self.type(None, {"id": b["type_id"]})[1]

    def element(self, _, q):
        return self._rows(self.store.get(q["id"]), False)

    def incident(self, _, q):
        """Relations as lines: a node may take part in any number of them."""
        return 200, sinks.stream_lines(self.store.incident([q["participantId"]]))

    def create_instance(self, b, _):
        row = (b["id"], b["type_ids"], b.get("attributes") or {})
        self.store = self.store.create_instances(self.spark.createDataFrame([row], "id string, type_ids array<string>, attributes map<string,string>"))
        return 201, self.element(None, b)[1]

    def create_relation(self, b, _):
        row = (b["id"], b["type_ids"], b.get("attributes") or {}, b["members"])
        self.store = self.store.create_relations(self.spark.createDataFrame([row], _RELATED))
        return 201, self.element(None, b)[1]

    def replace_attributes(self, b, q):
        self.store = self.store.replace_attributes(self.spark.createDataFrame([(q["id"], b.get("attributes") or {})], "id string, attributes map<string,string>"))
        return self.element(None, q)

    def delete_element(self, _, q):
        self.store = self.store.delete([q["id"]])
        return 204, None


# The routes.
_ROUTES = {
    ("GET", "graph/nodes"): Service.get_node, ("GET", "graph/nodes/neighbor"): Service.get_neighbour, ("POST", "graph/nodes"): Service.create_node, ("PUT", "graph/nodes"): Service.update_node,
    ("DELETE", "graph/nodes"): Service.delete_node, ("POST", "graph/connections"): Service.connect, ("DELETE", "graph/connections"): Service.disconnect, ("POST", "graph/subgraph"): Service.subgraph,
    ("PUT", "graph/nodes/type"): Service.assign_type, ("PUT", "graph/edges/type"): Service.change_edge_type,
    ("POST", "graph/search/nodes"): Service.search, ("GET", "ui/settings"): Service.settings, ("GET", "typed-graph/types"): Service.types, (
        "GET", "typed-graph/types/item"
    ): Service.type, ("POST", "typed-graph/types"): Service.create_type,
    ("GET", "typed-graph/elements"): Service.element, (
        "GET", "typed-graph/relations/incident"
    ): Service.incident, ("POST", "typed-graph/instances"): Service.create_instance,
    ("POST", "typed-graph/relations"): Service.create_relation, (
        "PUT", "typed-graph/elements/attributes"
    ): Service.replace_attributes, ("DELETE", "typed-graph/elements"): Service.delete_element,
}
