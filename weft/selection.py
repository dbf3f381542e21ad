"""Commands on a selection of nodes and edges: what is offered, and what it does."""

from __future__ import annotations

from dataclasses import dataclass, field

from weft.service import Service


@dataclass(frozen=True)
class Selection:
    """Global ids of nodes, and pairs of them for edges."""

    nodes: list[str] = field(default_factory=list)
    edges: list[tuple[str, str]] = field(default_factory=list)


# When a command is offered.
_OFFERED = {
    "create-node": lambda s: not s.edges, "clear-selection": lambda s: bool(s.nodes or s.edges), "delete-selection": lambda s: bool(s.nodes or s.edges),
    "connect-nodes": lambda s: len(s.nodes) == 1 and not s.edges, "assign-node-type": lambda s: bool(s.nodes), "assign-edge-type": lambda s: bool(s.edges),
}


def offered(selection: Selection) -> list[str]:
    return [name for name, test in _OFFERED.items() if test(selection)]


def run(service: Service, name: str, selection: Selection, *, local_id: str = "", target: str = "", type_gid: str = "", confirmed: bool = False) -> tuple[int, Selection]:
    """(status, selection afterwards); a command that is not offered, or lacks its input, is 400.

    A new node is linked to every selected node and gets the type, if one is given; a deletion needs
    to be confirmed. The first request that fails ends the command with its status.
    """
    if name not in offered(selection):
        return 400, selection
    if name == "clear-selection":
        return 204, Selection()
    put = lambda path, body: service.handle("PUT", path, body)[0]
    requests = []
    if name == "create-node":
        if not local_id:
            return 400, selection
        requests.append(lambda: service.handle("POST", "graph/nodes", {"localId": local_id})[0])
        requests += [lambda n=n: service.handle("POST", "graph/connections", {"source": local_id, "target": n})[0] for n in selection.nodes]
        if type_gid:
            requests.append(lambda: put("graph/nodes/type", {"internalId": local_id, "typeGlobalId": type_gid}))
    elif name == "connect-nodes":
        if not target:
            return 400, selection
        ends = [selection.nodes[0], target]
        requests.append(lambda: service.handle("POST", "graph/connections", {"source": ends[0], "target": ends[1]})[0])
        if type_gid:
            requests.append(lambda: put("graph/edges/type", {"node1InternalId": ends[0], "node2InternalId": ends[1], "typeGlobalId": type_gid}))
    elif name == "delete-selection":
        if not confirmed:
            return 400, selection
        requests += [lambda a=a, b=b: service.handle("DELETE", "graph/connections", {"source": a, "target": b})[0] for a, b in selection.edges]
        requests += [lambda n=n: service.handle("DELETE", "graph/nodes", globalId=n)[0] for n in selection.nodes]
    elif not type_gid:
        return 400, selection
    elif name == "assign-node-type":
        requests += [lambda n=n: put("graph/nodes/type", {"internalId": n, "typeGlobalId": type_gid}) for n in selection.nodes]
    else:
        requests += [lambda a=a, b=b: put("graph/edges/type", {"node1InternalId": a, "node2InternalId": b, "typeGlobalId": type_gid}) for a, b in selection.edges]
    for request in requests:
        status = request()
        if status >= 300:
            return status, selection
    return 200, Selection() if name == "delete-selection" else selection
