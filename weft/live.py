"""A node's neighbours and edges as collections over a service's current graph."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import functions as F

from weft.operators import mutate
from weft.service import Service
from weft.sources.graph import NODES


class Neighbours:
    """The nodes beside one node; changes set the service's next graph."""

    def __init__(self, service: Service, owner: str):
        self.service, self.owner = service, owner

    @property
    def graph(self):
        return self.service.graph

    def __iter__(self) -> Iterator[str]:
        for r in self.graph.neighbours_of(self.owner).orderBy("dst").toLocalIterator():
            yield r["dst"]

    def __contains__(self, gid: str) -> bool:
        return not self.graph.neighbours_of(self.owner).where(F.col("dst") == gid).isEmpty()

    def add(self, gid: str) -> None:
        """Link an existing node; one that is there, or shares a local id with one, is an error."""
        self.service.graph = mutate.add_neighbour(self.graph, self.owner, gid)

    def create(self, local_id: str, attributes: dict | None = None) -> str:
        """A new child; a neighbour of that local id is an error."""
        gid = f"{self.owner}/{local_id}"
        if not self.graph.neighbour(self.owner, local_id).isEmpty():
            raise mutate.GraphError(f"'{self.owner}' has a neighbour named '{local_id}'")
        self.service.graph = mutate.create_nodes(self.graph, self.service.spark.createDataFrame([(gid, attributes or {})], NODES))
        return gid

    def remove(self, gid: str) -> None:
        """Part the two, or delete the neighbour if it has no other."""
        self.service.graph = mutate.remove_neighbour(self.graph, self.owner, gid)

    def clear(self) -> None:
        self.service.graph = mutate.clear_neighbours(self.graph, self.owner)


class Links:
    """The stored links of one node, as pairs; hierarchy is not among them."""

    def __init__(self, service: Service, owner: str):
        self.service, self.owner = service, owner

    def _mine(self):
        return self.service.graph.links.where((F.col("a_gid") == self.owner) | (F.col("b_gid") == self.owner))

    def __iter__(self) -> Iterator[tuple[str, str]]:
        for r in self._mine().orderBy("a_gid", "b_gid").toLocalIterator():
            yield r["a_gid"], r["b_gid"]

    def __contains__(self, pair: tuple[str, str]) -> bool:
        low, high = sorted(pair)
        return not self._mine().where((F.least("a_gid", "b_gid") == low) & (F.greatest("a_gid", "b_gid") == high)).isEmpty()

    def add(self, other: str) -> None:
        rows = self.service.spark.createDataFrame([(self.owner, other)], "a_gid string, b_gid string")
        self.service.graph = mutate.connect(self.service.graph, rows)

    def remove(self, other: str) -> None:
        if (self.owner, other) not in self:
            raise mutate.GraphError(f"'{self.owner}' and '{other}' are not linked")
        self.service.graph = mutate.disconnect(self.service.graph, self.owner, other)

    def clear(self) -> None:
        g = self.service.graph
        self.service.graph = type(g)(g.base, g.links.where((F.col("a_gid") != self.owner) & (F.col("b_gid") != self.owner)))
