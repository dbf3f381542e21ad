"""The property graph: node and link tables, and what is derived from them."""

from __future__ import annotations

from functools import cached_property
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import names
from weft.plans.session import by_size, distinct_of
from weft.sources.placed import Placed

if TYPE_CHECKING:
    from weft.sources.trigrams import TextIndex

ATTRS = T.MapType(T.StringType(), T.StringType())
NODES = T.StructType([T.StructField("gid", T.StringType(), False), T.StructField("attrs", ATTRS)])
LINKS = T.StructType([T.StructField("a_gid", T.StringType(), False), T.StructField("b_gid", T.StringType(), False)])


class PropertyGraph:
    """nodes(gid, attrs) and links(a_gid, b_gid); the hierarchy lies in the paths.

    ``nodes`` may hold more derived columns already; links are undirected and never between a
    node and itself. ``unique`` tells that no link is stored twice (in either direction) or beside
    the hierarchy edge of the same nodes; then no plan pays for making neighbours distinct.
    """

    def __init__(self, nodes: DataFrame, links: DataFrame, unique: bool = False):
        self.spark, self.unique = nodes.sparkSession, unique
        self.base, self.links = nodes.select("gid", "attrs"), links.select("a_gid", "b_gid")

    @classmethod
    def of(cls, spark: SparkSession, nodes: dict[str, dict] | list, links: list[tuple[str, str]] = ()) -> "PropertyGraph":
        rows = [(g, a or {}) for g, a in (nodes.items() if isinstance(nodes, dict) else ((n, {}) for n in nodes))]
        pairs = sorted({tuple(sorted(x)) for x in links if x[0] != x[1]})
        return cls(spark.createDataFrame(rows, NODES), spark.createDataFrame(pairs, LINKS))

    @cached_property
    def nodes(self) -> DataFrame:
        """gid, local_id, parent_gid (null at the top), depth, attrs."""
        return self.base.select(
            "gid", names.local_id(F.col("gid")).alias("local_id"), names.parent(F.col("gid")).alias("parent_gid"),
            names.depth(F.col("gid")).alias("depth"), F.coalesce("attrs", F.create_map().cast(ATTRS)).alias("attrs")
        )

    @cached_property
    def edges(self) -> DataFrame:
        """a_gid < b_gid, kind: stored links and parent-child edges; none leads to the root."""
        up = self.nodes.where("parent_gid is not null").select(
            F.least("gid", "parent_gid").alias("a_gid"), F.greatest("gid", "parent_gid").alias("b_gid"), F.lit("hierarchy").alias("kind")
        )
        link = self.links.select(
            F.least("a_gid", "b_gid").alias("a_gid"), F.greatest("a_gid", "b_gid").alias("b_gid"), F.lit("link").alias("kind")
        ).where("a_gid <> b_gid")
        return link.unionByName(up)

    @cached_property
    def adj(self) -> DataFrame:
        """src, dst, kind in both directions."""
        e = self.edges
        return e.select(
            F.explode(F.array(
                F.struct(F.col("a_gid").alias("src"), F.col("b_gid").alias("dst")),
                F.struct(F.col("b_gid").alias("src"), F.col("a_gid").alias("dst"))
            )).alias("e"),
            "kind"
        ).select("e.src", "e.dst", "kind")

    @cached_property
    def neighbours(self) -> DataFrame:
        """Distinct (src, dst)."""
        pairs = self.adj.select("src", "dst")
        return pairs if self.unique else pairs.distinct()

    @cached_property
    def placed(self) -> Placed:
        """The neighbours, written once for all that joins them again and again."""
        return Placed(self.neighbours)

    @cached_property
    def text_index(self) -> "TextIndex":
        """Trigrams of names and attributes, written once; searches on this graph use it from then on."""
        from weft.sources.trigrams import TextIndex

        return TextIndex(self.nodes)

    @property
    def is_indexed(self) -> bool:
        return "text_index" in self.__dict__

    @property
    def is_placed(self) -> bool:
        return "placed" in self.__dict__

    @cached_property
    def told_apart(self) -> bool:
        """Whether no two nodes share a gid, case ignored. By 64-bit hashes: two that differ may be taken for one, never the reverse."""
        return self.base.groupBy(F.xxhash64(F.lower("gid"))).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()

    def degree(self) -> DataFrame:
        """gid, degree of every node, isolated ones too."""
        d = self.placed.degree() if self.is_placed else self.neighbours.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
        return self.nodes.select("gid").join(d.withColumnRenamed("src", "gid"), "gid", "left").select("gid", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))

    # Scans and look-ups.

    def roots(self) -> DataFrame:
        return self.nodes.where("parent_gid is null")

    def children(self, gid: str) -> DataFrame:
        return self.nodes.where(F.col("parent_gid") == gid)

    def get(self, gid: str) -> DataFrame:
        """The node of a path, or no row."""
        return self.nodes.where(F.col("gid") == F.lit(gid))

    def resolve(self, path: str) -> DataFrame:
        """gid of a locator whose segments may be children or links, one look-up for each segment."""
        first, *rest = path.split("/")
        at = self.nodes.where(F.col("parent_gid").isNull() & (F.col("local_id") == first)).select("gid")
        for name in rest:
            at = at.join(
                self.adj, F.col("gid") == F.col("src")
            ).where(names.local_id(F.col("dst")) == name).where(~names.is_descendant(F.col("gid"), F.col("dst"))).select(F.col("dst").alias("gid")).distinct()
        return at

    def neighbour(self, gid: str, local_id: str) -> DataFrame:
        """The neighbour with this local id; more than one is an error when the row is read."""
        found = self.neighbours.where(F.col("src") == gid).where(names.local_id(F.col("dst")) == local_id)
        one = found.agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("gid"))
        return one.where("n > 0").select(F.when(
            F.col("n") > 1, F.raise_error(F.lit(f"'{gid}' has several neighbours named '{local_id}'"))
        ).otherwise(F.col("gid")).alias("gid"))

    def neighbours_of(self, gid: str) -> DataFrame:
        return self.adj.where(F.col("src") == gid).select("dst").distinct()

    def incident(self, gid: str) -> DataFrame:
        return self.adj.where(F.col("src") == gid)


def attributes_from_json(text):
    """A JSON object as a map; anything unreadable is an empty map."""
    return F.coalesce(F.from_json(text, ATTRS, {"mode": "PERMISSIVE"}), F.create_map().cast(ATTRS))


def tpch_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The test tables as a property graph: regions / nations / customers and suppliers, parts, orders."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    kv = lambda **c: F.map_filter(
        F.create_map(*(x for k, v in c.items() for x in (F.lit(k), (F.lit(v) if isinstance(v, str) else v).cast("string")))),
        lambda _, v: v.isNotNull()
    )
    clean = lambda c: F.replace(F.col(c), F.lit("#"), F.lit("-"))
    region, nation = t("region"), t("nation")
    land = F.broadcast(nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("land")))
    customer = t("customer").join(land, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.concat_ws("/", "land", clean("c_name")).alias("gid"), "c_mktsegment"
    )
    supplier = t("supplier").join(land, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat_ws("/", "land", clean("s_name")).alias("gid"))
    part_gid, order_gid = (lambda c: F.concat(F.lit("Part-"), F.col(c).cast("string"))), (lambda c: F.concat(F.lit("Order-"), F.col(c).cast("string")))
    nodes = (
        region.select(F.col("r_name").alias("gid"), kv(kind="region").alias("attrs"))
        .unionByName(land.select(F.col("land").alias("gid"), kv(kind="nation").alias("attrs")))
        .unionByName(customer.select("gid", kv(kind="customer", segment=F.col("c_mktsegment")).alias("attrs")))
        .unionByName(supplier.select("gid", kv(kind="supplier").alias("attrs")))
        .unionByName(t("part").select(
            part_gid("p_partkey").alias("gid"),
            kv(kind="part", brand=F.col("p_brand"), type=F.col("p_type"), name=F.col("p_name"), size=F.col("p_size")).alias("attrs")
        ))
        .unionByName(t("orders").select(
            order_gid("o_orderkey").alias("gid"),
            kv(kind="order", status=F.col("o_orderstatus"), priority=F.col("o_orderpriority")).alias("attrs")
        ))
    )
    line = t("lineitem")
    lines = line.count()  # read off the footers
    pair = lambda df, a, b: df.select(F.least(a, b).alias("a_gid"), F.greatest(a, b).alias("b_gid"))
    owns = pair(t("orders").join(by_size(customer), F.col("o_custkey") == F.col("c_custkey")), order_gid("o_orderkey"), F.col("gid"))
    holds = pair(distinct_of(line.select("l_orderkey", "l_partkey"), lines), order_gid("l_orderkey"), part_gid("l_partkey"))
    made = pair(distinct_of(line.select("l_partkey", "l_suppkey"), lines).join(by_size(supplier), F.col("l_suppkey") == F.col("s_suppkey")), part_gid("l_partkey"), F.col("gid"))
    return PropertyGraph(nodes, owns.unionByName(holds).unionByName(made), unique=True)
