"""The registered queries of the graph engine and the SQL that states their results.

Each entry runs one operator over the property graph of the test tables (or over tables derived
from them) and returns its full result; a limit stands only where it is the feature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.functions import names, scalars, text
from weft.operators import message_passing as mp
from weft.operators import asof, bridges, carrier, measure, mutate, semantic, traverse, typed, view
from weft.plans import compile as plans
from weft.plans import templates
from weft.plans.session import shared_path, stored
from weft.sources import definitions, records, sinks, storage
from weft.sources.graph import PropertyGraph, attributes_from_json, tpch_graph
from weft.streaming import changes, links

GRAPH = """
land AS (SELECT n_nationkey, r_name || '/' || n_name AS land FROM nation JOIN region ON n_regionkey = r_regionkey),
cust AS (SELECT c_custkey, land || '/' || replace(c_name, '#', '-') AS gid, c_mktsegment FROM customer JOIN land ON c_nationkey = n_nationkey),
supp AS (SELECT s_suppkey, land || '/' || replace(s_name, '#', '-') AS gid FROM supplier JOIN land ON s_nationkey = n_nationkey),
nodes AS (
  SELECT r_name AS gid, 'region' AS kind, NULL AS segment, NULL AS brand, NULL AS ptype, NULL AS pname, NULL AS psize, NULL AS status, NULL AS priority FROM region
  UNION ALL SELECT land, 'nation', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM land
  UNION ALL SELECT gid, 'customer', c_mktsegment, NULL, NULL, NULL, NULL, NULL, NULL FROM cust
  UNION ALL SELECT gid, 'supplier', NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM supp
  UNION ALL SELECT 'Part-' || p_partkey, 'part', NULL, p_brand, p_type, p_name, CAST(p_size AS VARCHAR), NULL, NULL FROM part
  UNION ALL SELECT 'Order-' || o_orderkey, 'order', NULL, NULL, NULL, NULL, NULL, o_orderstatus, o_orderpriority FROM orders),
links AS (SELECT least(a, b) AS a_gid, greatest(a, b) AS b_gid FROM (
  SELECT 'Order-' || o_orderkey AS a, gid AS b FROM orders JOIN cust ON o_custkey = c_custkey
  UNION ALL SELECT DISTINCT 'Order-' || l_orderkey, 'Part-' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'Part-' || l_partkey, gid FROM lineitem JOIN supp ON l_suppkey = s_suppkey)),
par AS (SELECT gid, regexp_extract(gid, '^(.*)/[^/]*$', 1) AS parent FROM nodes WHERE contains(gid, '/')),
edges AS (SELECT a_gid, b_gid, 'link' AS kind FROM links UNION ALL SELECT least(gid, parent), greatest(gid, parent), 'hierarchy' FROM par),
adj AS (SELECT a_gid AS src, b_gid AS dst, kind FROM edges UNION ALL SELECT b_gid, a_gid, kind FROM edges),
deg AS (SELECT gid, count(DISTINCT dst) AS degree FROM nodes LEFT JOIN adj ON src = gid GROUP BY gid)
"""
_LINES = """
line AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber ORDER BY l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS k FROM lineitem),
rel AS (SELECT 'Line-' || l_orderkey || '-' || l_partkey || '-' || l_suppkey || '-' || l_linenumber || '-' || k AS id, 'Order-' || l_orderkey AS o, 'Part-' || l_partkey AS p, 'Supplier-' || l_suppkey AS s, * FROM line)
"""

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
NATION, REGION = "AFRICA/NATION_0", "AFRICA"


def query(sql: str | None = None, *, graph: bool = True, lines: bool = False, recursive: bool = False):
    """Register a function of (spark, sf_dir); with SQL over the graph's common tables."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            parts = ([GRAPH] if graph else []) + ([_LINES] if lines else [])
            body = sql.strip()
            if parts:
                head = "WITH " + ("RECURSIVE " if recursive else "") + ",".join(parts)
                body = head + (", " + body[5:] if body.upper().startswith("WITH ") else " " + body)
            _SQL[f.__name__] = body
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def var(name: str) -> dict:
    return {"kind": "var", "name": name}


def lit(name: str) -> dict:
    return {"kind": "literal", "name": name}


def both(*e: dict) -> dict:
    return {"kind": "all", "expressions": list(e)}


def attribute(n: str, key: str, value: str | None, op: str = "equals") -> dict:
    return {"kind": "attribute", "node": var(n), "key": key, "operator": op, "value": value}


def connected(a: dict, b: dict) -> dict:
    return {"kind": "connected", "left": a, "right": b}


def _rows(found: DataFrame, *returns: str) -> DataFrame:
    return found.select(*returns, "score", F.array_join("matched_by", ";").alias("matched_by"))


def _found(spark: SparkSession, sf_dir: str, where: dict | None, *returns: str) -> DataFrame:
    returns = returns or ("x",)
    return _rows(plans.solutions(tpch_graph(spark, sf_dir), {"return": list(returns), "where": where}), *returns)


def _whole(g: PropertyGraph) -> DataFrame:
    """Nodes and links of a graph as rows of one table."""
    return g.base.select(
        F.lit("node").alias("what"), F.col("gid").alias("a"), F.lit(None).cast("string").alias("b")
    ).unionByName(g.links.select(F.lit("link").alias("what"), F.col("a_gid").alias("a"), F.col("b_gid").alias("b")))


# Scans and look-ups.


@query(
    "SELECT gid, split_part(gid, '/', -1) AS local_id, CASE WHEN contains(gid, '/') THEN regexp_extract(gid, '^(.*)/[^/]*$', 1) END AS parent_gid, CAST(len(string_split(gid, '/')) AS INT) AS depth, kind FROM nodes"
)
def scan_nodes(spark, d):
    return tpch_graph(spark, d).nodes.select("gid", "local_id", "parent_gid", "depth", F.element_at("attrs", "kind").alias("kind"))


@query("SELECT src, dst, kind FROM adj")
def scan_adjacency(spark, d):
    return tpch_graph(spark, d).adj


@query("SELECT src, dst, kind FROM adj WHERE src = 'AFRICA/NATION_0'")
def incident_edges(spark, d):
    return tpch_graph(spark, d).incident(NATION)


@query("SELECT gid FROM par WHERE parent = 'AFRICA/NATION_0'")
def children(spark, d):
    return tpch_graph(spark, d).children(NATION).select("gid")


@query("SELECT gid FROM nodes WHERE NOT contains(gid, '/')")
def roots(spark, d):
    return tpch_graph(spark, d).roots().select("gid")


@query("SELECT a_gid, b_gid FROM links")
def scan_links(spark, d):
    return tpch_graph(spark, d).links


@query("SELECT gid, kind FROM nodes WHERE gid = 'Order-1'")
def point_get(spark, d):
    return tpch_graph(spark, d).get("Order-1").select("gid", F.element_at("attrs", "kind").alias("kind"))


@query("SELECT dst AS gid FROM adj WHERE src = 'Part-1' AND split_part(dst, '/', -1) = (SELECT min(split_part(dst, '/', -1)) FROM adj WHERE src = 'Part-1')")
def resolve_alias_path(spark, d):
    g = tpch_graph(spark, d)
    name = g.neighbours_of("Part-1").agg(F.min(names.local_id(F.col("dst")))).first()[0]
    return g.resolve(f"Part-1/{name}")


@query("SELECT dst AS gid FROM adj WHERE src = 'AFRICA' AND split_part(dst, '/', -1) = 'NATION_0'")
def neighbour_get(spark, d):
    return tpch_graph(spark, d).neighbour(REGION, "NATION_0")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events", graph=False)
def read_attributes_json(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", text.lookup(attributes_from_json(F.col("props")), "K").alias("k"))


@query("SELECT event_id, len(json_keys(props)) <> len(list_distinct(json_keys(props))) AS repeated FROM events", graph=False)
def strict_json_keys(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", records.repeated_keys(F.col("props")).alias("repeated"))


@query("SELECT gid, degree FROM deg")
def node_degree(spark, d):
    return tpch_graph(spark, d).degree()


@query(
    "SELECT dst AS gid FROM adj WHERE src = 'Order-1' INTERSECT SELECT dst FROM adj WHERE src = (SELECT min(a_gid) FROM links WHERE b_gid = (SELECT min(dst) FROM adj WHERE src = 'Order-1' AND dst LIKE 'Part-%') AND a_gid LIKE 'Order-%')"
)
def common_neighbours(spark, d):
    g = tpch_graph(spark, d)
    part = g.neighbours_of("Order-1").where("dst like 'Part-%'").agg(F.min("dst")).first()[0]
    other = g.links.where((F.col("b_gid") == part) & F.col("a_gid").like("Order-%")).agg(F.min("a_gid")).first()[0]
    return traverse.common_neighbours(g, ["Order-1", other])


@query("""WITH r AS (SELECT 'AFRICA' AS gid UNION SELECT dst FROM r JOIN adj ON src = r.gid) SELECT gid FROM r""", recursive=True)
def traverse_all_reachable(spark, d):
    return traverse.traverse(tpch_graph(spark, d), REGION)


# The query language.


@query("SELECT gid AS x, CAST(1.0 AS DOUBLE) AS score, 'node' AS matched_by FROM nodes")
def search_node(spark, d):
    return _found(spark, d, {"kind": "node", "node": var("x")})


@query("SELECT gid AS x, CAST(1.05 AS DOUBLE) AS score, 'name:equals:order-1;node' AS matched_by FROM nodes WHERE lower(gid) = 'order-1'")
def search_name_equals(spark, d):
    return _found(spark, d, {"kind": "name", "node": var("x"), "value": "order-1"})


@query("SELECT gid AS x, CAST(1.0 AS DOUBLE) AS score, 'name:contains:nation_1;node' AS matched_by FROM nodes WHERE contains(lower(strip_accents(gid)), 'nation_1')")
def search_name_contains(spark, d):
    return _found(spark, d, {"kind": "name", "node": var("x"), "operator": "contains", "value": "nation_1"})


@query("SELECT gid AS x, CAST(1.0 AS DOUBLE) AS score, 'name:startsWith:part-1;node' AS matched_by FROM nodes WHERE starts_with(lower(gid), 'part-1')")
def search_name_starts(spark, d):
    return _found(spark, d, {"kind": "name", "node": var("x"), "operator": "startsWith", "value": "part-1"})


@query("SELECT gid AS x, CAST(1.0 AS DOUBLE) AS score, 'name:endsWith:7;node' AS matched_by FROM nodes WHERE ends_with(lower(gid), '7')")
def search_name_ends(spark, d):
    return _found(spark, d, {"kind": "name", "node": var("x"), "operator": "endsWith", "value": "7"})


@query("SELECT gid AS x, CAST(1.0 AS DOUBLE) AS score, 'name:notEquals:AFRICA;node' AS matched_by FROM nodes WHERE lower(gid) <> 'africa'")
def search_name_not_equals(spark, d):
    return _found(spark, d, {"kind": "name", "node": var("x"), "operator": "notEquals", "value": "AFRICA"})


@query("SELECT gid AS x, CAST(1.0 AS DOUBLE) AS score, 'attribute:SEGMENT:equals;node' AS matched_by FROM nodes WHERE lower(segment) = 'machinery'")
def search_attribute_eq(spark, d):
    return _found(spark, d, attribute("x", "SEGMENT", "machinery"))


@query("SELECT gid AS x, CAST(1.0 AS DOUBLE) AS score, 'attribute:brand:notEquals;node' AS matched_by FROM nodes WHERE lower(brand) <> 'brand#2'")
def search_attribute_ne(spark, d):
    return _found(spark, d, attribute("x", "brand", "Brand#2", "notEquals"))


@query("SELECT gid AS x, CAST(1.0 AS DOUBLE) AS score, 'attribute:status:exists;node' AS matched_by FROM nodes WHERE status IS NOT NULL")
def search_attribute_exists(spark, d):
    return _found(spark, d, attribute("x", "status", None, "exists"))


@query("SELECT gid AS x, CAST(1.0 AS DOUBLE) AS score, 'attribute:priority:contains;node' AS matched_by FROM nodes WHERE contains(lower(priority), 'low')")
def search_attribute_contains(spark, d):
    return _found(spark, d, attribute("x", "priority", "LOW", "contains"))


@query("""
SELECT gid AS x, CAST(round_even(greatest(1.0, s + 0.05), 4) AS DOUBLE) AS score, 'text:small widget;node' AS matched_by FROM (
  SELECT gid, CASE WHEN lower(gid) = 'small widget' THEN 1.0 WHEN contains(lower(gid), 'small widget') THEN 0.85 WHEN contains(lower(pname), 'small widget') THEN 0.65
    WHEN contains(t, 'small') AND contains(t, 'widget') THEN 0.5 ELSE 0 END AS s
  FROM (SELECT gid, pname, lower(concat_ws(' ', gid, kind, segment, brand, ptype, pname, psize, status, priority)) AS t FROM nodes)) WHERE s > 0""")
def search_text_ranked(spark, d):
    return _found(spark, d, {"kind": "text", "node": var("x"), "value": "small widget"})


def _indexed(spark, sf_dir, where, *returns):
    """A search over a graph whose texts are indexed by trigrams first."""
    g = tpch_graph(spark, sf_dir)
    assert g.text_index is not None
    return _rows(plans.solutions(g, {"return": list(returns), "where": where}), *returns)


@query(_SQL["search_text_ranked"], graph=False)
def search_text_indexed(spark, d):
    return _indexed(spark, d, {"kind": "text", "node": var("x"), "value": "small widget"}, "x")


@query("SELECT gid AS x, CAST(1.55 AS DOUBLE) AS score, 'name:contains:tion_1/CUST;attribute:kind:contains;node' AS matched_by FROM nodes WHERE contains(lower(gid), 'tion_1/cust')")
def search_contains_indexed(spark, d):
    return _indexed(spark, d, both({"kind": "name", "node": var("x"), "operator": "contains", "value": "tion_1/CUST"}, attribute("x", "kind", "Stom", "contains")), "x")


@query("""
SELECT doc_id, CASE WHEN lower(coalesce(source, '')) = 'src1' THEN 1.0 WHEN contains(lower(coalesce(source, '')), 'src1') THEN 0.85 WHEN contains(lower(coalesce(lang, '')), 'src1') OR contains(lower(strip_accents(coalesce(text, ''))), 'src1') THEN 0.65 ELSE 0.0 END::DOUBLE AS score FROM documents""", graph=False)
def text_score_documents(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    attrs = F.create_map(F.lit("lang"), F.coalesce("lang", F.lit("")), F.lit("text"), F.coalesce("text", F.lit("")))
    return docs.select("doc_id", text.text_score(F.coalesce("source", F.lit("")), attrs, "src1").alias("score"))


@query(
    "SELECT DISTINCT src AS x, CAST(1.4 AS DOUBLE) AS score, 'attribute:kind:equals;connected:depth=1;node' AS matched_by FROM adj JOIN nodes ON gid = src WHERE nodes.kind = 'part' AND dst = 'Order-1'"
)
def search_connected(spark, d):
    return _found(spark, d, both(attribute("x", "kind", "part"), connected(var("x"), lit("Order-1"))))


@query(
    """SELECT DISTINCT src AS x, CAST(1.4 AS DOUBLE) AS score, 'attribute:kind:equals;connected:depth=1;node' AS matched_by FROM adj JOIN nodes ON gid = src WHERE nodes.kind = 'customer' AND dst = 'AFRICA/NATION_0'"""
)
def search_literal_in_another_case(spark, d):
    return _found(spark, d, both(attribute("x", "kind", "customer"), connected(var("x"), lit("/africa\\nation_0/"))))


@query("""SELECT o.src AS n, p.dst AS z, CAST(round_even(2 * 0.65 + 2 * 0.7 + 2 * 0.4 + 2 * 0.05, 4) AS DOUBLE) AS score,
  'attribute:kind:equals;attribute:size:equals;connected:depth=1;name:startsWith:Order-1;name:startsWith:AFRICA/;node' AS matched_by
FROM nodes JOIN adj o ON gid = o.dst JOIN adj p ON p.src = o.dst WHERE nodes.kind = 'part' AND psize = '7' AND o.src LIKE 'Order-1%' AND p.dst LIKE 'AFRICA/%' GROUP BY ALL""")
def search_two_hop(spark, d):
    starts = [{"kind": "name", "node": var(v), "operator": "startsWith", "value": value} for v, value in (("n", "Order-1"), ("z", "AFRICA/"))]
    where = both(attribute("x", "kind", "part"), attribute("x", "size", "7"), connected(var("n"), var("x")), connected(var("x"), var("z")), *starts)
    return _found(spark, d, where, "n", "z")


@query("""WITH c AS (SELECT min(dst) AS a, max(dst) AS b FROM adj WHERE src = 'Order-1' AND dst LIKE 'Part-%')
SELECT x, CAST(round_even(0.65 + 2 * 0.7 + 0.05, 4) AS DOUBLE) AS score, 'attribute:kind:equals;connected:depth=1;node' AS matched_by
FROM (SELECT src AS x FROM adj, c WHERE dst = a AND src LIKE 'Order-%' INTERSECT SELECT src FROM adj, c WHERE dst = b AND src LIKE 'Order-%')""")
def search_all_anchors(spark, d):
    g = tpch_graph(spark, d)
    a, b = g.neighbours_of("Order-1").where("dst like 'Part-%'").agg(F.min("dst"), F.max("dst")).first()
    return _found(spark, d, both(attribute("x", "kind", "order"), connected(var("x"), lit(a)), connected(var("x"), lit(b))))


@query(
    """SELECT gid AS x, CAST(1.4 AS DOUBLE) AS score, 'attribute:kind:equals;connected:depth=1;node' AS matched_by FROM nodes WHERE kind = 'order' AND (gid IN (SELECT src FROM adj WHERE dst = 'Part-1') OR gid IN (SELECT src FROM adj WHERE dst = 'Part-2'))"""
)
def search_any_anchor(spark, d):
    return _found(
        spark, d,
        both(attribute("x", "kind", "order"), {"kind": "any", "expressions": [connected(var("x"), lit("Part-1")), connected(var("x"), lit("Part-2"))]})
    )


_REACH3 = """WITH r AS (SELECT 'Order-1' AS gid, 0 AS d UNION SELECT dst, d + 1 FROM r JOIN adj ON src = r.gid WHERE d < 2), m AS (SELECT gid, min(d) AS d FROM r GROUP BY gid)"""


@query(
    _REACH3 + """ SELECT m.gid AS x, CAST(round_even(greatest(1.0, 0.65 + 0.7 / d + 0.05), 4) AS DOUBLE) AS score, 'attribute:kind:equals;path:depth=' || d || ';node' AS matched_by FROM m JOIN nodes USING (gid) WHERE d BETWEEN 1 AND 2 AND kind = 'supplier'""",
    recursive=True
)
def search_path_within(spark, d):
    return _found(spark, d, both(attribute("x", "kind", "supplier"), {"kind": "path", "left": var("x"), "right": lit("Order-1"), "minDepth": 1, "maxDepth": 2}))


@query("SELECT gid AS x, CAST(1.05 AS DOUBLE) AS score, 'path:depth=0;node' AS matched_by FROM nodes")
def search_path_zero_self(spark, d):
    return _found(spark, d, {"kind": "path", "left": var("x"), "right": var("x"), "minDepth": 0, "maxDepth": 0, "includeSelf": True})


@query("""SELECT gid AS x, CAST(round_even(0.3 + 0.75 + 0.25 / d + 0.05, 4) AS DOUBLE) AS score, 'ancestor:AFRICA;descendant-of:AFRICA depth=' || d || ';node' AS matched_by
FROM (SELECT gid, len(string_split(gid, '/')) - 1 AS d FROM nodes WHERE starts_with(gid, 'AFRICA/')) WHERE d BETWEEN 1 AND 2""")
def search_descendant(spark, d):
    return _found(spark, d, {"kind": "descendant", "ancestor": lit(REGION), "descendant": var("x"), "maxDepth": 2})


@query("""SELECT u.gid AS a, n.gid AS x, CAST(round_even(0.65 + 0.3 + 0.75 + 0.25 / l + 2 * 0.05, 4) AS DOUBLE) AS score,
  'attribute:kind:equals;ancestor:' || u.gid || ';descendant-of:' || u.gid || ' depth=' || l || ';node' AS matched_by
FROM (SELECT n.gid, u.gid AS up, len(string_split(n.gid, '/')) - len(string_split(u.gid, '/')) AS l FROM nodes n JOIN nodes u ON starts_with(n.gid, u.gid || '/') WHERE n.kind = 'supplier') n JOIN nodes u ON u.gid = up""")
def search_all_ancestors(spark, d):
    return _found(spark, d, both(attribute("x", "kind", "supplier"), {"kind": "descendant", "ancestor": var("a"), "descendant": var("x")}), "a", "x")


@query(
    "SELECT gid AS x, CAST(1.15 AS DOUBLE) AS score, 'attribute:kind:equals;degree:greaterThanOrEqual:8;node' AS matched_by FROM deg JOIN nodes USING (gid) WHERE degree >= 8 AND kind = 'order'"
)
def search_degree_ge(spark, d):
    return _found(spark, d, both(attribute("x", "kind", "order"), {"kind": "degree", "node": var("x"), "operator": "greaterThanOrEqual", "value": 8}))


@query("SELECT gid AS x, gid AS y, CAST(1.0 AS DOUBLE) AS score, 'attribute:kind:equals;same;node' AS matched_by FROM nodes WHERE kind = 'nation'")
def search_same(spark, d):
    return _found(spark, d, both(attribute("x", "kind", "nation"), {"kind": "same", "left": var("x"), "right": var("y")}), "x", "y")


@query(
    "SELECT a.gid AS x, b.gid AS y, CAST(1.5 AS DOUBLE) AS score, 'attribute:kind:equals;not-same;node' AS matched_by FROM nodes a, nodes b WHERE a.kind = 'nation' AND b.kind = 'region' AND a.gid <> b.gid"
)
def search_not_same(spark, d):
    return _found(spark, d, both(attribute("x", "kind", "nation"), attribute("y", "kind", "region"), {"kind": "notSame", "left": var("x"), "right": var("y")}), "x", "y")


@query(
    """SELECT 'Lonely-' || r_regionkey AS x, CAST(1.0 AS DOUBLE) AS score, 'node;not' AS matched_by FROM region UNION ALL SELECT gid, 1.0, 'node;not' FROM deg WHERE degree = 0"""
)
def search_isolated(spark, d):
    """Beside the graph's own nodes, one without any edge for each region."""
    g = tpch_graph(spark, d)
    lonely = spark.read.parquet(f"{d}/region.parquet").select(
        F.concat(F.lit("Lonely-"), F.col("r_regionkey").cast("string")).alias("gid"),
        F.create_map().cast("map<string,string>").alias("attrs")
    )
    g = PropertyGraph(g.base.unionByName(lonely), g.links, unique=True)
    return _rows(plans.solutions(g, templates.isolated()), "x")


@query(
    """SELECT gid AS x, CAST(1.0 AS DOUBLE) AS score, 'attribute:kind:equals;not;node' AS matched_by FROM nodes WHERE kind = 'order' AND NOT EXISTS (SELECT 1 FROM adj JOIN nodes p ON p.gid = dst WHERE src = nodes.gid AND p.psize = '7')"""
)
def search_not_connected_to_kind(spark, d):
    return _found(spark, d, both(attribute("x", "kind", "order"), {"kind": "not", "expression": both(connected(var("x"), var("p")), attribute("p", "size", "7"))}))


@query(
    """SELECT o.gid AS x, CAST(round_even(greatest(1.0, 0.65 + 0.7 + 0.65 + 0.05), 4) AS DOUBLE) AS score, 'attribute:kind:equals;exists;node' AS matched_by FROM nodes o WHERE kind = 'order' AND EXISTS (SELECT 1 FROM adj JOIN nodes p ON p.gid = dst WHERE src = o.gid AND p.psize = '7')"""
)
def search_exists_score(spark, d):
    return _found(
        spark, d,
        both(attribute("x", "kind", "order"), {"kind": "exists", "variables": ["p"], "expression": both(connected(var("x"), var("p")), attribute("p", "size", "7"))})
    )


@query("""SELECT gid AS x, CAST(1.0 AS DOUBLE) AS score, 'attribute:kind:equals;node' AS matched_by FROM nodes WHERE kind = 'order' ORDER BY gid LIMIT 50""")
def search_limit(spark, d):
    return _rows(plans.search(tpch_graph(spark, d), {"return": ["x"], "where": attribute("x", "kind", "order")}), "x")


@query("SELECT gid AS n, 'n=' || gid AS bindings FROM nodes WHERE kind = 'nation'")
def search_bindings(spark, d):
    q = {"where": attribute("n", "kind", "nation")}
    got = plans.matches(plans.solutions(tpch_graph(spark, d), q), q)
    return got.select(
        F.col("node").alias("n"),
        F.array_join(F.transform(F.map_entries("bindings"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("bindings")
    )


@query("""SELECT a.src AS n, a.dst AS x, b.dst AS z, CAST(round_even(2 * 0.7 + 3 * 0.05, 4) AS DOUBLE) AS score, 'connected:depth=1;node' AS matched_by
FROM (SELECT DISTINCT src, dst FROM adj) a JOIN (SELECT DISTINCT src, dst FROM adj) b ON a.dst = b.src ORDER BY n, x, z LIMIT 50""")
def template_neighbour_connected(spark, d):
    return _rows(plans.search(tpch_graph(spark, d), templates.neighbour_connected()), "n", "x", "z")


# Patterns of several relations: they are reduced to what can match before they are joined.

_NEAR = "near AS (SELECT DISTINCT src, dst FROM adj)"


@query(f"""WITH {_NEAR} SELECT a.src AS s, a.dst AS p, b.dst AS o, c.dst AS c, CAST(round_even(3 * 0.7 + 4 * 0.65 + 4 * 0.05, 4) AS DOUBLE) AS score,
  'connected:depth=1;attribute:kind:equals;attribute:status:equals;attribute:segment:equals;node' AS matched_by
FROM near a JOIN near b ON a.dst = b.src JOIN near c ON b.dst = c.src JOIN nodes ns ON ns.gid = a.src JOIN nodes np ON np.gid = a.dst JOIN nodes no ON no.gid = b.dst JOIN nodes nc ON nc.gid = c.dst
WHERE ns.kind = 'supplier' AND np.kind = 'part' AND no.status = 'P' AND nc.segment = 'MACHINERY'""")
def search_chain_of_four(spark, d):
    """Supplier, part, order, customer; the conditions that select come last."""
    links = [connected(var(a), var(b)) for a, b in ("sp", "po", "oc")]
    tests = [attribute("s", "kind", "supplier"), attribute("p", "kind", "part"), attribute("o", "status", "P"), attribute("c", "segment", "MACHINERY")]
    return _found(spark, d, both(*links, *tests), "s", "p", "o", "c")


@query(f"""WITH {_NEAR} SELECT x.gid AS x, a.dst AS p, b.dst AS q, c.dst AS c, CAST(round_even(0.65 * 4 + 0.7 * 3 + 0.1 + 4 * 0.05, 4) AS DOUBLE) AS score,
  'attribute:kind:equals;connected:depth=1;attribute:size:equals;attribute:brand:equals;not-same;attribute:segment:equals;node' AS matched_by
FROM nodes x JOIN near a ON a.src = x.gid JOIN near b ON b.src = x.gid JOIN near c ON c.src = x.gid JOIN nodes np ON np.gid = a.dst JOIN nodes nq ON nq.gid = b.dst JOIN nodes nc ON nc.gid = c.dst
WHERE x.kind = 'order' AND np.psize = '7' AND nq.brand = 'Brand#3' AND nc.segment = 'BUILDING' AND np.gid <> nq.gid""")
def search_star(spark, d):
    """Orders of one segment's customers that hold a part of a size and another of a brand."""
    where = both(
        attribute("x", "kind", "order"), connected(var("x"), var("p")), attribute("p", "size", "7"), connected(var("x"), var("q")), attribute("q", "brand", "Brand#3"),
        {"kind": "notSame", "left": var("p"), "right": var("q")}, connected(var("x"), var("c")), attribute("c", "segment", "BUILDING")
    )
    return _found(spark, d, where, "x", "p", "q", "c")


@query(f"""WITH sells AS (SELECT DISTINCT 'Order-' || l_orderkey AS o, supp.gid AS s FROM lineitem JOIN supp ON l_suppkey = s_suppkey),
more AS (SELECT src, dst FROM adj UNION SELECT o, s FROM sells UNION SELECT s, o FROM sells)
SELECT a.src AS o, a.dst AS p, b.dst AS s, CAST(round_even(3 * 0.7 + 2 * 0.65 + 3 * 0.05, 4) AS DOUBLE) AS score, 'connected:depth=1;attribute:kind:equals;attribute:size:equals;node' AS matched_by
FROM more a JOIN more b ON a.dst = b.src JOIN more c ON b.dst = c.src AND c.dst = a.src JOIN nodes ns ON ns.gid = b.dst JOIN nodes np ON np.gid = a.dst WHERE ns.kind = 'supplier' AND np.psize = '7'""")
def search_triangle(spark, d):
    """Order, part and supplier, each beside the other two; orders are linked with their suppliers here."""
    g = tpch_graph(spark, d)
    supplier = g.nodes.where("attrs['kind'] = 'supplier'").select("gid", F.regexp_extract("gid", "([0-9]+)$", 1).cast("long").alias("l_suppkey"))
    line = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_suppkey").distinct().join(supplier, "l_suppkey")
    order = F.concat(F.lit("Order-"), F.col("l_orderkey").cast("string"))
    g = PropertyGraph(g.base, g.links.unionByName(line.select(F.least(order, "gid").alias("a_gid"), F.greatest(order, "gid").alias("b_gid"))), unique=True)
    where = both(connected(var("o"), var("p")), connected(var("p"), var("s")), connected(var("s"), var("o")), attribute("s", "kind", "supplier"), attribute("p", "size", "7"))
    return _rows(plans.solutions(g, {"return": ["o", "p", "s"], "where": where}), "o", "p", "s")


@query(f"""WITH {_NEAR}, x AS (SELECT gid FROM nodes WHERE lower(gid) IN ('part-1', 'part-2', 'part-3')), y AS (SELECT gid FROM nodes WHERE segment = 'FURNITURE'),
l0 AS (SELECT gid AS s, gid AS t, 0 AS d FROM x), l1 AS (SELECT s, dst AS t, 1 AS d FROM l0 JOIN near ON src = t), l2 AS (SELECT DISTINCT s, dst AS t, 2 AS d FROM l1 JOIN near ON src = t),
l3 AS (SELECT DISTINCT s, dst AS t, 3 AS d FROM l2 JOIN near ON src = t), l4 AS (SELECT DISTINCT s, dst AS t, 4 AS d FROM l3 JOIN near ON src = t WHERE dst IN (SELECT gid FROM y)),
m AS (SELECT s, t, min(d) AS d FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l4) WHERE t IN (SELECT gid FROM y) GROUP BY s, t)
SELECT s AS x, t AS y, CAST(round_even(greatest(1.0, 1.0 + 0.65 + 0.7 / d + 2 * 0.05), 4) AS DOUBLE) AS score, 'name:equals:' || lower(s) || ';attribute:segment:equals;path:depth=' || d || ';node' AS matched_by FROM m WHERE d >= 1""")
def search_paths_between(spark, d):
    """Shortest paths of up to four steps between some parts and the customers of a segment, met from both sides."""
    parts = {"kind": "any", "expressions": [{"kind": "name", "node": var("x"), "value": f"part-{k}"} for k in (1, 2, 3)]}
    path = {"kind": "path", "left": var("x"), "right": var("y"), "minDepth": 1, "maxDepth": 4}
    return _found(spark, d, both(parts, attribute("y", "segment", "FURNITURE"), path), "x", "y")


@query(f"""WITH {_NEAR}, r AS (SELECT gid AS src, gid AS dst, 0 AS d FROM nodes WHERE kind = 'nation' UNION SELECT r.src, near.dst, d + 1 FROM r JOIN near ON near.src = r.dst WHERE d < 3),
m AS (SELECT src, dst, min(d) AS dist FROM r GROUP BY src, dst)
SELECT src, dst, dist, row_number() OVER (PARTITION BY src ORDER BY dist, dst) - 1 AS ord FROM m WHERE dist >= 1""", recursive=True)
def reachability_order(spark, d):
    """What each nation reaches in three steps, in the order of a search: by distance, then by name."""
    g = tpch_graph(spark, d)
    return traverse.reach_in_order(g.placed, g.nodes.where("attrs['kind'] = 'nation'").select("gid"), 1, 3)


@query("""SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS ord FROM (SELECT DISTINCT src, dst FROM adj)""")
def neighbour_order(spark, d):
    return traverse.in_order(tpch_graph(spark, d).neighbours.withColumn("dist", F.lit(1))).drop("dist")


@query("""SELECT DISTINCT src AS n, dst AS x, CAST(round_even(0.7 + 0.65 + 2 * 0.05, 4) AS DOUBLE) AS score, 'connected:depth=1;attribute:segment:equals;node' AS matched_by
FROM adj JOIN nodes ON gid = dst WHERE segment = 'MACHINERY'""")
def template_neighbour_by_id(spark, d):
    return _rows(plans.solutions(tpch_graph(spark, d), templates.neighbour_by_id("segment", "MACHINERY")), "n", "x")


# Traversal.


@query(
    "WITH r AS (SELECT 'Order-1' AS gid, 0 AS d UNION SELECT dst, d + 1 FROM r JOIN adj ON src = r.gid WHERE d < 2) SELECT gid, min(d) AS dist FROM r GROUP BY gid",
    recursive=True
)
def subgraph_depth2(spark, d):
    return traverse.subgraph(tpch_graph(spark, d), ["Order-1"], 2)


@query(
    "WITH r AS (SELECT gid, 0 AS d FROM nodes WHERE gid IN ('Order-1', 'Order-2', 'Part-3') UNION SELECT dst, d + 1 FROM r JOIN adj ON src = r.gid WHERE d < 1) SELECT gid, min(d) AS dist FROM r GROUP BY gid",
    recursive=True
)
def subgraph_multiroot(spark, d):
    return traverse.subgraph(tpch_graph(spark, d), ["Order-1", "Order-2", "Part-3"], 1)


@query(
    "WITH s AS (SELECT 'Order-1' AS gid UNION SELECT dst FROM adj WHERE src = 'Order-1') SELECT a_gid, b_gid, kind FROM edges WHERE a_gid IN (SELECT gid FROM s) AND b_gid IN (SELECT gid FROM s)"
)
def induced_edges(spark, d):
    g = tpch_graph(spark, d)
    return traverse.induced_edges(g, traverse.subgraph(g, ["Order-1"], 1))


@query(
    "WITH r AS (SELECT gid AS src, gid AS dst, 0 AS d FROM nodes WHERE kind = 'region' UNION SELECT r.src, adj.dst, d + 1 FROM r JOIN adj ON adj.src = r.dst WHERE d < 2) SELECT src, dst, min(d) AS dist FROM r GROUP BY src, dst HAVING min(d) >= 1",
    recursive=True
)
def reachability(spark, d):
    g = tpch_graph(spark, d)
    return traverse.reach(g.neighbours, g.nodes.where("attrs['kind'] = 'region'").select("gid"), 1, 2)


@query(
    """SELECT o.gid, c.gid AS component FROM (SELECT c_custkey AS k, gid FROM cust UNION ALL SELECT o_custkey, 'Order-' || o_orderkey FROM orders) o JOIN cust c ON c_custkey = k"""
)
def components(spark, d):
    """Customers and their orders: a component is a customer with all that it ordered."""
    g = tpch_graph(spark, d)
    n = g.nodes.where("attrs['kind'] in ('customer', 'order')").select("gid")
    e = g.links.join(n.withColumnRenamed("gid", "a_gid"), "a_gid", "left_semi").join(n.withColumnRenamed("gid", "b_gid"), "b_gid", "left_semi")
    return traverse.components(n, e.select(F.col("a_gid").alias("src"), F.col("b_gid").alias("dst")))


# Views.


def _tree(spark, d):
    g = tpch_graph(spark, d)
    n = g.nodes.where("attrs['kind'] in ('region', 'nation', 'customer', 'supplier')")
    return g, n, g.edges.where("kind = 'hierarchy'").select("a_gid", "b_gid")


@query("SELECT gid FROM nodes WHERE gid = 'AFRICA/NATION_0' OR starts_with(gid, 'AFRICA/NATION_0/')")
def bridge_collapse(spark, d):
    _, n, e = _tree(spark, d)
    return view.collapse(n, e, REGION, NATION)


@query("""WITH o AS (SELECT 'Order-' || o_orderkey AS gid, cust.gid AS c FROM orders JOIN cust ON o_custkey = c_custkey), k AS (SELECT c, count(*) AS n FROM o GROUP BY c),
w AS (SELECT gid, parent, 1 + coalesce(n, 0) AS n FROM par LEFT JOIN k ON c = gid WHERE gid NOT IN (SELECT land FROM land)), l AS (SELECT parent AS gid, sum(n) + 1 AS n FROM w GROUP BY parent),
t AS (SELECT gid, parent, n FROM w UNION ALL SELECT land.land, split_part(land.land, '/', 1), coalesce(l.n, 1) FROM land LEFT JOIN l ON l.gid = land.land UNION ALL SELECT o.gid, o.c, 1 FROM o JOIN k ON k.c = o.c WHERE k.n = 1),
r AS (SELECT split_part(parent, '/', 1) AS region, sum(n) + 1 AS n FROM t WHERE NOT contains(parent, '/') GROUP BY 1)
SELECT least(gid, parent) AS a_gid, greatest(gid, parent) AS b_gid, gid AS far, CAST(t.n AS BIGINT) AS n_far, CAST(r.n - t.n AS BIGINT) AS n_near FROM t JOIN r ON region = split_part(parent, '/', 1)""")
def all_bridges(spark, d):
    """Regions down to customers with their orders; a customer's orders are linked one after the other too, so only a lone order hangs on a bridge."""
    g = tpch_graph(spark, d)
    n = g.nodes.where("attrs['kind'] <> 'part'").select("gid")
    e = g.edges.join(n.withColumnRenamed("gid", "a_gid"), "a_gid", "left_semi").join(n.withColumnRenamed("gid", "b_gid"), "b_gid", "left_semi").select("a_gid", "b_gid")
    order = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey")
    after = F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    named = lambda c: F.concat(F.lit("Order-"), F.col(c).cast("string"))
    chain = order.withColumn("next", after).where("next is not null").select(named("o_orderkey").alias("a_gid"), named("next").alias("b_gid"))
    return bridges.bridges(n, e.unionByName(chain))


@query("SELECT gid, split_part(gid, '/', 1) AS root_component FROM nodes WHERE kind IN ('region', 'nation', 'customer', 'supplier')")
def root_components(spark, d):
    _, n, e = _tree(spark, d)
    return view.root_components(n, e)


@query("SELECT gid FROM nodes WHERE starts_with(gid, 'AFRICA/')")
def tree_branch(spark, d):
    return view.branch(tpch_graph(spark, d).nodes.select("gid", "parent_gid"), REGION)


@query("SELECT count(DISTINCT gid) AS n_nodes, (SELECT count(*) FROM (SELECT DISTINCT a_gid, b_gid FROM edges)) AS n_edges FROM nodes")
def primitive_counts(spark, d):
    g = tpch_graph(spark, d)
    return view.primitive_counts(g.nodes, g.edges)


@query("""WITH e AS (SELECT a_gid, b_gid, CASE WHEN kind = 'link' THEN 35.0 ELSE 8.0 END AS w FROM edges), s AS (SELECT gid, sum(w) AS dg, sum(CASE WHEN o = 'Order-1' THEN least(25.0, w * 0.35) ELSE 0 END) AS f FROM (SELECT a_gid AS gid, b_gid AS o, w FROM e UNION ALL SELECT b_gid, a_gid, w FROM e) GROUP BY gid)
SELECT gid, floor((CASE WHEN kind = 'part' THEN 50.0 ELSE 20.0 END + ln(1 + coalesce(dg, 0)) * 8 + CASE WHEN gid = 'AFRICA' THEN 18 ELSE 0 END + CASE WHEN gid = 'Order-1' THEN 30 ELSE 0 END + coalesce(f, 0)) * 10 + 0.5) / 10 AS rank FROM nodes LEFT JOIN s USING (gid)""")
def rank_nodes(spark, d):
    g = tpch_graph(spark, d)
    none = F.lit(None).cast("double").alias("type_rank")
    n = g.nodes.select("gid", F.when(F.element_at("attrs", "kind") == "part", "t").alias("type_gid"), none)
    return view.rank(n, g.edges.select("a_gid", "b_gid", none, (F.col("kind") == "link").alias("projected")), REGION, "Order-1")[0]


@query(
    """SELECT a_gid, b_gid, floor(greatest(0.0, CASE WHEN a_gid LIKE 'Order-1%' THEN 12.34 WHEN kind = 'link' THEN 35.0 ELSE 8.0 END) * 10 + 0.5) / 10 AS rank FROM edges"""
)
def rank_edges(spark, d):
    """Edges of some orders have a rank of their type; the others have that of their kind."""
    g = tpch_graph(spark, d)
    none = F.lit(None).cast("double").alias("type_rank")
    n = g.nodes.select("gid", F.lit(None).cast("string").alias("type_gid"), none)
    own = F.when(F.col("a_gid").like("Order-1%"), F.lit(12.34)).alias("type_rank")
    return view.rank(n, g.edges.select("a_gid", "b_gid", own, (F.col("kind") == "link").alias("projected")))[1].select("a_gid", "b_gid", "rank")


@query("""WITH p AS (SELECT gid, len(gid) * 10.0 AS x, len(string_split(gid, '/')) * 50.0 AS y FROM nodes), j AS (SELECT DISTINCT src, dst FROM adj),
f AS (SELECT src, sum((o.x - p.x) * (greatest(1.0, sqrt((o.x - p.x) ** 2 + (o.y - p.y) ** 2)) - 120) * 0.018 / greatest(1.0, sqrt((o.x - p.x) ** 2 + (o.y - p.y) ** 2))) AS fx,
  sum((o.y - p.y) * (greatest(1.0, sqrt((o.x - p.x) ** 2 + (o.y - p.y) ** 2)) - 120) * 0.018 / greatest(1.0, sqrt((o.x - p.x) ** 2 + (o.y - p.y) ** 2))) AS fy FROM j JOIN p ON p.gid = src JOIN p o ON o.gid = dst GROUP BY src)
SELECT gid, round(x + (coalesce(fx, 0) + (400 - x) * 0.0018) * 0.82, 3) AS x, round(y + (coalesce(fy, 0) + (300 - y) * 0.0018) * 0.82, 3) AS y FROM p LEFT JOIN f ON src = gid""")
def layout_step(spark, d):
    g = tpch_graph(spark, d)
    at = g.nodes.select("gid", (F.length("gid") * 10.0).alias("x"), (F.col("depth") * 50.0).alias("y"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"))
    return view.force_step(at, g.edges, 800, 600).select("gid", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("SELECT a_gid, b_gid, bool_or(kind = 'link') AS collapsed FROM edges GROUP BY ALL")
def edge_merge(spark, d):
    return view.merged_edges(tpch_graph(spark, d).edges.select("a_gid", "b_gid", (F.col("kind") == "link").alias("collapsed")))


@query("""WITH shown AS (SELECT gid FROM nodes WHERE kind IN ('order', 'customer')), e AS (SELECT a_gid AS anchor, b_gid AS other, a_gid LIKE '%7' AS c FROM links UNION ALL SELECT b_gid, a_gid, a_gid LIKE '%7' FROM links)
SELECT anchor, other, CASE WHEN other NOT IN (SELECT gid FROM shown) THEN 'load-neighbor' WHEN c THEN 'expand' ELSE 'collapse' END AS control FROM e WHERE anchor IN (SELECT gid FROM shown)""")
def frontier_controls(spark, d):
    """Links whose first end has a name that ends in 7 are collapsed."""
    g = tpch_graph(spark, d)
    return view.frontier_controls(g.links.withColumn("collapsed", F.col("a_gid").like("%7")), g.nodes.where("attrs['kind'] in ('order', 'customer')"))


def _basis(spark):
    return spark.createDataFrame([(f"{r}", "Node", r, None, True, False, ["kind"]) for r in ("AFRICA", "ASIA", "AMERICA", "EUROPE", "MIDDLE EAST")], view.BASIS)


@query(
    "SELECT dst AS node_gid, src AS type_gid FROM adj WHERE src IN ('AFRICA', 'ASIA', 'AMERICA', 'EUROPE', 'MIDDLE EAST') AND dst NOT IN ('AFRICA', 'ASIA', 'AMERICA', 'EUROPE', 'MIDDLE EAST')"
)
def view_facets(spark, d):
    return view.facets(tpch_graph(spark, d).edges, _basis(spark))


@query(
    "SELECT dst AS node_gid, src AS type_gid, 'kind' AS field, nodes.kind AS value FROM adj JOIN nodes ON gid = dst WHERE src IN ('AFRICA', 'ASIA', 'AMERICA', 'EUROPE', 'MIDDLE EAST')"
)
def record_fields(spark, d):
    g = tpch_graph(spark, d)
    return view.record_fields(g.nodes, g.edges, _basis(spark))


@query("""WITH off AS (SELECT 'AFRICA' AS gid UNION ALL SELECT gid FROM nodes WHERE starts_with(gid, 'AFRICA/')), e AS (SELECT DISTINCT a_gid, b_gid FROM edges)
SELECT a_gid, b_gid, a_gid || '|' || b_gid AS key, CAST(NULL AS VARCHAR) AS type_gid, FALSE AS projected FROM e WHERE a_gid NOT IN (SELECT gid FROM off) AND b_gid NOT IN (SELECT gid FROM off)""")
def view_projection_edges(spark, d):
    """All edges when the type AFRICA is collapsed: its own subtree holds its definition and goes."""
    g = tpch_graph(spark, d)
    return view.project(g.nodes, g.edges, _basis(spark).where("type_gid = 'AFRICA'").withColumn("collapsed", F.lit(True)), unique=g.unique)[1]


@query(
    """SELECT n.gid, least(src, dst) AS node1, greatest(src, dst) AS node2, split_part(dst, '/', -1) AS neighbor FROM nodes n JOIN (SELECT DISTINCT src, dst FROM adj) ON src = n.gid WHERE n.kind IN ('nation', 'part')"""
)
def node_responses(spark, d):
    g = tpch_graph(spark, d)
    got = view.responses(g, g.nodes.where("attrs['kind'] in ('nation', 'part')"))
    return got.select("gid", F.explode("edges").alias("e")).select("gid", "e.node1", "e.node2", "e.neighbor")


# The typed contract.

_SEED = {"Entity": [], "Order": ["Entity"], "Part": ["Entity"], "Supplier": ["Entity"]}


def _typed(spark, d):
    """Orders, parts and suppliers as instances, line items as relations."""
    attrs = {
        "Order": [("Price", "Double", True), ("Status", "String", False)], "Part": [("Size", "Int32", True), ("Price", "Int64", False)],
        "Supplier": [("Balance", "Decimal", True)]
    }
    rows = [(t, "Instance", t == "Entity", req, [], attrs.get(t, [])) for t, req in _SEED.items()]
    rows.append(("Line", "Relation", False, [], [("Order", "Order", 1, 1), ("Part", "Part", 1, 1), ("Supplier", "Supplier", 1, 1)], [("Quantity", "Int32", False)]))
    types = spark.createDataFrame(rows, typed.TYPES)
    t = lambda n: spark.read.parquet(f"{d}/{n}.parquet")
    none = F.create_map().cast("map<string,array<string>>")
    s = lambda c: F.col(c).cast("string")
    inst = lambda df, kind, key, attrs: df.select(
        F.concat(F.lit(kind + "-"), s(key)).alias("id"), F.lit("Instance").alias("kind"),
        F.array(F.lit("Entity"), F.lit(kind)).alias("type_ids"), attrs.alias("attributes"), none.alias("members")
    )
    money = lambda c: F.round(F.col(c), 2).cast("decimal(18,2)").cast("string")
    el = inst(t("orders"), "Order", "o_orderkey", F.create_map(F.lit("Price"), money("o_totalprice"), F.lit("Status"), s("o_orderstatus")))
    el = el.unionByName(inst(t("part"), "Part", "p_partkey", F.create_map(F.lit("Size"), s("p_size"), F.lit("Price"), money("p_retailprice"))))
    el = el.unionByName(inst(t("supplier"), "Supplier", "s_suppkey", F.create_map(F.lit("Balance"), money("s_acctbal"))))
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    k = F.row_number().over(W.partitionBy(*key).orderBy("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"))
    line = t("lineitem").withColumn("k", k)
    one = lambda prefix, c: F.array(F.concat(F.lit(prefix), s(c)))
    rel = line.select(
        F.concat_ws("-", F.lit("Line"), *(s(c) for c in key), s("k")).alias("id"), F.lit("Relation").alias("kind"),
        F.array(F.lit("Line")).alias("type_ids"),
        F.create_map(F.lit("Quantity"), F.col("l_quantity").cast("int").cast("string")).alias("attributes"),
        F.create_map(
            F.lit("Order"), one("Order-", "l_orderkey"), F.lit("Part"), one("Part-", "l_partkey"), F.lit("Supplier"),
            one("Supplier-", "l_suppkey")
        ).alias("members")
    )
    return types, el, rel


def _part_types(spark, d):
    """A type for each part, brand and kind of part: a part requires its brand, its kind and the part of half its number."""
    p = spark.read.parquet(f"{d}/part.parquet")
    s = lambda prefix, c: F.concat(F.lit(prefix), F.replace(c.cast("string"), F.lit("#"), F.lit("-")))
    k = F.col("p_partkey")
    none = F.array().cast(spark.createDataFrame([], typed.TYPES).schema["members"].dataType)
    kinds = spark.createDataFrame([], typed.TYPES).schema["attributes"].dataType
    own = F.array(F.struct(s("A", k).alias("name"), F.lit("Int32").alias("kind"), F.lit(True).alias("required"))).cast(kinds)
    half = F.when(k > 0, F.array(s("Part-", F.floor(k / 2)))).otherwise(F.array().cast("array<string>"))
    row = lambda df, identifier, required, attributes: df.select(
        identifier.alias("type_id"), F.lit("Instance").alias("kind"), F.lit(False).alias("is_abstract"), required.alias("required_type_ids"), none.alias("members"), attributes.alias("attributes")
    )
    parts = row(p, s("Part-", k), F.concat(F.array(s("", F.col("p_brand")), s("Kind ", F.col("p_type"))), half), own)
    brands = row(p.select("p_brand").distinct(), s("", F.col("p_brand")), F.array(F.lit("Entity")), F.array().cast(kinds))
    named = F.array(F.struct(F.lit("Kind").alias("name"), F.lit("String").alias("kind"), F.lit(False).alias("required"))).cast(kinds)
    types = row(p.select("p_type").distinct(), s("Kind ", F.col("p_type")), F.array(F.lit("Entity")), named)
    entity = row(p.limit(1), F.lit("Entity"), F.array().cast("array<string>"), F.array().cast(kinds))
    return parts.unionByName(brands).unionByName(types).unionByName(entity)


_PART_ARCS = """arcs AS (SELECT 'Part-' || p_partkey AS a, unnest(list_concat([replace(p_brand, '#', '-'), 'Kind ' || p_type], CASE WHEN p_partkey > 0 THEN ['Part-' || (p_partkey // 2)] ELSE [] END)) AS b FROM part
  UNION SELECT replace(p_brand, '#', '-'), 'Entity' FROM part UNION SELECT 'Kind ' || p_type, 'Entity' FROM part),
c AS (SELECT a AS t, a AS reached FROM arcs UNION SELECT 'Entity', 'Entity' UNION SELECT c.t, b FROM c JOIN arcs ON a = c.reached)"""


@query(f"WITH RECURSIVE {_PART_ARCS} SELECT t AS type_id, reached FROM c", graph=False)
def type_closure(spark, d):
    """Every part's type requires that of half its number, so closures are chains of brands and kinds too."""
    return typed.closure(_part_types(spark, d))


@query(f"WITH RECURSIVE {_PART_ARCS} SELECT t AS type_id, CAST(count(*) FILTER (WHERE reached LIKE 'Part-%' OR reached LIKE 'Kind %') AS INT) AS n FROM c GROUP BY t", graph=False)
def effective_types(spark, d):
    return typed.effective(_part_types(spark, d)).select("type_id", F.size("attributes").alias("n"))


@query("SELECT 'Part-' || p_partkey AS id, 'Invalid' AS code, 'the value is no Int64: Price' AS message FROM part", graph=False)
def typed_scalar_violations(spark, d):
    types, el, _ = _typed(spark, d)
    return typed.scalar_violations(types, el)


@query(
    "SELECT rel.id, 'Invalid' AS code, 'a participant repeats: ' || p AS message FROM rel WHERE l_linenumber = 7 UNION ALL SELECT id, 'Invalid', 'wrong number of participants: Part' FROM rel WHERE l_linenumber = 7",
    graph=False, lines=True
)
def typed_cardinality_violations(spark, d):
    types, el, rel = _typed(spark, d)
    twice = F.when(
        F.split(F.col("id"), "-")[4] == "7", F.transform_values("members", lambda k, v: F.when(k == "Part", F.concat(v, v)).otherwise(v))
    ).otherwise(F.col("members"))
    return typed.relation_violations(types, stored(el.unionByName(rel.withColumn("members", twice))))


@query("SELECT id, 'Invalid' AS code, 'no such participant: ' || p AS message FROM rel WHERE l_partkey % 5 = 0", graph=False, lines=True)
def typed_dangling(spark, d):
    types, el, rel = _typed(spark, d)
    kept = el.where("not (startswith(id, 'Part-') and cast(split(id, '-')[1] as int) % 5 = 0)")
    return typed.relation_violations(types, stored(kept.unionByName(rel))).where("message like 'no such participant%'")


@query("SELECT id FROM rel WHERE p = 'Part-1'", graph=False, lines=True)
def incident_relations(spark, d):
    return typed.incident_relations(_typed(spark, d)[2], ["Part-1"]).select("id")


@query("WITH one AS (SELECT o, p, s FROM rel ORDER BY o, p, s LIMIT 1) SELECT id FROM rel JOIN one USING (o, p, s)", graph=False, lines=True)
def participant_set_match(spark, d):
    rel = _typed(spark, d)[2]
    one = rel.select("members").orderBy("members.Order", "members.Part", "members.Supplier").first()["members"]
    return typed.same_participants(rel, [x for v in one.values() for x in v])


@query("SELECT id, role, participant FROM (SELECT id, unnest(['Order', 'Part', 'Supplier']) AS role, unnest([o, p, s]) AS participant FROM rel)", graph=False, lines=True)
def participants_exploded(spark, d):
    return typed.participants(_typed(spark, d)[2]).select(F.col("rel").alias("id"), "role", "participant")


@query(
    """SELECT 'ORDER-' || o_orderkey AS id, 'Conflict' AS code, 'the id is taken' AS message FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 'PART', 'Conflict', 'the id is taken'""",
    graph=False
)
def id_collisions(spark, d):
    """Each finished order once more in capitals, and an element with a type's name."""
    types, el, _ = _typed(spark, d)
    twin = el.where("startswith(id, 'Order-') and attributes['Status'] = 'F'").withColumn("id", F.upper("id"))
    named = el.where("id = 'Part-1'").withColumn("id", F.lit("PART"))
    return typed.id_collisions(types, el.unionByName(twin).unionByName(named))


@query("""SELECT 'Buyer-' || c_custkey AS id, 'Instance' AS kind, 'Entity,Supplier' AS type_ids, c_acctbal AS balance FROM customer""", graph=False)
def typed_create_instances(spark, d):
    """Customers as new instances; the closure of the type they name is stored."""
    types, el, _ = _typed(spark, d)
    c = spark.read.parquet(f"{d}/customer.parquet")
    rows = c.select(
        F.concat(F.lit("Buyer-"), F.col("c_custkey").cast("string")).alias("id"), F.array(F.lit("Supplier")).alias("type_ids"),
        F.create_map(F.lit("Balance"), F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("attributes")
    )
    after = typed.TypedGraph(types, el).create_instances(rows).elements.where("startswith(id, 'Buyer-')")
    return after.select("id", "kind", F.array_join("type_ids", ",").alias("type_ids"), F.element_at("attributes", "Balance").cast("double").alias("balance"))


@query(
    """SELECT 'New-' || id AS id, r AS role, p AS participant FROM (SELECT id, unnest(['Order', 'Part', 'Supplier']) AS r, unnest([o, p, s]) AS p FROM rel WHERE l_linenumber = 1)""",
    graph=False, lines=True
)
def typed_create_relations(spark, d):
    types, el, rel = _typed(spark, d)
    rows = rel.where("split(id, '-')[4] = '1'").select(F.concat(F.lit("New-"), F.col("id")).alias("id"), "type_ids", "attributes", "members")
    after = typed.TypedGraph(types, el).create_relations(rows)
    return typed.participants(after.elements).select(F.col("rel").alias("id"), "role", "participant")


@query(
    """SELECT 'Order-' || o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN '1.00' ELSE CAST(CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) AS VARCHAR) END AS price, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderstatus END AS status FROM orders""",
    graph=False
)
def typed_replace_attributes(spark, d):
    """Finished orders keep a price alone: whole maps are replaced."""
    types, el, _ = _typed(spark, d)
    rows = el.where("attributes['Status'] = 'F'").select("id", F.create_map(F.lit("Price"), F.lit("1.00")).alias("attributes"))
    after = typed.TypedGraph(types, el).replace_attributes(rows).elements.where("startswith(id, 'Order-')")
    get = lambda k: F.try_element_at("attributes", F.lit(k))
    return after.select("id", get("Price").alias("price"), get("Status").alias("status"))


@query("""SELECT o AS id, 'Conflict' AS code, 'takes part in ' || id AS message FROM rel WHERE o IN ('Order-1', 'Order-2') UNION ALL SELECT p, 'Conflict', 'takes part in ' || id FROM rel WHERE p = 'Part-3'
UNION ALL SELECT 'Order-1', 'Conflict', 'refused'""", graph=False, lines=True)
def typed_delete_refused(spark, d):
    """What holds two orders and a part; the change itself is refused for it, which is the last row."""
    types, el, rel = _typed(spark, d)
    store = typed.TypedGraph(types, el.unionByName(rel))
    refused = []
    try:
        store.delete(["Order-1"])
    except typed.ContractError as e:
        refused = [("Order-1", e.code, "refused")]
    return store.held(["Order-1", "Order-2", "Part-3"]).unionByName(spark.createDataFrame(refused, "id string, code string, message string"))


@query("""SELECT id FROM rel WHERE o <> 'Order-1' UNION ALL SELECT 'Order-' || o_orderkey FROM orders WHERE o_orderkey <> 1
UNION ALL SELECT 'Part-' || p_partkey FROM part UNION ALL SELECT 'Supplier-' || s_suppkey FROM supplier""", graph=False, lines=True)
def typed_delete_restricted(spark, d):
    """With the relations that hold it, an order goes."""
    types, el, rel = _typed(spark, d)
    store = typed.TypedGraph(types, el.unionByName(rel))
    held = [r["id"] for r in store.incident(["Order-1"]).select("id").collect()]  # the lines of one order
    return store.delete([*held, "Order-1"]).elements.select("id")


# Message passing: integer features, so that sums are exact.


def _mp(spark, d):
    g = tpch_graph(spark, d)
    keep = g.nodes.where("attrs['kind'] in ('order', 'part')")
    n = keep.select(
        F.col("gid").alias("key"), F.array(F.element_at("attrs", "kind")).alias("type_keys"),
        F.array(
            F.when(F.element_at("attrs", "kind") == "part", F.try_element_at("attrs", F.lit("size")).cast("float")).otherwise(1.0),
            F.lit(2.0)
        ).cast("array<float>").alias("x")
    )
    li = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_partkey", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    r = li.select(
        F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), "l_returnflag").alias("key"),
        F.col("l_returnflag").alias("type_key"), F.concat(F.lit("Part-"), F.col("l_partkey").cast("string")).alias("src"),
        F.concat(F.lit("Order-"), F.col("l_orderkey").cast("string")).alias("dst"), F.col("q").cast("float").alias("w")
    )
    return g, n, r


_MP = """WITH n AS (SELECT gid AS key, CASE WHEN kind = 'part' THEN CAST(psize AS DOUBLE) ELSE 1.0 END AS x0, 2.0 AS x1 FROM nodes WHERE kind IN ('order', 'part')),
r AS (SELECT l_orderkey || '/' || l_partkey || '/' || l_returnflag AS key, l_returnflag AS t, 'Part-' || l_partkey AS src, 'Order-' || l_orderkey AS dst, sum(l_quantity) AS w FROM lineitem GROUP BY ALL),
ix AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS idx FROM n)"""


_RELU = """ SELECT n.key, greatest(0.0, coalesce(sum(CASE t WHEN 'A' THEN w * (s.x0 - s.x1) WHEN 'N' THEN w * s.x0 ELSE -w * s.x1 END), 0) + n.x0 - 50) AS y0 FROM n LEFT JOIN r ON r.dst = n.key LEFT JOIN n s ON s.key = r.src GROUP BY n.key, n.x0"""
_RELU_LAYER = mp.Layer(2, 1, {"A": [[1], [-1]], "N": [[1], [0]], "R": [[0], [-1]]}, [[1], [0]], [-50], "ReLU")


@query(_MP + _RELU)
def mp_layer_relu(spark, d):
    _, n, r = _mp(spark, d)
    return mp.apply_layer(n, r, _RELU_LAYER).select("key", F.get("y", F.lit(0)).cast("double").alias("y0"))


@query(_MP + _RELU)
def mp_strict_order(spark, d):
    _, n, r = _mp(spark, d)
    return mp.strict_layer(n, r, _RELU_LAYER).select("key", F.get("y", F.lit(0)).cast("double").alias("y0"))


@query(_MP + _RELU)
def mp_chunked_equals_whole(spark, d):
    _, n, r = _mp(spark, d)
    return mp.apply_chunked(n, r, _RELU_LAYER, 1000).select("key", F.get("y", F.lit(0)).cast("double").alias("y0"))


@query(
    _MP + """ SELECT n.key, coalesce(sum(w * s.x0) FILTER (t = 'A'), 0) * 2 + coalesce(sum(w * s.x1) FILTER (t <> 'A'), 0) AS y0, coalesce(sum(w * s.x0), 0) AS y1 FROM n LEFT JOIN r ON r.dst = n.key LEFT JOIN n s ON s.key = r.src GROUP BY n.key"""
)
def mp_layer_multi_rel(spark, d):
    _, n, r = _mp(spark, d)
    layer = mp.Layer(2, 2, {"A": [[2, 1], [0, 0]], "N": [[0, 1], [1, 0]], "R": [[0, 1], [1, 0]]})
    return mp.apply_layer(n, r, layer).select("key", F.get("y", F.lit(0)).cast("double").alias("y0"), F.get("y", F.lit(1)).cast("double").alias("y1"))


@query(
    """WITH r AS (SELECT l_orderkey, l_partkey, l_returnflag AS t, CAST(CAST(min(l_discount) + 0.001 AS FLOAT) AS DOUBLE) AS w FROM lineitem GROUP BY ALL)
SELECT 'Order-' || l_orderkey AS dst, t AS type_key, round(sum(w * CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE)), 6) AS total FROM r JOIN part ON p_partkey = l_partkey GROUP BY ALL""", graph=False
)
def mp_exact_messages(spark, d):
    """Prices weighted by discounts, real numbers both, summed up per order and flag without regard to any order."""
    n = spark.read.parquet(f"{d}/part.parquet").select(
        F.concat(F.lit("Part-"), F.col("p_partkey").cast("string")).alias("key"), F.array(F.lit("part")).alias("type_keys"), F.array(F.col("p_retailprice").cast("float")).alias("x")
    )
    li = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_orderkey", "l_partkey", "l_returnflag").agg((F.min("l_discount") + F.lit(0.001)).cast("float").alias("w"))
    r = li.select(
        F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), "l_returnflag").alias("key"), F.col("l_returnflag").alias("type_key"),
        F.concat(F.lit("Part-"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("Order-"), F.col("l_orderkey").cast("string")).alias("dst"), "w"
    )
    return mp.exact_messages(n, r, 1).select("dst", "type_key", F.round(F.get("sums", F.lit(0)), 6).alias("total"))


@query(
    _MP + " SELECT x.t AS type_key, ix.idx AS row, CAST(sum(coalesce(k.n, 0)) OVER (PARTITION BY x.t ORDER BY idx) - coalesce(k.n, 0) AS BIGINT) AS start, CAST(sum(coalesce(k.n, 0)) OVER (PARTITION BY x.t ORDER BY idx) AS BIGINT) AS \"end\" FROM (SELECT DISTINCT t FROM r) x CROSS JOIN ix LEFT JOIN (SELECT t, dst, count(*) AS n FROM r GROUP BY ALL) k ON k.t = x.t AND k.dst = ix.key"
)
def mp_csr_offsets(spark, d):
    _, n, r = _mp(spark, d)
    return mp.csr_offsets(n, r)


@query(
    _MP + " SELECT r.t AS type_key, a.idx AS row, b.idx AS col, w, r.key, row_number() OVER (PARTITION BY r.t, a.idx ORDER BY b.idx, r.key) - 1 AS pos FROM r JOIN ix a ON a.key = dst JOIN ix b ON b.key = src"
)
def mp_csr_entries(spark, d):
    _, n, r = _mp(spark, d)
    return mp.csr_entries(n, r).select("type_key", "row", "col", F.col("w").cast("double").alias("w"), "key", F.col("pos").cast("long").alias("pos"))


@query(
    _MP + ", c AS (SELECT idx // 1000 AS chunk, key FROM ix), h AS (SELECT DISTINCT c.chunk, r.src AS key FROM r JOIN c ON c.key = r.dst EXCEPT SELECT chunk, key FROM c) SELECT chunk, key, TRUE AS is_core FROM c UNION ALL SELECT chunk, key, FALSE FROM h"
)
def mp_chunks_halo(spark, d):
    _, n, r = _mp(spark, d)
    return mp.chunks(n, r, 1000)


@query(
    _MP + """ SELECT ix.idx // 1000 AS chunk, row_number() OVER (PARTITION BY ix.idx // 1000 ORDER BY t, dst, src, r.key) - 1 AS pos, t AS type_key, dst, src, r.key
FROM r JOIN ix ON ix.key = dst"""
)
def mp_chunk_relations(spark, d):
    _, n, r = _mp(spark, d)
    return mp.chunk_relations(n, r, 1000).drop("w")


@query("""WITH e AS (SELECT a_gid, b_gid, row_number() OVER (ORDER BY a_gid, b_gid) - 1 AS i FROM edges WHERE a_gid NOT LIKE 'Part-%' AND b_gid NOT LIKE 'Part-%')
SELECT 'edge/' || i || '/forward' AS key, a_gid AS src, b_gid AS dst, CAST(1.0 AS DOUBLE) AS w FROM e UNION ALL SELECT 'edge/' || i || '/reverse', b_gid, a_gid, CAST(1.0 AS DOUBLE) FROM e""")
def mp_lower_raw(spark, d):
    g = tpch_graph(spark, d)
    n = g.nodes.where("attrs['kind'] <> 'part'").select(F.col("gid").alias("key"))
    return mp.lower_edges(n, g.edges, "edge").select("key", "src", "dst", F.col("w").cast("double").alias("w"))


@query(
    "SELECT 'snapshot.relation.source.missing' AS code, l_orderkey || '/' || l_partkey || '/' || l_returnflag AS message FROM (SELECT DISTINCT l_orderkey, l_partkey, l_returnflag FROM lineitem WHERE l_partkey % 10 = 0) UNION ALL SELECT 'spec.relation_transform.missing', 'R'",
    graph=False
)
def mp_diagnostics(spark, d):
    _, n, r = _mp(spark, d)
    n = n.where("not (key like 'Part-%' and cast(split(key, '-')[1] as int) % 10 = 0)")
    return mp.diagnostics(n, r, mp.Layer(2, 1, {"A": [[1], [0]], "N": [[1], [0]]}))


@query("""WITH v AS (SELECT vec_id, [round(x * 1000) for x in embedding] AS v FROM embeddings), y AS (SELECT vec_id, CAST(list_sum(v) AS BIGINT) AS own, CAST(v[1] AS BIGINT) AS first FROM v)
SELECT a.vec_id, a.own + coalesce(2 * b.first, 0) AS y0 FROM y a LEFT JOIN y b ON b.vec_id = a.vec_id - 1""", graph=False)
def mp_embeddings_self_transform(spark, d):
    """Each vector gets its own sum, and twice the first number of the vector before it."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    n = e.select(
        F.col("vec_id").cast("string").alias("key"), F.array(F.lit("v")).alias("type_keys"),
        F.transform("embedding", lambda x: F.round(x * F.lit(1000.0).cast("float"))).alias("x")
    )
    follows = e.select((F.col("vec_id") + 1).alias("next"), "vec_id").join(e.select(F.col("vec_id").alias("next")), "next", "left_semi")
    r = follows.select(
        F.concat(F.lit("r"), F.col("next").cast("string")).alias("key"), F.lit("next").alias("type_key"),
        F.col("vec_id").cast("string").alias("src"), F.col("next").cast("string").alias("dst"), F.lit(2.0).cast("float").alias("w")
    )
    y = mp.apply_layer(n, r, mp.Layer(64, 1, {"next": [[1.0]] + [[0.0]] * 63}, [[1.0]] * 64))
    return y.select(F.col("key").cast("long").alias("vec_id"), F.get("y", F.lit(0)).cast("long").alias("y0"))


# The semantic layer.


def _semantic(spark, d):
    """Kinds as types: Party is required by Customer and Supplier; a customer must have an order beside it."""
    g = tpch_graph(spark, d)
    slot = [("orders", ["NodeTypes/Order"], 1, None)]
    t = spark.createDataFrame(
        [
            ("NodeTypes/Party", "Node", False, [], [], []), ("NodeTypes/Customer", "Node", False, ["NodeTypes/Party"], [], slot),
            ("NodeTypes/Supplier", "Node", False, ["NodeTypes/Party"], [], []), ("NodeTypes/Order", "Node", False, [], [], [])
        ],
        semantic.TYPES
    )
    kind = F.initcap(F.element_at("attrs", "kind"))
    w = g.nodes.where("attrs['kind'] in ('customer', 'supplier', 'order')").select(F.col("gid").alias("node_gid"), F.concat(F.lit("NodeTypes/"), kind).alias("type_gid"))
    return g, t, w.withColumn("witness_gid", F.lit(None).cast("string"))


@query("SELECT gid AS node_gid, 'NodeTypes/Party' AS type_gid FROM nodes WHERE kind IN ('customer', 'supplier')")
def semantic_missing_facets(spark, d):
    _, t, f = _semantic(spark, d)
    return semantic.missing_facets(t, f)


@query("""SELECT gid AS node_gid FROM nodes WHERE kind IN ('customer', 'supplier') """)
def semantic_unsatisfied(spark, d):
    """Nodes that lack a required facet; orders lack nothing."""
    g, t, f = _semantic(spark, d)
    return semantic.unsatisfied(g, t, f)


@query("""SELECT 'NodeTypes/Van-' || p_partkey AS type_gid, 'load' AS name FROM part WHERE p_partkey % 3 > 0 AND (p_partkey % 3 = 1 OR p_size % 2 = 0)""", graph=False)
def semantic_ambiguous_slots(spark, d):
    """A van requires a car and a lorry made for the same part; a car holds anything, or boxes, or boxes of another size."""
    p = spark.read.parquet(f"{d}/part.parquet")
    k, shape = F.col("p_partkey").cast("string"), spark.createDataFrame([], semantic.TYPES).schema
    slot = lambda allowed, most: F.array(F.struct(F.lit("load").alias("name"), allowed.alias("allowed"), F.lit(0).alias("min"), F.lit(most).alias("max"))).cast(shape["slots"].dataType)
    box = F.array(F.concat(F.lit("NodeTypes/Box-"), (F.col("p_size") % 2).cast("string")))
    car = F.when(F.col("p_partkey") % 3 == 1, F.array().cast("array<string>")).when(F.col("p_partkey") % 3 == 2, box).otherwise(F.array(F.lit("NodeTypes/Box-9")))
    none, empty = F.array().cast(shape["slots"].dataType), F.array().cast("array<string>")
    row = lambda name, required, slots: p.select(
        F.concat(F.lit(f"NodeTypes/{name}-"), k).alias("type_gid"), F.lit("Node").alias("element_kind"), F.lit(False).alias("is_abstract"), required.alias("required"),
        F.array().cast(shape["fields"].dataType).alias("fields"), slots.alias("slots")
    )
    both_of = F.array(F.concat(F.lit("NodeTypes/Car-"), k), F.concat(F.lit("NodeTypes/Lorry-"), k))
    return semantic.ambiguous_slots(row("Van", both_of, none).unionByName(row("Car", empty, slot(car, 2))).unionByName(row("Lorry", empty, slot(F.array(F.lit("NodeTypes/Box-0")), 9))))


@query(
    """SELECT gid AS node_gid, 'NodeTypes/Customer' AS type_gid, 'orders' AS slot, count(o_orderkey) AS n FROM cust LEFT JOIN orders ON o_custkey = c_custkey GROUP BY gid HAVING n < 8 OR n > 12"""
)
def semantic_slot_violations(spark, d):
    """A customer has eight to twelve orders."""
    g, t, f = _semantic(spark, d)
    few = F.transform("slots", lambda x: F.struct(x["name"].alias("name"), x["allowed"].alias("allowed"), F.lit(8).alias("min"), F.lit(12).alias("max")))
    return semantic.slot_violations(g, t.withColumn("slots", few), f)


@query(
    """SELECT gid AS node_gid, 'NodeTypes/' || t AS type_gid, 'instance-of-' || lower(t) || '-for-' || lower(regexp_replace(split_part(gid, '/', -1), '(.)([A-Z])', '\\1-\\2', 'g')) AS witness_gid FROM nodes, (VALUES ('Supplier'), ('Party')) v(t) WHERE kind = 'supplier'"""
)
def semantic_assign(spark, d):
    g, t, f = _semantic(spark, d)
    f = f.where("type_gid = 'NodeTypes/Order'")
    rows = g.nodes.where("attrs['kind'] = 'supplier'").select(F.col("gid").alias("node_gid"), F.lit("NodeTypes/Supplier").alias("type_gid"))
    return semantic.assign(g, t, f, rows).where("type_gid <> 'NodeTypes/Order'")


@query("""SELECT gid AS node_gid, 'NodeTypes/' || upper(kind[1]) || kind[2:] AS type_gid, 'w/' || gid AS witness_gid FROM nodes WHERE kind IN ('customer', 'supplier', 'order')
UNION ALL SELECT gid, 'NodeTypes/Party', 'p/' || gid FROM nodes WHERE kind IN ('customer', 'supplier')
UNION ALL SELECT DISTINCT 'Order-' || l_orderkey, t, CAST(NULL AS VARCHAR) FROM lineitem, (VALUES ('NodeTypes/Supplier'), ('NodeTypes/Party')) v(t) WHERE l_partkey = 1""")
def semantic_projection(spark, d):
    """Witnessed facets, and those that links between some orders and two types stand for."""
    g, t, f = _semantic(spark, d)
    order = spark.read.parquet(f"{d}/lineitem.parquet").where("l_partkey = 1").select(F.concat(F.lit("Order-"), F.col("l_orderkey").cast("string")).alias("b_gid")).distinct()
    linked = order.select(F.explode(F.array(F.lit("NodeTypes/Supplier"), F.lit("NodeTypes/Party"))).alias("a_gid"), "b_gid")
    own = f.withColumn("witness_gid", F.concat(F.lit("w/"), "node_gid"))
    party = f.where("type_gid <> 'NodeTypes/Order'").select("node_gid", F.lit("NodeTypes/Party").alias("type_gid"), F.concat(F.lit("p/"), "node_gid").alias("witness_gid"))
    return semantic.project(PropertyGraph(g.base, g.links.unionByName(linked)), t, own.unionByName(party))


@query("SELECT gid AS node_gid FROM nodes WHERE kind IN ('customer', 'order')")
def semantic_has_any_type(spark, d):
    return semantic.has_any_type(_semantic(spark, d)[2], ["NodeTypes/Customer", "NodeTypes/Order"])


@query(f"""WITH RECURSIVE {_PART_ARCS} SELECT DISTINCT reached AS type_gid FROM c WHERE t IN (SELECT 'Part-' || p_partkey FROM part WHERE p_partkey % 100 = 0)""", graph=False)
def type_catalog(spark, d):
    """The types of every hundredth part, and all that they refer to."""
    t = _part_types(spark, d)
    shape = spark.createDataFrame([], semantic.TYPES).schema
    types = t.select(
        F.col("type_id").alias("type_gid"), F.lit("Node").alias("element_kind"), "is_abstract", F.col("required_type_ids").alias("required"),
        F.array().cast(shape["fields"].dataType).alias("fields"), F.array().cast(shape["slots"].dataType).alias("slots")
    )
    top = spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 100 = 0").select(F.concat(F.lit("Part-"), F.col("p_partkey").cast("string")).alias("t"))
    return semantic.catalog(types, top).select("type_gid")


def _edges(spark, d):
    types, _, rel = _typed(spark, d)
    fields = [(r, "Node", None, 1, 1, False, None) for r in ("Order", "Part", "Supplier")]
    t = spark.createDataFrame([("NodeTypes/Line", "Edge", False, [], fields, [])], semantic.TYPES)
    rel = stored(rel.select("id", "kind", "attributes", "members"))  # numbered once; relations, members and roles each read it
    r = rel.select(F.col("id").alias("rel_gid"), F.lit("NodeTypes/Line").alias("type_gid"), F.col("attributes").alias("attrs"))
    m = typed.participants(rel).select(F.col("rel").alias("rel_gid"), "role", F.col("participant").alias("participant_gid"))
    return t, semantic.Edges(r, m)


@query("SELECT id AS rel_gid, unnest(['Order', 'Part', 'Supplier']) AS role, unnest([o, p, s]) AS participant_gid FROM rel WHERE p <> 'Part-1' AND s <> 'Supplier-2'", graph=False, lines=True)
def semantic_cascade_delete(spark, d):
    """The members of all relations that are left when a part and a supplier go."""
    _, e = _edges(spark, d)
    g = PropertyGraph.of(spark, ["Part-1", "Supplier-2"])
    _, left = semantic.delete_nodes(g, e, ["Part-1", "Supplier-2"])
    return left.members.join(left.relations.select("rel_gid"), "rel_gid", "left_semi").select("rel_gid", "role", "participant_gid")


@query("""WITH p AS (SELECT min(b_gid) AS p FROM links WHERE a_gid = 'Order-1' AND b_gid LIKE 'Part-%')
SELECT 'link' AS what, a_gid AS a, b_gid AS b FROM links WHERE NOT (a_gid = 'Order-1' AND b_gid = (SELECT p FROM p)) UNION ALL SELECT 'Order', 'Holds-1', 'Order-1' UNION ALL SELECT 'Part', 'Holds-1', p FROM p""")
def semantic_change_edge_type(spark, d):
    """A raw edge becomes a typed relation, and the link goes."""
    g = tpch_graph(spark, d)
    part = g.neighbours_of("Order-1").where("dst like 'Part-%'").agg(F.min("dst")).first()[0]
    t = spark.createDataFrame([("NodeTypes/Holds", "Edge", False, [], [(r, "Node", None, 1, 1, False, None) for r in ("Order", "Part")], [])], semantic.TYPES)
    none = semantic.Edges(spark.createDataFrame([], semantic.RELATIONS), spark.createDataFrame([], semantic.MEMBERS))
    after, edges = semantic.change_edge_type(g, t, spark.createDataFrame([], semantic.FACETS), none, "NodeTypes/Holds", {"Order": ["Order-1"], "Part": [part]}, "Holds-1")
    links = after.links.select(F.lit("link").alias("what"), F.col("a_gid").alias("a"), F.col("b_gid").alias("b"))
    return links.unionByName(edges.members.select(F.col("role").alias("what"), F.col("rel_gid").alias("a"), F.col("participant_gid").alias("b")))


@query("SELECT id AS rel_gid, unnest(['Order', 'Part', 'Supplier']) AS role, unnest([o, p, s]) AS participant_gid FROM rel", graph=False, lines=True)
def reified_round_trip(spark, d):
    t, e = _edges(spark, d)
    nodes, links = semantic.export_reified(e)
    ends = e.members.select(F.col("participant_gid").alias("gid")).distinct().unionByName(t.select(F.col("type_gid").alias("gid")))
    none = F.create_map().cast("map<string,string>")
    return semantic.import_reified(PropertyGraph(nodes.unionByName(ends.select("gid", none.alias("attrs"))), links), t).members


def _kept(spark, d):
    """Line items as a store keeps them: (types, nodes, links)."""
    t, e = _edges(spark, d)
    nodes, links = carrier.written(t, e)
    ends = e.members.select(F.col("participant_gid").alias("gid")).distinct().unionByName(t.select(F.col("type_gid").alias("gid")))
    return t, nodes.unionByName(ends.withColumn("attrs", F.create_map().cast("map<string,string>"))), links


@query("SELECT id AS rel_gid, unnest(['Order', 'Part', 'Supplier']) AS role, unnest([o, p, s]) AS participant_gid FROM rel", graph=False, lines=True)
def carrier_round_trip(spark, d):
    t, nodes, links = _kept(spark, d)
    return carrier.read(PropertyGraph(stored(nodes), stored(links)), t).members


@query("""WITH k AS (SELECT *, id || '/member-' || id || '-2' AS role FROM rel WHERE l_suppkey % 9 <> 0)
SELECT id, 'Corrupt' AS code, 'there are roles but no type' AS message FROM rel WHERE l_suppkey % 9 = 0
UNION ALL SELECT id, 'Unsupported', 'a child stands for no role: extra' FROM k WHERE l_partkey % 5 = 1 UNION ALL SELECT id || '/extra', 'Unsupported', 'an element is a child of a relation' FROM k WHERE l_partkey % 5 = 1
UNION ALL SELECT role, 'Unsupported', 'a role has attributes' FROM k WHERE l_partkey % 7 = 0 UNION ALL SELECT role, 'Unsupported', 'a role has a child: below' FROM k WHERE l_partkey % 11 = 0
UNION ALL SELECT id, 'Unsupported', 'the relation is linked beside its roles: ' || o FROM k WHERE l_partkey % 13 = 0""", graph=False, lines=True)
def carrier_violations(spark, d):
    """Line items in a store with faults: types taken off, children and attributes too many, links beside the roles."""
    t, nodes, links = _kept(spark, d)
    nodes = stored(nodes)  # with its faults the store is read many times
    none = F.create_map().cast("map<string,string>")
    rel = nodes.where("gid like 'Line-%' and gid not like '%/%'").select(F.col("gid").alias("rel_gid"))
    part, supplier = F.split("rel_gid", "-")[2].cast("int"), F.split("rel_gid", "-")[3].cast("int")
    role = F.concat("rel_gid", F.lit("/member-"), "rel_gid", F.lit("-2"))
    noted = rel.where(part % 7 == 0).select(role.alias("gid"), F.lit(True).alias("noted"))
    nodes = nodes.join(noted, "gid", "left").select("gid", F.when(F.col("noted"), F.create_map(F.lit("note"), F.lit("x"))).otherwise(F.col("attrs")).alias("attrs"))
    extra = rel.where(part % 5 == 1).select(F.concat("rel_gid", F.lit("/extra")).alias("gid"), none.alias("attrs"))
    below = rel.where(part % 11 == 0).select(F.concat(role, F.lit("/below")).alias("gid"), none.alias("attrs"))
    untyped = rel.where(supplier % 9 == 0).select(F.col("rel_gid").alias("a_gid"), F.lit("NodeTypes/Line").alias("b_gid"))
    beside = rel.where(part % 13 == 0).select(F.col("rel_gid").alias("a_gid"), F.concat(F.lit("Order-"), F.split("rel_gid", "-")[1]).alias("b_gid"))
    links = links.join(untyped, ["a_gid", "b_gid"], "left_anti").unionByName(beside)
    g = PropertyGraph(stored(nodes.unionByName(extra).unionByName(below)), stored(links))
    facets = extra.select(F.col("gid").alias("node_gid"), F.lit("NodeTypes/Thing").alias("type_gid"), F.lit(None).cast("string").alias("witness_gid"))
    return carrier.unsupported_elements(g, t, facets, external=True)


@query("""WITH m AS (SELECT id, unnest(['Order', 'Part', 'Supplier']) AS role, unnest([o, p, s]) AS who FROM rel), k AS (SELECT id, who, row_number() OVER (PARTITION BY id ORDER BY sha256('NodeTypes/Line' || chr(0) || role)[1:16]) AS n FROM m)
SELECT id AS rel_gid, 'NodeTypes/Line' AS type_gid, max(who) FILTER (n = 1) AS a_gid, max(who) FILTER (n = 2) AS b_gid FROM k GROUP BY id""", graph=False, lines=True)
def view_relations(spark, d):
    """Relations that a view finds in their reified form; without source and target roles the ports count in the order of their names."""
    t, e = _edges(spark, d)
    nodes, links = semantic.export_reified(e)
    ends = e.members.select(F.col("participant_gid").alias("gid")).distinct().unionByName(t.select(F.col("type_gid").alias("gid")))
    g = PropertyGraph(nodes.unionByName(ends.select("gid", F.create_map().cast("map<string,string>").alias("attrs"))), links)
    basis = spark.createDataFrame([("NodeTypes/Line", "Edge", "Line", None, True, False, [])], view.BASIS)
    return view.relations(g.nodes, g.edges, basis).select("rel_gid", "type_gid", "a_gid", "b_gid")


def _edge_types(spark, d):
    """An edge type for each part: its roles are its brand and its kind, and a third that all have; every fourth has one role and is none."""
    p = spark.read.parquet(f"{d}/part.parquet")
    shape = spark.createDataFrame([], semantic.TYPES).schema
    role = lambda name, least, most: F.struct(
        name.alias("name"), F.lit("Node").alias("value_kind"), F.lit(None).cast("string").alias("data_type"), least.cast("int").alias("min"), most.cast("int").alias("max"),
        F.lit(False).alias("is_collection"), F.lit(None).cast("string").alias("node_type")
    )
    brand, size = F.replace("p_brand", F.lit("#"), F.lit("-")), F.col("p_size")
    every = F.array(role(brand, F.lit(0), size), role(F.col("p_type"), F.lit(1), F.lit(1)), role(F.lit("Witness"), F.lit(0), F.lit(None)))
    fields = F.when(F.col("p_partkey") % 4 == 0, F.slice(every, 1, 1)).otherwise(every)
    return p.select(
        F.concat(F.lit("NodeTypes/Edge-"), F.col("p_partkey").cast("string")).alias("type_gid"), F.lit("Edge").alias("element_kind"), (F.col("p_partkey") % 2 == 0).alias("is_abstract"),
        F.array().cast("array<string>").alias("required"), fields.cast(shape["fields"].dataType).alias("fields"), F.array().cast(shape["slots"].dataType).alias("slots")
    )


_EDGE_TYPES = """f AS (SELECT p_partkey AS k, 'NodeTypes/Edge-' || p_partkey AS t, replace(p_brand, '#', '-') AS r, 0 AS lo, p_size AS hi FROM part
  UNION ALL SELECT p_partkey, 'NodeTypes/Edge-' || p_partkey, p_type, 1, 1 FROM part WHERE p_partkey % 4 > 0 UNION ALL SELECT p_partkey, 'NodeTypes/Edge-' || p_partkey, 'Witness', 0, NULL FROM part WHERE p_partkey % 4 > 0)"""


@query(f"WITH {_EDGE_TYPES} SELECT t AS type_gid, r AS role, 'member-' || sha256(t || chr(0) || r)[1:16] AS member_id, CAST(lo AS INT) AS min, CAST(coalesce(hi, -1) AS INT) AS max FROM f WHERE k % 4 > 0", graph=False)
def edge_definition(spark, d):
    return semantic.edge_definition(_edge_types(spark, d)).select("type_gid", "role", "member_id", "min", F.coalesce("max", F.lit(-1)).alias("max"))


# Changes.


@query("SELECT gid FROM nodes UNION ALL SELECT 'AFRICA/Extra' UNION ALL SELECT 'AFRICA/Extra/Deep'")
def mutate_create_nodes(spark, d):
    none = F.create_map().cast("map<string,string>")
    rows = spark.createDataFrame([("AFRICA/Extra",), ("AFRICA/Extra/Deep",), ("AFRICA",)], "gid string").withColumn("attrs", none)
    return mutate.create_nodes(tpch_graph(spark, d), rows).base.select("gid")


@query("""SELECT gid, CASE WHEN kind = 'nation' THEN 'land' ELSE kind END AS kind, segment IS NOT NULL AND segment <> 'MACHINERY' AS has_segment FROM nodes""")
def mutate_update_attributes(spark, d):
    """Nations change their kind; customers of one segment lose the attribute."""
    g = tpch_graph(spark, d)
    land = g.base.where("attrs['kind'] = 'nation'").select("gid", mutate.with_attribute(F.col("attrs"), "Kind", "land").alias("attrs"))
    bare = g.base.where("attrs['segment'] = 'MACHINERY'").select("gid", mutate.without_attribute(F.col("attrs"), "Segment").alias("attrs"))
    after = mutate.update_attributes(g, land.unionByName(bare)).base
    return after.select(
        "gid", text.lookup(F.col("attrs"), "kind").alias("kind"),
        F.coalesce(text.lookup(F.col("attrs"), "segment").isNotNull(), F.lit(False)).alias("has_segment")
    )


@query("SELECT a_gid, b_gid FROM links UNION ALL SELECT 'AFRICA', 'AMERICA'")
def mutate_connect(spark, d):
    return mutate.connect(
        tpch_graph(spark, d),
        spark.createDataFrame([("AMERICA", "AFRICA"), ("AFRICA", "AFRICA"), ("AFRICA", "nowhere")], "a_gid string, b_gid string")
    ).links


@query("SELECT a_gid, b_gid FROM links WHERE NOT (a_gid = 'Order-1' AND b_gid = (SELECT max(b_gid) FROM links WHERE a_gid = 'Order-1'))")
def mutate_disconnect(spark, d):
    g = tpch_graph(spark, d)
    b = g.links.where("a_gid = 'Order-1'").agg(F.max("b_gid")).first()[0]
    return mutate.disconnect(g, b, "Order-1").links


@query("""SELECT 'node' AS what, gid AS a, CAST(NULL AS VARCHAR) AS b FROM nodes UNION ALL SELECT 'link', a_gid, b_gid FROM links
UNION ALL SELECT * FROM (VALUES ('node', 'Box', NULL), ('node', 'Order-1/Thing', NULL), ('node', 'Order-1/Thing/Deep', NULL), ('link', 'Order-1/Thing/Deep', 'Part-1'))""")
def mutate_relocate(spark, d):
    """Parted from its parent, a node moves to its one other neighbour with all below it."""
    g = tpch_graph(spark, d)
    more = PropertyGraph.of(spark, ["Box", "Box/Thing", "Box/Thing/Deep"], [("Box/Thing", "Order-1"), ("Box/Thing/Deep", "Part-1")])
    return _whole(mutate.disconnect(PropertyGraph(g.base.unionByName(more.base), g.links.unionByName(more.links)), "Box", "Box/Thing"))


@query("""SELECT a_gid, b_gid FROM links UNION ALL SELECT 'AFRICA', 'Order-1'""")
def mutate_add_neighbour(spark, d):
    return mutate.add_neighbour(tpch_graph(spark, d), "Order-1", REGION).links


@query(
    """SELECT 'node' AS what, gid AS a, CAST(NULL AS VARCHAR) AS b FROM nodes UNION ALL SELECT 'link', a_gid, b_gid FROM links WHERE a_gid <> 'Order-1' AND b_gid <> 'Order-1'"""
)
def mutate_clear_neighbours(spark, d):
    """Neighbours with others beside them are parted from the order; the one that has it alone goes."""
    g = tpch_graph(spark, d)
    lonely = spark.createDataFrame([("Lonely", {})], "gid string, attrs map<string,string>")
    g = PropertyGraph(g.base.unionByName(lonely), g.links.unionByName(spark.createDataFrame([("Lonely", "Order-1")], "a_gid string, b_gid string")))
    return _whole(mutate.clear_neighbours(g, "Order-1"))


@query("""WITH go AS (SELECT gid, CASE WHEN gid = 'AFRICA/NATION_0' OR starts_with(gid, 'AFRICA/NATION_0/') THEN 'ASIA/NATION_0' || gid[16:] ELSE gid END AS g FROM nodes)
SELECT 'node' AS what, g AS a, CAST(NULL AS VARCHAR) AS b FROM go UNION ALL SELECT 'link', least(x.g, y.g), greatest(x.g, y.g) FROM links JOIN go x ON x.gid = a_gid JOIN go y ON y.gid = b_gid""")
def mutate_move_subtree(spark, d):
    return _whole(mutate.move(tpch_graph(spark, d), NATION, "ASIA/NATION_0"))


@query("""SELECT 'link' AS what, a_gid AS a, b_gid AS b FROM links WHERE NOT starts_with(a_gid, 'AFRICA/') AND NOT starts_with(b_gid, 'AFRICA/')
UNION ALL SELECT 'node', gid, CAST(NULL AS VARCHAR) FROM nodes WHERE gid <> 'AFRICA' AND NOT starts_with(gid, 'AFRICA/')""")
def mutate_delete_subtree(spark, d):
    return _whole(mutate.delete_subtrees(tpch_graph(spark, d), [REGION]))


@query("""SELECT DISTINCT 'Part-' || l_partkey AS src, 'order-' || l_orderkey AS slot FROM lineitem WHERE l_partkey % 10 = 1""")
def slot_clashes(spark, d):
    """Some parts get links to copies of their orders, which have the orders' names in small letters."""
    g = tpch_graph(spark, d)
    twins = g.links.where("startswith(a_gid, 'Order-') and startswith(b_gid, 'Part-') and b_gid like '%1'").select(
        F.concat(F.lit("Copies/"), F.lower("a_gid")).alias("a_gid"), "b_gid"
    )
    return mutate.slot_clashes(g, twins)


# Sinks, backup, functions, statistics, streams.


@query("""SELECT * FROM (VALUES (0, '', '{"version":1,"nodes":['), (2, '', '],"edges":['), (4, '', ']}')) t(part, gid, line)
UNION ALL SELECT 1, gid, CASE WHEN gid = (SELECT min(gid) FROM nodes) THEN '' ELSE ',' END || '{"path":' || to_json(string_split(gid, '/')) || ',"attributes":{"kind":"' || kind || '"' || coalesce(',"segment":"' || segment || '"', '') || coalesce(',"brand":"' || brand || '"', '') || coalesce(',"type":"' || ptype || '"', '')
  || coalesce(',"name":"' || pname || '"', '') || coalesce(',"size":"' || psize || '"', '') || coalesce(',"status":"' || status || '"', '') || coalesce(',"priority":"' || priority || '"', '') || '}}' FROM nodes
UNION ALL SELECT 3, a_gid || chr(1) || b_gid, CASE WHEN a_gid || chr(1) || b_gid = (SELECT min(a_gid || chr(1) || b_gid) FROM links) THEN '' ELSE ',' END || '{"source":' || to_json(string_split(a_gid, '/')) || ',"target":' || to_json(string_split(b_gid, '/')) || '}' FROM links""")
def backup_document(spark, d):
    return records.backup_lines(tpch_graph(spark, d))


@query("""SELECT 'node' AS what, gid AS a, CAST(NULL AS VARCHAR) AS b FROM nodes UNION ALL SELECT 'link', a_gid, b_gid FROM links""")
def backup_round_trip(spark, d):
    """Saved and loaded again."""
    path = shared_path(spark, "backup")
    records.save_backup(tpch_graph(spark, d), path)
    return _whole(records.load_backup(spark, path))


@query("""SELECT 'node' AS what, gid AS a, kind AS b FROM nodes UNION ALL SELECT 'link', a_gid, b_gid FROM links""")
def folder_store_round_trip(spark, d):
    """Written as folders with links between them, and read back."""
    store = storage.open_storage(spark, "folders", shared_path(spark, "folders").removeprefix("file:"))
    store.save(tpch_graph(spark, d))
    back = store.load()
    nodes = back.base.select(F.lit("node").alias("what"), F.col("gid").alias("a"), F.element_at("attrs", "kind").alias("b"))
    return nodes.unionByName(back.links.select(F.lit("link").alias("what"), F.col("a_gid").alias("a"), F.col("b_gid").alias("b")))


@query("""SELECT CAST(to_json({'gid': gid, 'kind': kind}) AS VARCHAR) AS line FROM nodes""")
def ndjson_sink(spark, d):
    return sinks.ndjson(tpch_graph(spark, d).nodes.select("gid", F.element_at("attrs", "kind").alias("kind")))


@query(
    r"""SELECT gid, lower(regexp_replace(gid, '(.)([A-Z])', '\1-\2', 'g')) AS kebab, sha256(gid) || '.json' AS file, len(string_split(gid, '/')) - 1 AS n_ancestors FROM nodes WHERE kind IN ('order', 'part')"""
)
def name_functions(spark, d):
    n = tpch_graph(spark, d).nodes.where("attrs['kind'] in ('order', 'part')")
    return n.select(
        "gid", names.kebab(F.col("gid")).alias("kebab"), names.record_file(F.col("gid")).alias("file"),
        F.size(names.ancestors(F.col("gid"))).cast("long").alias("n_ancestors")
    )


@query("SELECT c_custkey, NOT contains(c_name, '#') AS raw_ok, TRUE AS clean_ok FROM customer", graph=False)
def name_grammar(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select("c_custkey", names.valid_segment(F.col("c_name")).alias("raw_ok"), names.valid_segment(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("clean_ok"))


@query(
    """SELECT o_orderkey, o_orderkey * 700000 BETWEEN -2147483648 AND 2147483647 AS int32_ok, o_orderkey % 3 <> 0 AS int64_ok, o_orderkey % 5 <> 0 AS double_ok, o_orderkey % 4 = 0 AS bool_ok, o_orderkey % 2 = 0 AS guid_ok, o_orderkey % 7 <> 0 AS time_ok FROM orders""",
    graph=False
)
def scalar_kinds(spark, d):
    """Texts that are and texts that are not what their kind asks, made from the order's key."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    ok = lambda kind, c: scalars.is_valid(F.lit(kind), c)
    k = F.col("o_orderkey")
    every = lambda n, bad, good: F.when(k % n == 0, bad).otherwise(good)
    price, hexa = F.format_string("%.2f", "o_totalprice"), F.sha2(k.cast("string"), 256)
    guid = F.concat_ws("-", F.substr(hexa, F.lit(1), F.lit(8)), *(F.substr(hexa, F.lit(9 + 4 * j), F.lit(4)) for j in range(3)), F.substr(hexa, F.lit(21), F.lit(12)))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(
        "o_orderkey", ok("Int32", (k * 700000).cast("string")).alias("int32_ok"), ok("Int64", every(3, price, k.cast("string"))).alias("int64_ok"), ok(
            "Double", every(5, F.concat(price, F.lit("x")), price)
        ).alias("double_ok"),
        ok("Boolean", every(4, F.lit("True"), F.lit("yes"))).alias("bool_ok"), ok("Guid", every(2, guid, hexa)).alias("guid_ok"), ok(
            "DateTime", every(7, day, F.concat(day, F.lit("T10:11:12.0000000Z")))
        ).alias("time_ok"),
    )


@query(
    """SELECT event_type, count(value) AS n, min(value) AS least, round(avg(value), 6) AS mean, quantile_cont(value, 0.5) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS most FROM events GROUP BY event_type""",
    graph=False
)
def measurement_statistics(spark, d):
    got = measure.statistics(spark.read.parquet(f"{d}/events.parquet"), ["event_type"], F.col("value"))
    return got.withColumn("mean", F.round("mean", 6)).withColumn("p95", F.round("p95", 6))


def _changes(spark, d):
    return _as_changes(spark.read.parquet(f"{d}/events.parquet"))


def _as_changes(events):
    return events.where("event_type in ('click', 'error')").select(
        "ts", F.when(F.col("event_type") == "click", "add").otherwise("remove").alias("op"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("a_gid"), F.get_json_object("props", "$.k").alias("b_gid")
    )


@query("""WITH c AS (SELECT ts, CASE event_type WHEN 'click' THEN 'add' ELSE 'remove' END AS op, 'u' || user_id AS a, json_extract_string(props, '$.k') AS b FROM events WHERE event_type IN ('click', 'error'))
SELECT least(a, b) AS a_gid, greatest(a, b) AS b_gid, arg_max(op, (ts, op)) AS op FROM c GROUP BY ALL""", graph=False)
def change_batches(spark, d):
    return changes.coalesced(_changes(spark, d))


@query("""WITH c AS (SELECT ts, CASE event_type WHEN 'click' THEN 'add' ELSE 'remove' END AS op, 'u' || user_id AS a, json_extract_string(props, '$.k') AS b FROM events WHERE event_type IN ('click', 'error')),
l AS (SELECT least(a, b) AS a_gid, greatest(a, b) AS b_gid, arg_max(op, (ts, op)) AS op FROM c GROUP BY ALL) SELECT a_gid, b_gid FROM l WHERE op = 'add'""", graph=False)
def changes_applied(spark, d):
    return changes.applied(spark.createDataFrame([], "a_gid string, b_gid string"), _changes(spark, d))


@query("SELECT 'Part-' || p_partkey AS id, 'Invalid' AS code, 'the value is no Int64: Price' AS message FROM part", graph=False)
def typed_integrity(spark, d):
    """Every rule for elements at once, over instances and relations."""
    types, el, rel = _typed(spark, d)
    return typed.element_violations(types, stored(el.unionByName(rel)))  # every rule reads them


@query("""SELECT 'Part/' || p_partkey || '.' AS id, 'Invalid' AS code, 'the id is no valid name' AS message FROM part WHERE p_partkey % 6 = 1
UNION ALL SELECT 'Part-' || p_partkey, 'Invalid', 'a relation type has fewer than two members' FROM part WHERE p_partkey % 6 = 2 UNION ALL SELECT 'Part-' || p_partkey, 'Invalid', 'names repeat' FROM part WHERE p_partkey % 6 = 3
UNION ALL SELECT 'Part-' || p_partkey, 'NotFound', 'requires unknown type ' || p_type FROM part WHERE p_partkey % 6 = 4 UNION ALL SELECT 'Part-' || p_partkey, 'Unsupported', 'unknown scalar kind' FROM part WHERE p_partkey % 6 = 5""", graph=False)
def type_violations(spark, d):
    """Types made from parts, five of six with a fault of their own."""
    shape = spark.createDataFrame([], typed.TYPES).schema
    k, n = F.col("p_partkey") % 6, F.col("p_partkey").cast("string")
    attribute = lambda name, kind: F.struct(name.alias("name"), F.lit(kind).alias("kind"), F.lit(False).alias("required"))
    brand = F.replace("p_brand", F.lit("#"), F.lit("-"))
    attributes = F.when(k == 3, F.array(attribute(brand, "String"), attribute(F.upper(brand), "String"))).when(k == 5, F.array(attribute(brand, "Colour"))).otherwise(F.array(attribute(brand, "Int32")))
    member = F.struct(F.lit("Only").alias("name"), F.lit(None).cast("string").alias("type_id"), F.lit(1).alias("min"), F.lit(1).alias("max"))
    types = spark.read.parquet(f"{d}/part.parquet").select(
        F.when(k == 1, F.concat(F.lit("Part/"), n, F.lit("."))).otherwise(F.concat(F.lit("Part-"), n)).alias("type_id"), F.when(k == 2, "Relation").otherwise("Instance").alias("kind"),
        F.lit(False).alias("is_abstract"), F.when(k == 4, F.array("p_type")).otherwise(F.array().cast("array<string>")).alias("required_type_ids"),
        F.when(k == 2, F.array(member)).otherwise(F.array()).cast(shape["members"].dataType).alias("members"), attributes.cast(shape["attributes"].dataType).alias("attributes")
    )
    return typed.type_violations(types)


@query("""SELECT id AS rel_gid, 'Part' AS role, 'cardinality' AS message FROM rel WHERE l_partkey % 7 = 0
UNION ALL SELECT id, 'Supplier', 'type' FROM rel WHERE l_suppkey % 2 = 1 UNION ALL SELECT id, 'Witness', 'role' FROM rel WHERE l_linenumber = 6""", graph=False, lines=True)
def semantic_endpoint_violations(spark, d):
    """Some parts are missing, every second supplier lacks its type, and some relations name a role too many."""
    t, e = _edges(spark, d)
    typed_supplier = F.transform("fields", lambda f: F.when(f["name"] == "Supplier", f.withField("node_type", F.lit("NodeTypes/Supplier"))).otherwise(f))
    left = e.members.where("not (role = 'Part' and cast(split(participant_gid, '-')[1] as int) % 7 = 0)")
    odd = e.relations.where("split(rel_gid, '-')[4] = '6'").select("rel_gid", F.lit("Witness").alias("role"), F.lit("Part-1").alias("participant_gid"))
    s = spark.read.parquet(f"{d}/supplier.parquet").where("s_suppkey % 2 = 0")
    facets = s.select(
        F.concat(F.lit("Supplier-"), F.col("s_suppkey").cast("string")).alias("node_gid"), F.lit("NodeTypes/Supplier").alias("type_gid"),
        F.lit(None).cast("string").alias("witness_gid")
    )
    return semantic.endpoint_violations(t.withColumn("fields", typed_supplier), facets, semantic.Edges(e.relations, left.unionByName(odd)))


@query(f"""WITH {_EDGE_TYPES}, h AS (SELECT DISTINCT k, t || '/Definition' AS g FROM f), a AS (
  SELECT g AS gid, unnest(['elementKind', 'isAbstract']) AS k, unnest(['Edge', CASE WHEN k % 2 = 0 THEN 'True' ELSE 'False' END]) AS v FROM h UNION ALL SELECT unnest([g || '/Fields', g || '/Slots']), NULL, NULL FROM h
  UNION ALL SELECT t || '/Definition/Fields/' || r, unnest(['valueKind', 'clrType', 'min', 'isCollection', 'max']), unnest(['Node', 'node', CAST(lo AS VARCHAR), 'False', CAST(hi AS VARCHAR)]) FROM f)
SELECT gid, k, v FROM a WHERE v IS NOT NULL OR k IS NULL""", graph=False)
def stored_definitions(spark, d):
    """A row for each attribute of the nodes that hold a definition; nodes without any have one row."""
    return definitions.stored(_edge_types(spark, d)).select("gid", F.explode_outer("attrs").alias("k", "v"))


@query(f"""WITH {_EDGE_TYPES} SELECT t AS type_gid, 'Edge' AS element_kind, k % 2 = 0 AS is_abstract, r AS field, CAST(lo AS INT) AS min, CAST(coalesce(hi, -1) AS INT) AS max FROM f""", graph=False)
def read_definitions(spark, d):
    g = PropertyGraph(definitions.stored(_edge_types(spark, d)), spark.createDataFrame([], "a_gid string, b_gid string"))
    return definitions.read(g).select("type_gid", "element_kind", "is_abstract", F.explode("fields").alias("f")).select(
        "type_gid", "element_kind", "is_abstract", F.col("f.name").alias("field"), "f.min", F.coalesce("f.max", F.lit(-1)).alias("max")
    )


@query(
    """SELECT split_part(gid, '/', 1) AS component, string_agg(gid, chr(0) ORDER BY gid) AS name FROM nodes WHERE kind IN ('region', 'nation', 'customer', 'supplier') GROUP BY 1"""
)
def component_names(spark, d):
    _, n, e = _tree(spark, d)
    return view.component_names(view.root_components(n, e).withColumnRenamed("root_component", "component"))


@query("""SELECT a.event_id, CAST(arg_max(b.event_id, (b.ts, b.event_id)) AS BIGINT) AS last_id, max(b.ts) = a.ts AS same_time
FROM events a LEFT JOIN events b ON b.user_id = a.user_id AND b.event_type = 'view' AND b.ts <= a.ts WHERE a.event_type <> 'view' GROUP BY a.event_id, a.ts HAVING count(b.event_id) > 0""", graph=False)
def asof_last_view(spark, d):
    """Every event but views with the last view of its user before it; those without any are left out."""
    e = spark.read.parquet(f"{d}/events.parquet")
    got = asof.asof(e.where("event_type <> 'view'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view")), "user_id", "ts")
    return got.where("found is not null").select("event_id", F.col("found.view").alias("last_id"), (F.col("found.ts") == F.col("ts")).alias("same_time"))


def _streamed_windows(spark, d, slide):
    """The event table as a stream, counted by windows of an hour."""
    got = changes.window_table(_event_stream(spark, d), shared_path(spark, "windows"), "1 hour", "10 minutes", slide)
    return got.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("began"), "op", "n")


@query("""WITH c AS (SELECT ts, CASE event_type WHEN 'click' THEN 'add' ELSE 'remove' END AS op FROM events WHERE event_type IN ('click', 'error'))
SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS began, op, count(*) AS n FROM c GROUP BY ALL""", graph=False)
def change_windows(spark, d):
    return _streamed_windows(spark, d, None)


@query("""WITH c AS (SELECT ts, CASE event_type WHEN 'click' THEN 'add' ELSE 'remove' END AS op FROM events WHERE event_type IN ('click', 'error'))
SELECT strftime(time_bucket(INTERVAL 20 MINUTE, ts) - INTERVAL 20 MINUTE * k, '%Y-%m-%d %H:%M:%S') AS began, op, count(*) AS n FROM c, (VALUES (0), (1), (2)) t(k) GROUP BY ALL""", graph=False)
def change_windows_sliding(spark, d):
    return _streamed_windows(spark, d, "20 minutes")


_LOG = """c AS (SELECT ts, op, least(a, b) AS a_gid, greatest(a, b) AS b_gid FROM (
  SELECT ts, CASE event_type WHEN 'click' THEN 'add' ELSE 'remove' END AS op, 'u' || user_id AS a, json_extract_string(props, '$.k') AS b FROM events WHERE event_type IN ('click', 'error'))),
m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS w FROM c)"""
_LIFE = f"""{_LOG}, g AS (SELECT a_gid, b_gid, time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE AS moment, arg_max(op, (ts, op)) AS op FROM c GROUP BY 1, 2, 3),
r AS (SELECT *, lag(op) OVER p AS was, lag(moment) OVER p AS since, lead(moment) OVER p AS next FROM g, m WHERE moment <= w WINDOW p AS (PARTITION BY a_gid, b_gid ORDER BY moment)),
l AS (SELECT *, coalesce(was = 'add' AND moment < since + INTERVAL 5 DAY, false) AS live FROM r),
moves AS (SELECT a_gid, b_gid, moment, 1 AS change, 'add' AS why FROM l WHERE op = 'add' AND NOT live
  UNION ALL SELECT a_gid, b_gid, moment, -1, 'remove' FROM l WHERE op = 'remove' AND live
  UNION ALL SELECT a_gid, b_gid, moment + INTERVAL 5 DAY, -1, 'silent' FROM l WHERE op = 'add' AND moment + INTERVAL 5 DAY <= coalesce(next, w))"""


def _event_stream(spark, d):
    """The event table's changes as a stream in order of time, however the table's files are cut and dated."""
    return _as_changes(changes.replayed(spark.read.parquet(f"{d}/events.parquet"), "ts", shared_path(spark, "log")))


def _moves(spark, d):
    """Links that live for five days after they were added last."""
    return links.table_of(links.moves(_event_stream(spark, d), 5 * 86_400, "10 minutes", "1 minute"), shared_path(spark, "moves"))


@query(f"WITH {_LIFE} SELECT a_gid, b_gid, strftime(moment, '%Y-%m-%d %H:%M:%S') AS moment, change, why FROM moves", graph=False)
def link_moves(spark, d):
    """Every beginning and end of a link, with state and timers for each pair."""
    return _moves(spark, d).withColumn("moment", F.date_format("moment", "yyyy-MM-dd HH:mm:ss"))


@query(f"""WITH {_LIFE}, e AS (SELECT a_gid AS gid, b_gid AS other, moment, change FROM moves UNION ALL SELECT b_gid, a_gid, moment, change FROM moves)
SELECT gid, CAST(sum(change) AS BIGINT) AS degree, arg_max(other, (moment, other)) FILTER (change = 1) AS last_gid, strftime(max(moment) FILTER (change = 1), '%Y-%m-%d %H:%M:%S') AS last_at FROM e GROUP BY gid""", graph=False)
def live_degree(spark, d):
    """Each node's live links and the last that began."""
    return links.live_nodes(_moves(spark, d)).withColumn("last_at", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss"))


@query(f"""WITH {_LOG}, e AS (SELECT a_gid AS gid, ts FROM c UNION ALL SELECT b_gid, ts FROM c),
g AS (SELECT gid, time_bucket(INTERVAL 1 SECOND, ts) + INTERVAL 1 SECOND AS moment, count(*) AS n, min(ts) AS t, max(ts) AS u FROM e GROUP BY 1, 2),
s AS (SELECT *, coalesce(moment >= lag(moment) OVER p + INTERVAL 12 HOUR, true) AS starts FROM g WINDOW p AS (PARTITION BY gid ORDER BY moment)),
k AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY gid ORDER BY moment) AS run FROM s)
SELECT gid, epoch_us(min(t)) AS began_us, epoch_us(max(u)) AS ended_us, CAST(sum(n) AS BIGINT) AS n FROM k, m GROUP BY gid, run, w HAVING max(moment) + INTERVAL 12 HOUR <= w""", graph=False)
def change_sessions(spark, d):
    """Runs of changes of a node with less than half a day between them."""
    got = links.table_of(links.sessions(_event_stream(spark, d), "12 hours", "10 minutes"), shared_path(spark, "sessions"))
    return got.select("gid", F.unix_micros("began").alias("began_us"), F.unix_micros("ended").alias("ended_us"), "n")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders within three steps of a part's suppliers' nation: attribute, path and negation together."""
    where = both(
        attribute("x", "kind", "order"), connected(var("x"), var("p")), attribute("p", "kind", "part"), connected(var("p"), var("s")),
        {"kind": "descendant", "ancestor": lit(REGION), "descendant": var("s")}, {"kind": "not", "expression": connected(var("x"), lit("Part-1"))},
    )
    return _found(spark, sf_dir, where)
