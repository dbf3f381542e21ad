"""Relational message passing: lowering, checks, layers, CSR and chunk tables.

    Y[v] = act(bias + X[v] Wself + sum over relation types r of (sum of w_e X[u], e: u -> v) W_r)

Messages are first summed per (target, relation type), a column for each feature -- partial sums
before the shuffle -- and the small matrices are applied after it, so what is shuffled does not
depend on the output width. ``strict_layer`` adds in the fixed order of a sequential program
instead, in single precision.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.plans.session import by_size, cut, stored

NODES = "key string, type_keys array<string>, x array<float>"
RELATIONS = "key string, type_key string, src string, dst string, w float"
MAX_CORE = 65_536


@dataclass(frozen=True)
class Layer:
    """Widths, a matrix [in][out] for each relation type, and the rest optional."""

    inputs: int
    outputs: int
    relations: dict[str, list[list[float]]]
    own: list[list[float]] | None = None
    bias: list[float] | None = None
    activation: str = "identity"
    extra: dict = field(default_factory=dict)


def _matrix_codes(name: str, m, rows: int, cols: int) -> list[tuple[str, str]]:
    if len(m) != rows or any(len(r) != cols for r in m):
        return [(f"{name}.shape", f"expected {rows} x {cols}")]
    return [] if all(math.isfinite(v) for r in m for v in r) else [(f"{name}.non_finite", "a value is not finite")]


def layer_diagnostics(layer: Layer) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    if layer.inputs < 1:
        out.append(("spec.input_width", "at least 1"))
    if layer.outputs < 1:
        out.append(("spec.output_width", "at least 1"))
    if layer.activation.lower() not in ("identity", "relu"):
        out.append(("spec.activation", layer.activation))
    if layer.relations is None:
        out.append(("spec.relation_transforms.required", "none given"))
    for key, m in (layer.relations or {}).items():
        if not str(key or "").strip():
            out.append(("spec.relation_transform.type.required", "a blank type"))
        if m is None:
            out.append(("spec.relation_transform.required", str(key)))
        else:
            out += _matrix_codes("spec.relation_transform", m, layer.inputs, layer.outputs)
    if layer.own is not None:
        out += _matrix_codes("spec.self_transform", layer.own, layer.inputs, layer.outputs)
    if layer.bias is not None:
        out += _matrix_codes("spec.bias", [layer.bias], 1, layer.outputs)
    return out


def diagnostics(nodes: DataFrame, relations: DataFrame, layer: Layer) -> DataFrame:
    """code, message of everything wrong with a snapshot and a layer; all at once, not the first."""
    spark = nodes.sparkSession
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    say = lambda df, code, what: df.select(F.lit(code).alias("code"), F.coalesce(what.cast("string"), F.lit("")).alias("message"))
    key, one = F.col("key"), lambda df: df.groupBy("key").count().where("count > 1")
    ends = nodes.select(F.col("key").alias("end")).distinct()
    spec = spark.createDataFrame(layer_diagnostics(layer), "code string, message string")
    wanted = relations.select("type_key").distinct().where(~F.col("type_key").isin(list(layer.relations or {})))
    parts = [
        say(nodes.where(blank("key")), "snapshot.node.key.required", key), say(one(nodes), "snapshot.node.key.duplicate", key),
        say(nodes.where(F.col("type_keys").isNull() | (F.size("type_keys") == 0)), "snapshot.node.type.required", key),
        say(nodes.where(F.exists("type_keys", lambda t: t.isNull() | (F.trim(t) == ""))), "snapshot.node.type.invalid", key),
        say(nodes.where(F.coalesce(F.size("x"), F.lit(0)) != layer.inputs), "snapshot.node.feature_width", key),
        say(nodes.where(~F.forall("x", finite)), "snapshot.node.feature.non_finite", key),
        say(relations.where(blank("key")), "snapshot.relation.key.required", key), say(one(relations), "snapshot.relation.key.duplicate", key),
        say(relations.where(blank("type_key")), "snapshot.relation.type.required", key),
        say(relations.join(ends, F.col("src") == F.col("end"), "left_anti"), "snapshot.relation.source.missing", key),
        say(relations.join(ends, F.col("dst") == F.col("end"), "left_anti"), "snapshot.relation.target.missing", key),
        say(relations.where(~finite(F.col("w"))), "snapshot.relation.weight.non_finite", key),
        say(wanted, "spec.relation_transform.missing", F.col("type_key")),
    ]
    out = spec
    for p in parts:
        out = out.unionByName(p)
    return out


def canonical_types(keys: Column) -> Column:
    return F.array_sort(F.array_distinct(keys))


def lower_edges(nodes: DataFrame, edges: DataFrame, type_key: str) -> DataFrame:
    """Directed relations from undirected edges(a_gid, b_gid) inside nodes(key).

    Each unordered pair, in order of its ends, gives two relations ``type/i/forward`` and
    ``type/i/reverse`` of weight 1; edges that leave the snapshot are dropped, self-loops an error.
    """
    pair = edges.select(F.least("a_gid", "b_gid").alias("a"), F.greatest("a_gid", "b_gid").alias("b")).distinct()
    pair = pair.select(F.when(F.col("a") == F.col("b"), F.raise_error(F.lit("a self-loop cannot be lowered"))).otherwise(F.col("a")).alias("a"), "b")
    key = nodes.select(F.col("key").alias("k"))
    inside = pair.join(key, F.col("a") == F.col("k"), "left_semi").join(key, F.col("b") == F.col("k"), "left_semi")
    numbered = ordinal(inside, ["a", "b"], "i")
    both = numbered.select(
        "i",
        F.explode(F.array(
            F.struct(F.lit("forward").alias("d"), F.col("a").alias("src"), F.col("b").alias("dst")),
            F.struct(F.lit("reverse").alias("d"), F.col("b").alias("src"), F.col("a").alias("dst"))
        )).alias("e")
    )
    return both.select(
        F.concat_ws("/", F.lit(type_key), F.col("i").cast("string"), "e.d").alias("key"), F.lit(type_key).alias("type_key"), "e.src",
        "e.dst", F.lit(1.0).cast("float").alias("w")
    )


def ordinal(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with a 0-based position in the order of ``by``, which must be unique.

    Ranges are sorted in parallel; only their row counts meet in one place.
    """
    ranged = cut(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("_part", (F.sum("n").over(W.orderBy("_part")) - F.col("n")).alias("before"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*by)) - 1
    return ranged.withColumn("_place", place).join(F.broadcast(before), "_part").withColumn(name, F.col("before") + F.col("_place")).drop("_part", "_place", "before")


def messages(nodes: DataFrame, relations: DataFrame, width: int) -> DataFrame:
    """dst, type_key, sums: weighted feature sums of incoming relations, position by position."""
    src = nodes.select(F.col("key").alias("src"), "x")
    sent = relations.join(src, "src").select("dst", "type_key", F.col("w").cast("double").alias("w"), "x")
    cells = sent.groupBy("dst", "type_key").agg(*(F.sum(F.col("w") * F.get("x", F.lit(i))).alias(f"s{i}") for i in range(width)))
    return cells.select("dst", "type_key", F.array(*(f"s{i}" for i in range(width))).alias("sums"))


#: Bits of a bin, and the bins that products of two 32-bit floats reach: bin k counts in steps of 2 ** (BIN_BITS * k).
BIN_BITS, BINS = 24, range(-13, 12)


def binned(term: Column) -> Column:
    """A product of two 32-bit floats as an array of (bin, amount): whole amounts whose steps add up to it exactly.

    The 48 bits of such a product lie in three neighbouring bins; a fourth is there for a first bin that the logarithm
    puts one too high. A term that is no number is an error.
    """
    steps = F.array(*(F.lit(2.0 ** (BIN_BITS * k)) for k in BINS))
    step = lambda k: F.get(steps, k - BINS[0])
    size = F.abs(term)
    first = F.least(F.greatest(F.floor(F.log2(size) / BIN_BITS).cast("int"), F.lit(BINS[0] + 3)), F.lit(BINS[-1]))
    last = F.array().cast("array<struct<k:int,m:bigint>>")
    start = F.struct(term.alias("rest"), last.alias("got"))

    def take(state, j):
        k = first - j
        amount = (state["rest"] / step(k)).cast("bigint")  # cut towards zero
        got = F.when(amount != 0, F.concat(state["got"], F.array(F.struct(k.alias("k"), amount.alias("m"))))).otherwise(state["got"])
        return F.struct((state["rest"] - amount.cast("double") * step(k)).alias("rest"), got.alias("got"))

    whole = F.aggregate(F.array(*(F.lit(j) for j in range(4))), start, take, lambda s: s["got"])
    wrong = F.raise_error(F.lit("a message is not finite")).cast("array<struct<k:int,m:bigint>>")
    return F.when(term == 0, last).when(size < float("inf"), whole).otherwise(wrong)


def exact_messages(nodes: DataFrame, relations: DataFrame, width: int) -> DataFrame:
    """dst, type_key, sums as ``messages``, but the same bits whatever the order and the partitions.

    Terms are taken apart into whole amounts per bin, and whole numbers add up alike in any order; amounts are summed up
    before the shuffle, so a target of very many relations is spread over tasks. The bins of a sum, a few, are put together
    from the least. 2 ** 38 relations of one target and type fit a bin.
    """
    src = nodes.select(F.col("key").alias("src"), "x")
    sent = relations.join(src, "src").select("dst", "type_key", F.col("w").cast("double").alias("w"), "x")
    terms = sent.select("dst", "type_key", F.posexplode(F.array(*(F.col("w") * F.get("x", F.lit(i)).cast("double") for i in range(width)))).alias("i", "term"))
    bins = terms.select("dst", "type_key", "i", F.explode_outer(binned(F.col("term"))).alias("b")).select("dst", "type_key", "i", F.col("b.k").alias("k"), F.col("b.m").alias("m"))
    sums = bins.groupBy("dst", "type_key", "i", "k").agg(F.sum("m").alias("m"))
    steps = F.array(*(F.lit(2.0 ** (BIN_BITS * k)) for k in BINS))
    part = F.struct(F.coalesce("k", F.lit(BINS[0])).alias("k"), F.coalesce("m", F.lit(0)).alias("m"))
    value = F.aggregate(F.array_sort(F.collect_list(part)), F.lit(0.0), lambda s, b: s + b["m"].cast("double") * F.get(steps, b["k"] - BINS[0]))
    whole = sums.groupBy("dst", "type_key", "i").agg(value.alias("v"))
    cells = whole.groupBy("dst", "type_key").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c"))
    return cells.select("dst", "type_key", F.transform("c", lambda x: x["v"]).alias("sums"))


def _times(vector: Column, matrix: list[list[float]]) -> list[Column]:
    cols = list(zip(*matrix))
    return [F.aggregate(F.zip_with(vector, F.array(*(F.lit(float(v)) for v in c)), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for c in cols]


def _checked(layer: Layer) -> None:
    bad = layer_diagnostics(layer)
    if bad:
        raise ValueError("; ".join(f"{c}: {m}" for c, m in bad))


def _transforms(spark, layer: Layer) -> DataFrame:
    """type_key, matrix of the relation types, a row for each."""
    rows = [(t, [[float(v) for v in r] for r in zip(*m)]) for t, m in sorted(layer.relations.items())]
    return spark.createDataFrame(rows, "type_key string, matrix array<array<double>>")


def apply_layer(nodes: DataFrame, relations: DataFrame, layer: Layer, exact: bool = False) -> DataFrame:
    """key, y of every node; nodes without incoming relations get bias and own part.

    Sums are taken in double and rounded to float at the end (exact where the products are). The
    matrices are a small table (a row for each relation type), so the plan does not grow with them.
    ``exact`` sums do not depend on any order: the same bits on any number of partitions.
    """
    _checked(layer)
    width = layer.outputs
    zero = F.array(*(F.lit(0.0) for _ in range(width)))
    summed = (exact_messages if exact else messages)(nodes, relations, layer.inputs)
    sums = summed.join(F.broadcast(_transforms(nodes.sparkSession, layer)), "type_key", "left")
    known = F.coalesce("matrix", F.raise_error(F.concat(F.lit("spec.relation_transform.missing: "), F.col("type_key"))).cast("array<array<double>>"))
    moved = sums.select("dst", "type_key", F.transform(known, lambda column: F.aggregate(F.zip_with("sums", column, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)).alias("v"))
    if exact:  # a target has a row for each type of the layer at most: they are added in the types' order
        ordered = F.array_sort(F.collect_list(F.struct("type_key", "v")))
        got = moved.groupBy("dst").agg(F.aggregate(ordered, zero, lambda s, x: F.zip_with(s, x["v"], lambda a, b: a + b)).alias("got"))
    else:
        got = moved.groupBy("dst").agg(*(F.sum(F.get("v", F.lit(o))).alias(f"v{o}") for o in range(width)))
        got = got.select("dst", F.array(*(f"v{o}" for o in range(width))).alias("got"))
    own = F.array(*_times(F.transform("x", lambda v: v.cast("double")), layer.own)) if layer.own is not None else zero
    bias = F.array(*(F.lit(float(b)) for b in layer.bias)) if layer.bias is not None else zero
    total = F.zip_with(F.zip_with(bias, own, lambda a, b: a + b), F.coalesce("got", zero), lambda a, b: a + b)
    if layer.activation.lower() == "relu":
        total = F.transform(total, lambda v: F.greatest(F.lit(0.0), v))
    return nodes.join(got, F.col("key") == F.col("dst"), "left").select("key", F.transform(total, lambda v: v.cast("float")).alias("y"))


def strict_layer(nodes: DataFrame, relations: DataFrame, layer: Layer) -> DataFrame:
    """key, y as a sequential program in single precision computes them.

    For each target and output: the bias, then the own features, then the relations by type,
    source and key, each feature by feature, added one after the other as 32-bit numbers. The
    terms of a target stream through one task in that order (a sum in a fixed order has no parts),
    a batch at a time.
    """
    _checked(layer)
    src = nodes.select(F.col("key").alias("src"), "x")
    sent = relations.join(src, "src").select(F.col("dst").alias("t"), "type_key", "src", "key", F.col("w").cast("float").alias("w"), "x")
    none = F.lit(None).cast("string")
    own = nodes.select(F.col("key").alias("t"), none.alias("type_key"), none.alias("src"), none.alias("key"), F.lit(1.0).cast("float").alias("w"), "x")
    every = own.unionByName(sent).repartition("t").sortWithinPartitions("t", F.col("type_key").asc_nulls_first(), "src", "key")
    single, outputs = np.float32, layer.outputs
    matrices: dict[str | None, np.ndarray] = {t: np.array(m, single).reshape(layer.inputs, layer.outputs) for t, m in layer.relations.items()}
    matrices[None] = np.array(layer.own, single).reshape(layer.inputs, layer.outputs) if layer.own is not None else None
    bias = np.array(layer.bias, single) if layer.bias is not None else np.zeros(layer.outputs, single)
    relu = layer.activation.lower() == "relu"

    def run(batches):
        target: str | None = None
        known, value = False, bias

        def row():
            y = np.maximum(single(0), value) if relu else value
            return target, y.tolist()

        for batch in batches:
            if not batch.num_rows:
                continue
            done = []
            t, kind = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            w, x = np.asarray(batch.column(4)), np.asarray(batch.column(5).flatten(), single).reshape(batch.num_rows, -1)
            lo = 0
            while lo < len(t):
                hi = lo + 1
                while hi < len(t) and t[hi] == t[lo] and kind[hi] == kind[lo]:
                    hi += 1
                if not known or t[lo] != target:
                    if known:
                        done.append(row())
                    target, known, value = t[lo], True, bias
                if kind[lo] is not None and kind[lo] not in matrices:
                    raise ValueError(f"spec.relation_transform.missing: {kind[lo]}")
                m = matrices[kind[lo]]
                if m is not None:
                    terms = ((w[lo:hi, None] * x[lo:hi])[:, :, None] * m).reshape(-1, outputs)
                    value = np.cumsum(np.concatenate([value[None], terms]), axis=0, dtype=single)[-1]
                lo = hi
            if done:
                yield _outputs(done)
        if known:
            yield _outputs([row()])

    def _outputs(rows):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([y for _, y in rows], pa.list_(pa.float32()))], names=["key", "y"])

    return every.mapInArrow(run, "key string, y array<float>")


def indexed(nodes: DataFrame) -> DataFrame:
    """key, idx: dense positions in key order, as the side of a join: sorted keys take a byte each in their files, which tell nothing of their rows."""
    return by_size(ordinal(nodes.select("key"), ["key"], "idx"))


def csr_entries(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """type_key, row (target), pos, col (source), w, key; parallel relations keep their order by key."""
    idx = indexed(nodes)
    e = relations.join(
        idx.select(F.col("key").alias("dst"), F.col("idx").alias("row")), "dst"
    ).join(idx.select(F.col("key").alias("src"), F.col("idx").alias("col")), "src")
    pos = F.row_number().over(W.partitionBy("type_key", "row").orderBy("col", "key")) - 1
    return e.select("type_key", "row", "col", "w", "key", pos.alias("pos"))


def csr_offsets(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """type_key, row, start, end of each target's entries; rows without entries are there too.

    Row counts are summed up per block of rows first, so no task holds a whole type.
    """
    idx, block = indexed(nodes), 1 << 16
    counts = relations.join(idx.select(F.col("key").alias("dst"), F.col("idx").alias("row")), "dst").groupBy("type_key", "row").agg(F.count(F.lit(1)).alias("n"))
    types = relations.select("type_key").distinct()
    full = idx.select(F.col("idx").alias("row")).crossJoin(F.broadcast(types)).join(counts, ["type_key", "row"], "left").select(
        "type_key", "row", F.coalesce("n", F.lit(0)).alias("n"), F.floor(F.col("row") / block).alias("b")
    )
    blocks = full.groupBy("type_key", "b").agg(F.sum("n").alias("bn"))
    first = blocks.select("type_key", "b", (F.sum("bn").over(W.partitionBy("type_key").orderBy("b")) - F.col("bn")).alias("first"))
    inside = F.sum("n").over(W.partitionBy("type_key", "b").orderBy("row"))
    end = F.col("first") + inside
    return full.join(first, ["type_key", "b"]).select("type_key", "row", (end - F.col("n")).cast("long").alias("start"), end.cast("long").alias("end"))


def chunks(nodes: DataFrame, relations: DataFrame, max_core: int = MAX_CORE) -> DataFrame:
    """chunk, key, is_core: blocks of targets in key order, and the sources they need besides."""
    return _with_halo(cores(nodes, max_core), relations)


def cores(nodes: DataFrame, max_core: int = MAX_CORE) -> DataFrame:
    """chunk, key: the block of each node, as the side of a join."""
    if max_core < 1:
        raise ValueError("a chunk needs at least one core node")
    return indexed(nodes).select(F.floor(F.col("idx") / max_core).alias("chunk"), "key")


def _with_halo(core: DataFrame, relations: DataFrame) -> DataFrame:
    need = relations.join(core.select("chunk", F.col("key").alias("dst")), "dst").select("chunk", F.col("src").alias("key")).distinct()
    halo = need.join(core, ["chunk", "key"], "left_anti")
    return core.withColumn("is_core", F.lit(True)).unionByName(halo.withColumn("is_core", F.lit(False)))


def chunk_relations(nodes: DataFrame, relations: DataFrame, max_core: int = MAX_CORE) -> DataFrame:
    """chunk, pos, type_key, dst, src, key, w: each chunk's relations, numbered by type, target, source and key."""
    mine = relations.join(cores(nodes, max_core).withColumnRenamed("key", "dst"), "dst")
    pos = F.row_number().over(W.partitionBy("chunk").orderBy("type_key", "dst", "src", "key")) - 1
    return mine.select("chunk", pos.cast("long").alias("pos"), "type_key", "dst", "src", "key", "w")


def apply_chunked(nodes: DataFrame, relations: DataFrame, layer: Layer, max_core: int = MAX_CORE) -> DataFrame:
    """key, y by chunks: each computes its core from core and halo alone, then the chunks are merged.

    A node that two chunks produce, or none, is an error when its row is read.
    """
    core = by_size(stored(cores(nodes, max_core)))
    c = by_size(stored(_with_halo(core, relations)))  # each is read several times, and numbered once
    inside = lambda column: F.concat_ws("/", F.col("chunk").cast("string"), column)
    members = nodes.join(c, "key").select(inside(F.col("key")).alias("key"), "type_keys", "x", F.col("key").alias("node"), "is_core")
    own = relations.join(core.withColumnRenamed("key", "dst"), "dst").select("key", "type_key", inside(F.col("src")).alias("src"), inside(F.col("dst")).alias("dst"), "w")
    out = apply_layer(members, own, layer).join(members.where("is_core").select("key", "node"), "key")
    one = out.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.first("y").alias("y"))
    merged = nodes.select("key").join(one, F.col("key") == F.col("node"), "left")
    wrong = F.when(
        F.col("n").isNull(), F.raise_error(F.concat(F.lit("no chunk produced "), F.col("key")))
    ).otherwise(F.raise_error(F.concat(F.lit("several chunks produced "), F.col("key"))))
    return merged.select("key", F.when(F.col("n") == 1, F.col("y")).otherwise(wrong.cast("array<float>")).alias("y"))


def run_graph(graph, roots, max_depth: int, features: Column, type_key: str, layer: Layer, max_core: int = MAX_CORE) -> DataFrame:
    """Subgraph, lowering and one layer, by chunks: key, y. ``features`` is a column over gid and attrs."""
    from weft.operators import traverse

    if max_depth < 0:
        raise ValueError("the depth is negative")
    near = traverse.subgraph(graph, roots, max_depth).select("gid")
    nodes = graph.nodes.join(near, "gid", "left_semi").select(
        F.col("gid").alias("key"), F.array(F.lit("node")).alias("type_keys"), features.cast("array<float>").alias("x")
    )
    return apply_chunked(nodes, lower_edges(nodes, graph.edges, type_key), layer, max_core)
