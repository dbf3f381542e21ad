"""MinHash near-duplicates with DartMinHash signatures.

An element of weight w owns the region [0, w) of a line whose other axis is rank. The line is cut
into strips ([0, 1), [1, 2), [2, 4), ... units of weight), the ranks into bands that double; hashed
darts fall into each cell as a Poisson process that depends on nothing but the element, the strip
and the band, and those beyond w are not the element's. Bands are thrown until each of the k
coordinates a dart can hash to has one; the earliest dart of a coordinate is its minimum. The work
follows the darts and the logarithm of the weights, not the weights themselves, and two documents
agree on a coordinate with probability equal to their weighted Jaccard similarity
(sum of least / sum of greatest weights).

A shingle weighs as often as it occurs. Signatures are banded; documents in a bucket are compared
with the bucket's leader, so thousands of copies cost thousands of comparisons. Documents that no
chain of such links ties to their leader are then compared with each other and with the bucket's
other members, but for those that the triangle inequality of the Jaccard distance rules out; a
bucket too large for one task, in documents or in shingles, is cut into blocks, of which every two
meet in a task. So each two similar documents that share a bucket end in one group, whatever the
bucket's size. Every link is confirmed by the exact weighted Jaccard similarity; groups are the
connected components of the links.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import _batch as B
from weft.llm._shared import by_name, fresh, id_text, written

SHINGLE, SIMILARITY = 5, 0.8
#: 28 bands of 5 rows miss a pair of similarity 0.8 with probability (1 - 0.8**5) ** 28 = 1.5e-5.
BANDS, ROWS = 28, 5
#: So many documents of a bucket, with so many shingles, are compared in one task; larger buckets
#: are cut into blocks of half as many, and each pair of blocks is one task.
CELL_DOCS, CELL_SHINGLES = 512, 1 << 20
_MIN_BAND = 4  # the first rank band reaches to 2**-4
_CELL_DARTS = 8  # cells with more expected darts are thrown in parts

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def shingles(data: np.ndarray, off: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes sorted and distinct per document, their counts, offsets per document).

    Words are runs of letters, digits and bytes from 0x80, ASCII lower case; a document of fewer
    than n words, but not none, is one shingle.
    """
    low = B.lower_ascii(data)
    start, end, woff = B.words(low, off, _WORD[data])
    wh = B.segment_hash(low, start, end)
    win, doc = B.window_owner(woff, n)
    key = B.window_hash(wh, n)[win] if len(win) else np.zeros(0, np.uint64)
    count = np.diff(woff)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        h = np.zeros(len(short), np.uint64)
        for k in range(n - 1):
            has = count[short] > k
            h[has] = B.mix(h[has] * np.uint64(31) + wh[woff[short[has]] + k])
        key, doc = np.concatenate([key, h]), np.concatenate([doc, short])
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    return key[at], np.diff(np.append(at, len(key))), np.searchsorted(doc[at], np.arange(len(off)))


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _poisson(u: np.ndarray, mean: float) -> np.ndarray:
    """Counts by inversion."""
    p = np.exp(-mean)
    total, n = p, np.zeros(len(u), np.int64)
    k, live = 0, u > total
    while live.any() and k < 60 + 10 * mean:
        n += live
        k += 1
        p *= mean / k
        total += p
        live &= u > total
    return n


def _strips(weight: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """(element, strip) of each strip that an element's region reaches into."""
    top = np.zeros(len(weight), np.int64)
    big = weight > unit
    top[big] = np.ceil(np.log2(weight[big] / unit)).astype(np.int64)
    count = np.where(weight > 0, top + 1, 0)
    element = np.repeat(np.arange(len(weight)), count)
    return element, np.arange(len(element)) - np.repeat(np.cumsum(count) - count, count)


def signatures(key: np.ndarray, weight: np.ndarray, soff: np.ndarray, k: int, unit: float = 1.0) -> np.ndarray:
    """k minima (uint64 dart identities) per document; documents without weight get zeros.

    Weights are any numbers from 0 on; ``unit``, the width of the first strip, changes the work
    only (the fewest darts where it is about the usual weight), but must be the same everywhere.
    """
    n_docs = len(soff) - 1
    best = np.full(n_docs * k, np.inf)
    name = np.zeros(n_docs * k, np.uint64)
    weight = np.asarray(weight, np.float64)
    element, strip = _strips(weight, unit)
    owner = np.repeat(np.arange(n_docs), np.diff(soff))[element]
    base = B.mix(key[element] + strip.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    reach = weight[element]
    lo, hi, band = 0.0, 2.0**-_MIN_BAND, 0
    open_ = np.zeros(n_docs, bool)
    open_[owner] = True
    while len(base):
        for level in np.unique(strip).tolist():
            mine = np.flatnonzero(strip == level)
            left, width = (0.0, unit) if level == 0 else (unit * 2.0 ** (level - 1), unit * 2.0 ** (level - 1))
            mean = width * (hi - lo)
            cells = max(1, int(np.ceil(mean / _CELL_DARTS)))
            whole = bool((reach[mine] >= left + width).all())
            for cell in range(cells):
                a, w = lo + cell * (hi - lo) / cells, (hi - lo) / cells
                h = B.mix(base[mine] ^ B.mix(np.full(1, (band << 32) + cell + 1, np.uint64)))
                count = _poisson(_uniform(h), mean / cells)
                has = np.flatnonzero(count)
                if not len(has):
                    continue
                which = np.repeat(has, count[has])
                nth = np.arange(len(which)) - np.repeat(np.cumsum(count[has]) - count[has], count[has])
                dart = B.mix(h[which] + (nth + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                if not whole:
                    inside = left + width * _uniform(B.mix(dart ^ np.uint64(0x9FB21C651E98DF25))) < reach[mine[which]]
                    which, dart = which[inside], dart[inside]
                rank = a + w * _uniform(B.mix(dart ^ np.uint64(0x2545F4914F6CDD1D)))
                slot = owner[mine[which]] * k + (dart % np.uint64(k)).astype(np.int64)
                order = np.lexsort((dart, rank, slot))
                slot, rank, dart = slot[order], rank[order], dart[order]
                first = np.ones(len(slot), bool)
                first[1:] = slot[1:] != slot[:-1]
                slot, rank, dart = slot[first], rank[first], dart[first]
                better = rank < best[slot]
                best[slot[better]], name[slot[better]] = rank[better], dart[better]
        open_ &= np.isinf(best.reshape(n_docs, k)).any(1)
        live = open_[owner]
        base, owner, strip, reach = base[live], owner[live], strip[live], reach[live]
        lo, hi, band = hi, hi * 2, band + 1
    return name.reshape(n_docs, k)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            h = B.mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + r])
        out[:, b] = h
    return out


def _per_slice(at: int, make):
    def run(batches):
        for batch in batches:
            for lo, hi, data, off in B.slices(batch.column(at)):
                yield make(batch.slice(lo, hi - lo), data, off)

    return B.tidy(run)


def _members(key: np.ndarray, count: np.ndarray, soff: np.ndarray, weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    """(names, offsets) of each document's set; an element of weight c stands in it under c names.

    The Jaccard similarity of such sets is the weighted one of the elements.
    """
    if not weighted or not len(key) or count.max() == 1:
        return key, soff
    copies = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    more = np.repeat(key, count)
    again = copies > 0
    more[again] = B.mix(more[again] ^ B.mix(copies[again].astype(np.uint64)))
    return more, np.concatenate([[0], np.cumsum(count)])[soff]


def signed(docs: DataFrame, bands: int, rows: int, shingle: int, weighted: bool) -> DataFrame:
    """doc_id, text_hash, class1 and class2 (128 bits over the word sequence), n_shingles (their weight), bands[]."""

    def make(batch, data, off):
        key, count, soff = shingles(data, off, shingle)
        weight = count if weighted else np.ones_like(count)
        sig = signatures(key, weight, soff, bands * rows)
        total = np.concatenate([[0], np.cumsum(weight)])
        low = B.lower_ascii(data)
        start, end, woff = B.words(low, off, _WORD[data])
        wh = B.segment_hash(low, start, end)
        n = np.diff(woff)
        # The word sequence of each document, as two hashes of the words' hashes.
        raw = np.ascontiguousarray(wh).view(np.uint8)
        c1 = B.segment_hash(raw, woff[:-1] * 8, woff[1:] * 8)
        c2 = B.mix(B.segment_hash(np.ascontiguousarray(B.mix(wh ^ np.uint64(0x5851F42D4C957F2D))).view(np.uint8), woff[:-1] * 8, woff[1:] * 8) + n.astype(np.uint64))
        hashes = band_hashes(sig, bands, rows).view(np.int64)
        ends = np.arange(len(n) + 1) * bands
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(2), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), pa.array(np.diff(total[soff])),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes.ravel()))
            ],
            names=["doc_id", "text_hash", "class1", "class2", "n_shingles", "bands"],
        )

    rows_in = docs.withColumn("text_hash", F.xxhash64("text"))
    return rows_in.mapInArrow(_per_slice(1, make), "doc_id bigint, text_hash bigint, class1 bigint, class2 bigint, n_shingles bigint, bands array<bigint>")


def shingle_sets(docs: DataFrame, shingle: int, weighted: bool) -> DataFrame:
    """The columns of docs but text, and set (distinct shingle hashes, one for each unit of weight)."""
    names = [c for c in docs.columns if c != "text"]
    at = docs.columns.index("text")

    def make(batch, data, off):
        key, soff = _members(*shingles(data, off, shingle), weighted)
        sets = pa.ListArray.from_arrays(pa.array(soff, pa.int32()), pa.array(key.view(np.int64)))
        return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), sets], names=[*names, "set"])

    kinds = dict(docs.dtypes)
    return docs.mapInArrow(_per_slice(at, make), ", ".join(f"{c} {kinds[c]}" for c in names) + ", set array<bigint>")


def _similar(batches):
    """Of pairs with both sets: a, b, jaccard."""
    for batch in batches:
        a, b = batch.column(2), batch.column(3)
        score = np.zeros(batch.num_rows)
        va, vb = np.asarray(a.flatten()), np.asarray(b.flatten())
        oa, ob = np.asarray(a.offsets) - a.offsets[0].as_py(), np.asarray(b.offsets) - b.offsets[0].as_py()
        for k in range(batch.num_rows):
            x, y = va[oa[k] : oa[k + 1]], vb[ob[k] : ob[k + 1]]
            both = len(np.intersect1d(x, y, assume_unique=True))
            score[k] = both / max(1, len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["a", "b", "jaccard"])


def _links_within(table: pa.Table, similarity: float) -> pa.Table:
    """Links among the documents of one cell: a spanning set of the similar pairs of which one is ``out``.

    Intersections of all pairs at once, as products of membership matrices over blocks of the
    shingles that two or more of them hold.
    """
    n = table.num_rows
    col = table.column("set").combine_chunks()
    off = np.asarray(col.offsets) - col.offsets[0].as_py()
    size = np.diff(off).astype(np.float64)
    value = np.asarray(col.flatten())
    order = np.argsort(value)
    value = value[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    del value
    begin = np.flatnonzero(new)
    shared = np.diff(np.append(begin, len(new))) > 1
    use = np.repeat(shared, np.diff(np.append(begin, len(new))))
    at = (np.cumsum(shared) - 1).astype(np.int32)[np.cumsum(new)[use] - 1]
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(off))[order[use]]
    del order, new, use
    both = np.zeros((n, n), np.float32)
    for lo in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(at, [lo, lo + 4096])
        m = np.zeros((n, 4096), np.float32)
        m[owner[a:b], at[a:b] - lo] = 1
        both += m @ m.T
    out = table.column("out").to_numpy()
    similar = (both >= similarity * (size[:, None] + size[None, :] - both) - 1e-6) & (out[:, None] | out[None, :])
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for x, y in zip(*np.nonzero(np.triu(similar, 1))):
        rx, ry = find(int(x)), find(int(y))
        if rx != ry:
            root[ry] = rx
            links.append((int(x), int(y)))
    a, b = [x for x, _ in links], [y for _, y in links]
    i, t = table.column("i"), table.column("t")
    return pa.table({
        "ai": i.take(a), "at": t.take(a), "bi": i.take(b), "bt": t.take(b)
    }) if links else pa.table({k: pa.array([], pa.int64()) for k in ("ai", "at", "bi", "bt")})


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """node, root: the least node of each connected component of (a, b) rows.

    Rounds of least-neighbour labels with a jump to the label's label; each round is written to
    the shared folder, and only the count of changes reaches the driver.
    """
    both = written(spark, edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links", small=True)
    label = written(spark, both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels", small=True)
    while True:
        near = both.join(label.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        step = label.join(near.select(F.col("a").alias("node"), "r"), "node", "left").select(
            "node", F.col("root").alias("old"), F.least("root", F.coalesce("r", "root")).alias("root")
        )
        up = label.select(F.col("node").alias("root"), F.col("root").alias("rr"))
        after = written(spark, step.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("rr", "root")).alias("root")), "labels", small=True)
        changed = after.where(F.col("root") != F.col("old")).limit(1).count()
        label = after.select("node", "root")
        if not changed:
            return label


def _cells(spark: SparkSession, led: DataFrame, scored: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """key, doc, out: the cells in which all documents of a bucket meet that may still be unlinked.

    ``out`` are the documents in another group than their leader: they meet each other and the
    rest of the bucket. Two documents of similarity s to each other differ in their similarity to
    the leader by 1 - s at most (the Jaccard distance is a metric); others of the bucket that differ
    more from every document that is out stay away. Scores of less than 2 s - 1 may be missing.
    """
    root = lambda c, name: roots.select(F.col("node").alias(c), F.col("root").alias(name))
    score = scored.select(F.col("a").alias("doc"), F.col("b").alias("lead"), "jaccard")
    unlike = led.join(score.where(F.col("jaccard") >= similarity), ["doc", "lead"], "left_anti")
    apart = unlike.join(root("doc", "r"), "doc", "left").join(root("lead", "l"), "lead", "left").where(F.coalesce("r", "doc") != F.coalesce("l", "lead"))
    outs = written(spark, apart.select("key", "doc", "lead", "n").join(score, ["doc", "lead"], "left").select("key", "doc", "n", "jaccard"), "outs")
    tops = written(spark, outs.groupBy("key").agg(F.max(F.coalesce("jaccard", F.lit(2 * similarity - 1))).alias("top")), "tops", small=True)
    rest = led.join(tops, "key").join(score, ["doc", "lead"], "left").where(F.coalesce("jaccard", F.lit(0.0)) <= F.col("top") + (1 - similarity + 1e-9))
    rest = rest.join(outs.select("key", "doc"), ["key", "doc"], "left_anti")
    members = written(spark, outs.select("key", "doc", "n", F.lit(True).alias("out")).unionByName(rest.select("key", "doc", "n", F.lit(False).alias("out"))), "members")
    one = (F.count(F.lit(1)) <= CELL_DOCS) & (F.sum("n") <= CELL_SHINGLES)
    blocks = lambda which: F.greatest(F.ceil(F.count_if(which) * 2 / CELL_DOCS), F.ceil(F.sum(F.when(which, F.col("n")).otherwise(0)) * 2 / CELL_SHINGLES))
    # Blocks of documents that are out and of others; a small bucket is one cell.
    sizes = members.groupBy("key").agg(
        F.when(one, 1).otherwise(blocks(F.col("out"))).alias("x"), F.when(one, 0).otherwise(blocks(~F.col("out"))).alias("y"),
        F.count(F.lit(1)).alias("c")
    ).where("c > 1").drop("c")
    placed = members.drop("n").join(written(spark, sizes, "sizes", small=True), "key")
    salt = F.xxhash64("doc", F.lit(1))
    placed = placed.withColumn(
        "at",
        F.when((F.col("x") + F.col("y") == 1) | F.col("out"), F.pmod(salt, F.col("x"))).otherwise(F.col("x") + F.pmod(salt, F.greatest(F.col("y"), F.lit(1))))
    )
    # Blocks that are out meet all other blocks, the others only those; two blocks compare all they hold.
    meets = F.filter(
        F.sequence(F.lit(0).cast("long"), F.col("x") + F.when(F.col("out"), F.col("y")).otherwise(0) - 1),
        lambda k: (k != F.col("at")) | (F.col("x") + F.col("y") == 1)
    )
    return placed.withColumn("k", F.explode(meets)).select(F.xxhash64("key", F.least("at", "k"), F.greatest("at", "k")).alias("key"), "doc", "out")


def groups(
    spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, weighted: bool = True,
) -> DataFrame:
    """doc_id, text_hash, class_id, class_hash, n_links: one row for each row of docs.

    (class_id, class_hash) is the least (doc_id, text_hash) of the near-duplicate group, n_links
    the number of confirmed links from the row's text to different texts. Texts of the same word sequence are one
    class before any signature is compared. Texts without words (null, empty) are never
    duplicates; repeated rows are each reported; null ids sort first. Without ``weighted`` a
    shingle weighs 1 however often it occurs.
    """
    rows_in = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    me = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("i"), F.col("text_hash").alias("t"))
    table = written(spark, signed(rows_in, bands, rows, shingle, weighted).withColumn("doc", me), "signatures")
    wordy = table.where(F.col("n_shingles") > 0)
    classes = wordy.groupBy("class1", "class2").agg(F.min("doc").alias("rep"))
    # One row per class: its least document, which alone is banded.
    reps = wordy.join(classes.select(F.col("rep").alias("doc")), "doc", "left_semi").select("doc", F.col("n_shingles").alias("n"), "bands").dropDuplicates(["doc"])
    places = reps.select("doc", "n", F.posexplode("bands").alias("band", "h")).select(F.xxhash64("band", "h").alias("key"), "doc", "n")
    # Counts per bucket are written before they are joined: a bucket with a large part of all
    # rows can then be split by the join, which could not split an aggregate's own partitions.
    busy = written(spark, places.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key"), "busy", small=True)
    rows_open = written(spark, places.join(busy, "key"), "buckets")
    texts = rows_in.select(F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("i"), F.xxhash64("text").alias("t")).alias("doc"), "text")
    flat = texts.join(rows_open.select("doc").distinct(), "doc", "left_semi").select(F.col("doc.i").alias("i"), F.col("doc.t").alias("t"), "text")
    sets = written(spark, shingle_sets(flat, shingle, weighted).dropDuplicates(["i", "t"]).select(F.struct("i", "t").alias("doc"), "set"), "shingle-sets")
    leads = written(
        spark,
        rows_open.groupBy("key").agg(F.min(F.struct("doc", "n")).alias("l")).select("key", F.col("l.doc").alias("lead"), F.col("l.n").alias("m")),
        "leads", small=True
    )
    led = written(spark, rows_open.join(leads, "key").where(F.col("doc") != F.col("lead")), "led")
    # Sets of too different sizes cannot be similar, nor rule out anything by their similarity.
    near = led.where(F.least("n", "m") >= (2 * similarity - 1) * F.greatest("n", "m")).select(F.col("doc").alias("a"), F.col("lead").alias("b")).distinct()
    left = near.join(sets.select(F.col("doc").alias("a"), F.col("set").alias("x")), "a")
    full = left.join(sets.select(F.col("doc").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    scored = written(spark, full.mapInArrow(B.tidy(_similar), "a struct<i:bigint,t:bigint>, b struct<i:bigint,t:bigint>, jaccard double"), "scores")
    good = scored.where(F.col("jaccard") >= similarity).select("a", "b")
    led_roots = components(spark, good)
    cells = _cells(spark, led, scored, led_roots, similarity).join(sets, "doc").select("key", F.col("doc.i").alias("i"), F.col("doc.t").alias("t"), "set", "out")
    within = cells.groupBy("key").applyInArrow(lambda table: _links_within(table, similarity), "ai bigint, at bigint, bi bigint, bt bigint")
    more = written(
        spark,
        within.distinct().select(
            F.struct(F.col("ai").alias("i"), F.col("at").alias("t")).alias("a"),
            F.struct(F.col("bi").alias("i"), F.col("bt").alias("t")).alias("b")
        ),
        "links", small=True
    )
    links = good.unionByName(more).distinct()
    # The later links tie groups of the former together.
    old = lambda c: led_roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    ties = more.join(old("a"), "a", "left").join(old("b"), "b", "left").select(
        F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b")
    ).where("a != b").distinct()
    tied = components(spark, ties).select(F.col("node").alias("near"), F.col("root").alias("far"))
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    of_rep = degree.join(led_roots, "node", "left").withColumn("near", F.coalesce("root", "node")).join(tied, "near", "left").select(
        F.col("node").alias("rep"), F.coalesce("far", "near").alias("root"), "n_links"
    )
    of_class = classes.join(of_rep, "rep", "left").select(
        "class1", "class2", F.coalesce("root", "rep").alias("root"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")
    )
    out = table.join(of_class, ["class1", "class2"], "left").withColumn("root", F.coalesce("root", "doc"))
    blank = F.col("n_shingles") == 0
    root_id = F.when(F.col("root.i") == -(2**63), F.lit(None).cast("long")).otherwise(F.col("root.i"))
    return out.select(
        "doc_id", "text_hash", F.when(blank, F.col("doc_id")).otherwise(root_id).alias("class_id"), F.when(blank, F.col("text_hash")).otherwise(F.col("root.t")).alias("class_hash"),
        F.when(blank, F.lit(0).cast("long")).otherwise(F.coalesce("n_links", F.lit(0).cast("long"))).alias("n_links"), "n_shingles",
    )


def one_of_each(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each group: that of the least (doc_id, text hash); all columns stay.

    Of repeated rows (same id and text) one stays; rows without words all stay.
    """
    got = written(spark, groups(spark, docs, id_col=id_col, text_col=text_col, **options), "near-groups")
    i, t = fresh(docs, "id", "hash")
    text = F.coalesce(by_name(docs, text_col).cast("string"), F.lit(""))
    keep = got.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_hash")))
    many = keep.where("n_shingles > 0").groupBy("doc_id", "text_hash").count().where("count > 1")
    out = docs.join(
        keep.select(F.col("doc_id").alias(i), F.col("text_hash").alias(t)).distinct(),
        by_name(docs, id_col).cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(t)), "left_semi"
    )
    if many.isEmpty():
        return out
    from pyspark.sql import Window as W

    n, = fresh(docs, "copy")
    wordy = text.rlike(r"[0-9A-Za-z\x{80}-\x{10FFFF}]")
    ranked = out.withColumn(n, F.row_number().over(W.partitionBy(by_name(docs, id_col), F.xxhash64(text)).orderBy(F.lit(1))))
    return ranked.where((F.col(n) == 1) | ~wordy).drop(n)
