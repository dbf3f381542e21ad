"""Benchmark decontamination by Wu-Manber multi-pattern search.

The windows of the benchmark items (n consecutive words, or a whole shorter item) become byte
patterns over normalised text. A shift table over blocks of up to eight bytes says how far no
pattern can end, so most positions are never looked at; where the shift is zero, a suffix-hash
bucket names the possible patterns, an eight-byte prefix thins them out, and a direct comparison
of the bytes confirms each occurrence. Thousands of cursors walk a slice at once in numpy.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.llm import _batch as B
from weft.llm._shared import by_name, fresh, id_text, position

WINDOW = 10
#: Bytes of benchmark text in one block of patterns; a larger benchmark is searched block by block.
BLOCK_BYTES = 2 << 20

#: a-z, 0-9 and all bytes from 0x80 are word bytes; A-Z fold to a-z; the rest separates.
_NORM = np.full(256, 32, np.uint8)
_NORM[48:58] = np.arange(48, 58)
_NORM[97:123] = np.arange(97, 123)
_NORM[65:91] = np.arange(97, 123)
_NORM[128:] = np.arange(128, 256)
_BREAK = 1  # stands between documents; no pattern holds it

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
])


def item_words(text: str | None) -> list[bytes]:
    return _NORM[np.frombuffer((text or "").encode(), np.uint8)].tobytes().split() if text else []


class Machine:
    """Shift tables and suffix buckets of one block of benchmark items."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int = WINDOW):
        owners: dict[bytes, set] = {}
        for item, text in items:
            w = item_words(text)
            for i in range(max(1, len(w) - n + 1) if w else 0):
                owners.setdefault(b" " + b" ".join(w[i : i + n]) + b" ", set()).add(item)
        self.patterns = sorted(owners, key=lambda p: (len(p), p))
        self.items = [sorted(x for x in owners[p] if x is not None) for p in self.patterns]
        self.n_words = np.array([p.count(b" ") - 1 for p in self.patterns], np.int64)
        by_class: dict[int, list[int]] = {}
        for k, p in enumerate(self.patterns):
            by_class.setdefault(min(len(p), 64).bit_length(), []).append(k)
        self.classes = [self._build(ids) for ids in by_class.values()]

    def _build(self, ids: list[int]) -> tuple:
        m = min(len(self.patterns[k]) for k in ids)
        block = min(8, m)
        bits = max(12, min(22, (len(ids) * m).bit_length() + 2))
        head = np.frombuffer(b"".join(self.patterns[k][:m] for k in ids), np.uint8).reshape(len(ids), m)
        shift = np.full(1 << bits, m - block + 1, np.int32)
        for j in range(block - 1, m):
            value = np.zeros(len(ids), np.uint64)
            for b in range(block):
                value |= head[:, j - block + 1 + b].astype(np.uint64) << np.uint64(8 * b)
            h = _block_hash(value, bits)
            np.minimum.at(shift, h, m - 1 - j)
        order = np.argsort(h, kind="stable")
        first = np.searchsorted(h[order], np.arange((1 << bits) + 1))
        prefix = np.zeros(len(ids), np.uint64)
        for b in range(block):
            prefix |= head[:, b].astype(np.uint64) << np.uint64(8 * b)
        return m, block, bits, shift, first, np.array(ids, np.int64)[order], prefix[order]

    def occurrences(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, pattern) of every occurrence in a normalised buffer that begins with 8 breaks."""
        raw, starts, found = buf.tobytes() + bytes([_BREAK]) * 7, [], []
        view = np.ndarray(shape=(len(buf),), dtype="<u8", buffer=raw, strides=(1,))
        for m, block, bits, shift, first, ids, prefix in self.classes:
            drop = np.uint64(8 * (8 - block))
            lo = 8 + m - 1
            if len(buf) <= lo:
                continue
            step = 4096
            pos = np.arange(lo, len(buf), step, dtype=np.int64)
            end = np.minimum(pos + step, len(buf))
            hits = []
            while len(pos):
                h = _block_hash(view[pos - 7] >> drop, bits)
                s = shift[h]
                zero = s == 0
                if zero.any():
                    hits.append((pos[zero], h[zero]))
                pos = pos + np.maximum(s, 1)
                live = pos < end
                if not live.all():
                    pos, end = pos[live], end[live]
            if not hits:
                continue
            at, h = np.concatenate([x for x, _ in hits]), np.concatenate([x for _, x in hits])
            count = first[h + 1] - first[h]
            which = np.repeat(np.arange(len(at)), count)
            base = np.cumsum(count) - count
            slot = first[h][which] + np.arange(len(which)) - base[which]
            begin = at[which] - m + 1
            value = view[begin]
            if block < 8:
                value = value & np.uint64((1 << (8 * block)) - 1)
            ok = value == prefix[slot]
            for b, k in zip(begin[ok].tolist(), ids[slot[ok]].tolist()):
                if raw.startswith(self.patterns[k], b):
                    starts.append(b)
                    found.append(k)
        return np.array(starts, np.int64), np.array(found, np.int64)


def _block_hash(value: np.ndarray, bits: int) -> np.ndarray:
    return ((value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def normalised(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """`` word word `` per document, single spaces, a break between documents, 8 breaks in front."""
    buf = np.insert(_NORM[data], np.repeat(off, 3), np.tile(np.array([32, _BREAK, 32], np.uint8), len(off)))
    space = buf == 32
    keep = np.ones(len(buf), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return np.concatenate([np.full(8, _BREAK, np.uint8), buf[keep]])


def search_slice(machine: Machine, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, list, list]:
    """Per document: n_words, n_hit, item ids with occurring windows, merged word spans."""
    buf = normalised(data, off)
    word = buf > 32
    start = np.flatnonzero(word[1:] & ~word[:-1]) + 1
    breaks = np.flatnonzero(buf == _BREAK)[8:]
    woff = np.searchsorted(start, breaks)
    n_docs = len(off) - 1
    n_words = np.diff(woff)
    begin, pattern = machine.occurrences(buf)
    items: list[list[str]] = [[] for _ in range(n_docs)]
    spans: list[list[tuple[int, int]]] = [[] for _ in range(n_docs)]
    n_hit = np.zeros(n_docs, np.int64)
    if len(begin):
        w = np.searchsorted(start, begin)
        delta = np.zeros(len(start) + 1, np.int64)
        np.add.at(delta, w, 1)
        np.add.at(delta, w + machine.n_words[pattern], -1)
        covered = np.cumsum(delta[:-1]) > 0
        n_hit = B.per_doc(covered, woff)
        doc = np.searchsorted(woff, w, "right") - 1
        sets: dict[int, set] = {}
        for d, k in set(zip(doc.tolist(), pattern.tolist())):
            sets.setdefault(d, set()).update(machine.items[k])
        for d, s in sets.items():
            items[d] = sorted(s)
        for d in np.flatnonzero(n_hit).tolist():
            c = np.concatenate([[0], covered[woff[d] : woff[d + 1]].astype(np.int8), [0]])
            edge = np.diff(c)
            spans[d] = list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist()))
    return n_words, n_hit, items, spans


_MACHINES: dict = {}


def _machine(key, broadcast, n: int) -> Machine:
    if key not in _MACHINES:
        _MACHINES.clear()
        _MACHINES[key] = Machine(broadcast.value, n)
    return _MACHINES[key]


def _found_arrays(batch_col, machine: Machine) -> list[pa.Array]:
    parts = [search_slice(machine, data, off) for _, _, data, off in B.slices(batch_col)]
    cat = lambda i: np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64)
    span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    return [
        pa.array(cat(0), pa.int64()),
        pa.array(cat(1), pa.int64()),
        pa.array([x for p in parts for x in p[2]], pa.list_(pa.string())),
        pa.array([[{"first": a, "last": b} for a, b in x] for p in parts for x in p[3]], span),
    ]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    block, size = [], 0
    rows = benchmark.select(by_name(benchmark, item_col).cast("string"), by_name(benchmark, text_col).cast("string"))
    for item, text in rows.where(rows[1].isNotNull()).toLocalIterator():
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    yield block


def find_contamination(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids with occurring windows), spans (word ranges hit) per row.

    Only benchmark blocks of at most ``block_bytes`` of text are broadcast; a larger benchmark is
    searched in several passes whose spans are merged. Null or empty texts have no words and no
    hits; a null item id takes part in the hits but is not listed; repeated rows are each
    reported; an empty benchmark hits nothing; other columns are not read.
    """
    pairs = id_text(docs, id_col, text_col)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *FOUND.fields])
    passes = []
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def search(batches, shared=shared, key=key):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), *_found_arrays(batch.column(1), _machine(key, shared, window))], names=["doc_id", *FOUND.names])

        passes.append(search)
    if len(passes) == 1:
        return pairs.mapInArrow(B.tidy(passes[0]), schema)
    keyed = pairs.withColumn("text_hash", F.xxhash64("text"))
    out = None
    for search in passes:

        def with_hash(batches, search=search):
            for batch in batches:
                got = next(iter(search(iter([batch]))))
                yield pa.RecordBatch.from_arrays([*got.columns, batch.column(2)], names=[*got.schema.names, "text_hash"])

        one = keyed.mapInArrow(B.tidy(with_hash), T.StructType([*schema.fields, T.StructField("text_hash", T.LongType())]))
        out = one if out is None else out.unionByName(one)
    merged = out.groupBy("doc_id", "text_hash", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        (F.count(F.lit(1)) / len(passes)).cast("int").alias("copies"),
    )
    joined = F.aggregate(
        "spans", F.array().cast("array<struct<first:bigint,last:bigint>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["last"] + 1 >= x["first"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["last"], x["last"]).alias("last")))
            )
        ).otherwise(F.concat(acc, F.array(x))),
    )
    merged = merged.withColumn("spans", joined)
    merged = merged.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["last"] - x["first"] + 1))
    return merged.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("doc_id", *FOUND.names)


def decontaminated(
    spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The rows of docs, all columns as they were, in whose text no benchmark window occurs.

    Each block of patterns filters what the block before left, so no join is needed. Null and
    empty texts stay.
    """
    out = docs
    at = position(docs, text_col)
    for block in _blocks(benchmark, "item_id", "text", block_bytes):
        shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def clean(batches, shared=shared, key=key):
            for batch in batches:
                n_hit = _found_arrays(batch.column(at), _machine(key, shared, window))[1]
                yield batch.filter(pa.array(n_hit.to_numpy() == 0, pa.bool_()))

        out = out.mapInArrow(B.tidy(clean), docs.schema)
    return out


def digest_columns(found: DataFrame) -> DataFrame:
    """The contract's columns, from the operator's lists."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
