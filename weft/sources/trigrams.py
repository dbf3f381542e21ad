"""An inverted index of nodes by trigrams, for predicates that look for a text inside names and attributes.

A node whose texts hold a pattern, case and accents ignored, holds each of the pattern's trigrams. Nodes lie in gid
order in blocks, and a posting list names the blocks that hold a trigram: neighbours in gid order share most of theirs, so
there are far fewer postings than trigrams of nodes. The lists of a pattern are intersected, and the nodes of the blocks
that are left are tested by the predicate itself. What this cannot promise is not left to it: nodes with characters beyond
plain Latin are always tested, and patterns with such characters, or without a term of three letters, look at every node.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.plans.ast import Expr
from weft.plans.session import cut, stored
from weft.sources.placed import FEW, beside

#: A block has two to the power of so many nodes, one after the other in gid order.
BLOCK_BITS = 8


def _accented() -> tuple[str, str]:
    """Letters of the Latin blocks that are an ASCII letter with marks by canonical decomposition, and those letters."""
    pairs = [(chr(k), unicodedata.normalize("NFD", chr(k))) for k in range(0xC0, 0x250)]
    known = [(c, d[0]) for c, d in pairs if len(d) > 1 and d[0].isascii() and all(unicodedata.combining(x) for x in d[1:])]
    return "".join(c for c, _ in known), "".join(d for _, d in known)


ACCENTED, BARE = _accented()
_FOLD = str.maketrans(ACCENTED, BARE)


def folded(text: Column) -> Column:
    return F.lower(F.translate(text, ACCENTED, BARE))


def is_plain(text: Column) -> Column:
    """Whether the folded text says all that comparison without case and accents sees: printable ASCII."""
    return folded(text).rlike("^[ -~]*$")


def texts_of() -> Column:
    """Gid, attribute names and values of a node."""
    return F.concat(F.array("gid"), F.map_keys("attrs"), F.filter(F.map_values("attrs"), lambda v: v.isNotNull()))


def joined_texts() -> Column:
    """Folded texts of a node, a line break after each: no trigram of a pattern spans two."""
    return F.concat(folded(F.array_join(texts_of(), "\n")), F.lit("\n"))


def _grams(batches):
    """block, gram: the distinct trigrams of printable ASCII in each block's folded texts; a block may come in parts."""
    for batch in batches:
        block, texts = batch.column(0).to_numpy(), batch.column(1).cast(pa.large_binary())
        if not len(block):
            continue
        off = np.frombuffer(texts.buffers()[1], np.int64, len(block) + 1, texts.offset * 8)
        data = np.frombuffer(texts.buffers()[2], np.uint8)
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        of, codes = [], []
        for lo, hi in zip(edges, edges[1:]):
            c = data[off[lo] : off[hi]].astype(np.int32)
            if len(c) < 3:
                continue
            fine = (c >= 32) & (c <= 126)
            held = np.unique((c[:-2] << 16 | c[1:-1] << 8 | c[2:])[fine[:-2] & fine[1:-1] & fine[2:]])
            of.append(np.full(len(held), block[lo]))
            codes.append(held)
        if not of:
            continue
        code = np.concatenate(codes)
        chars = np.stack([code >> 16, code >> 8 & 255, code & 255], 1).astype(np.uint8)
        offsets = pa.py_buffer(np.arange(0, 3 * len(code) + 1, 3, dtype=np.int32))
        gram = pa.StringArray.from_buffers(len(code), offsets, pa.py_buffer(np.ascontiguousarray(chars)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(of), pa.int64()), gram], names=["block", "gram"])


def grams(pattern: str) -> set[str] | None:
    """Trigrams of a pattern; None if it has characters that the index does not fold."""
    low = pattern.translate(_FOLD).lower()
    if not all(" " <= c <= "~" for c in low):
        return None
    return {low[k : k + 3] for k in range(len(low) - 2)}


def needed(e: Expr) -> set[str]:
    """Trigrams that every node of a condition holds, whatever else it asks; empty if the index is no help."""
    value = (e.args.get("value") or "").strip() if e.kind == "text" else e.args.get("value") or ""
    if e.kind == "text":
        terms = [t for t in value.split(" ") if len(t) > 1]
        parts = [grams(t) for t in terms] if terms else [grams(value)]
        return set() if grams(value) is None else set().union(*(p or set() for p in parts))
    if e.kind in ("name", "attribute") and (e.args.get("operator") or "").lower() == "contains":
        return grams(value) or set()
    return set()


class TextIndex:
    """nodes(gid, attrs, block) by gid; postings(gram, block) by both; odd(gid, attrs, block)."""

    def __init__(self, nodes: DataFrame):
        in_order = nodes.select("gid", "attrs").repartitionByRange("gid").sortWithinPartitions("gid")
        # An id is the number of a range and the place in it, so what is left of it after the shift is a block of neighbours.
        self.nodes = stored(in_order.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)))
        self.odd = stored(self.nodes.where(~F.forall(texts_of(), is_plain)))
        lists = self.nodes.select("block", joined_texts().alias("texts")).mapInArrow(_grams, "block bigint, gram string")
        self.postings = stored(lists.repartition("gram").sortWithinPartitions("gram", "block"))

    def holding(self, wanted: set[str]) -> DataFrame:
        """Blocks that hold all the grams."""
        lists = self.postings.where(F.col("gram").isin(sorted(wanted))).distinct()
        return lists.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("block")

    def candidates(self, conditions: list[Expr]) -> DataFrame | None:
        """Nodes that may meet all the conditions, gid and attrs; None if the index rules out nothing."""
        wanted = set().union(*map(needed, conditions))
        if not wanted:
            return None
        blocks = cut(self.holding(wanted))
        size = blocks.count()
        if size <= FEW:
            near = self.nodes.where(F.col("block").isin([r["block"] for r in blocks.collect()]))
        else:
            near = self.nodes.join(beside(blocks, size), "block", "left_semi")
        held = near.where(reduce(Column.__and__, (F.contains(joined_texts(), F.lit(g)) for g in sorted(wanted)))).where(F.forall(texts_of(), is_plain))
        return held.unionByName(self.odd).select("gid", "attrs")
