"""Line dedup by pairwise alignment.

Lines are named by 64-bit hashes. Every block of enough words is covered by its least runs: for
each line the shortest run of lines of enough words that begins with it, and that which ends with
it. Documents that share such a run are candidates; each is paired with the earliest document that
holds the run, so a group of thousands of copies makes thousands of pairs, not millions, and every
block that some earlier document holds whole has its lines in one of the pairs. The two documents'
hash sequences are aligned by patience diff, again and again on what is left until nothing matches
(moved and repeated blocks are found too), and aligned blocks of enough words are deleted from
the later document.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import _batch as B
from weft.llm._shared import by_name, fresh, id_text, written

#: Words an aligned block needs to be deleted.
BLOCK_WORDS = 40
#: A run is hot when it stands more often than 1 / HOT_SHARE of the number of lines; there are at most 2 * HOT_SHARE such runs.
HOT_SHARE = 1000

LINES = "doc_id bigint, text_hash bigint, lines array<bigint>, words array<int>"


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and per line (split at \\n) its hash and its number of words."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, off in B.slices(batch.column(1)):
                feed = np.flatnonzero(data == 10)
                counts = B.per_doc(data == 10, off) + 1
                begin, end = np.sort(np.concatenate([off[:-1], feed + 1])), np.sort(np.concatenate([off[1:], feed]))
                start, _, _ = B.words(data, off, B.is_word_bytes(data))
                words = np.searchsorted(start, end) - np.searchsorted(start, begin)
                ends = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                h = B.segment_hash(data, begin, end).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.ListArray.from_arrays(ends, pa.array(h)),
                        pa.ListArray.from_arrays(ends, pa.array(words.astype(np.int32)))
                    ],
                    names=["doc_id", "text_hash", "lines", "words"],
                )

    rows = docs.where("text is not null").withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(B.tidy(run), LINES)


def least_runs(lines: np.ndarray, words: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, line behind, hash) of the shortest runs of ``least`` words from or up to each line; none crosses documents."""
    before = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
    k, n = np.arange(len(doc)), len(doc) + 1
    end = np.searchsorted(before, before[:-1] + least)
    start = np.searchsorted(before, before[1:] - least, "right") - 1
    ahead, back = end <= off[doc + 1], start >= off[doc]
    both = np.unique(np.concatenate([k[ahead] * n + end[ahead], start[back] * n + k[back] + 1]))
    at, to = both // n, both % n
    return at, to, B.segment_hash(np.ascontiguousarray(lines, np.int64).view(np.uint8), at * 8, to * 8).view(np.int64)


def run_table(lines: DataFrame, least: int) -> DataFrame:
    """doc (a struct of i and t) and h for each least run of lines of ``least`` words or more."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                col = part.column(2)
                off = np.asarray(col.offsets) - col.offsets[0].as_py()
                at, _, h = least_runs(np.asarray(col.flatten()), np.asarray(part.column(3).flatten()), off, least)
                owner = pa.array(np.searchsorted(off, at, "right") - 1)
                yield pa.RecordBatch.from_arrays([part.column(0).take(owner), part.column(1).take(owner), pa.array(h)], names=["i", "t", "h"])

    flat = lines.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("i"), F.col("text_hash").alias("t"), "lines", "words")
    return flat.mapInArrow(B.tidy(run), "i bigint, t bigint, h bigint").select(F.struct("i", "t").alias("doc"), "h")


def patience(a: list[int], b: list[int], pool: list[int]) -> list[tuple[int, int]]:
    """(position in a, position in b) of one alignment of a with the positions of b in pool."""
    in_b: dict[int, list[int]] = {}
    for j in pool:
        in_b.setdefault(b[j], []).append(j)
    in_a: dict[int, list[int]] = {}
    for i, h in enumerate(a):
        if h in in_b:
            in_a.setdefault(h, []).append(i)
    anchors = [(p[0], in_b[h][0]) for h, p in in_a.items() if len(p) == 1 and len(in_b[h]) == 1]
    if not anchors:  # nothing unique is shared: take the first places
        anchors = [(p[0], in_b[h][0]) for h, p in in_a.items()]
    anchors.sort()
    piles: list[int] = []
    tops: list[tuple] = []
    for i, j in anchors:
        k = bisect_left(piles, j)
        link = (i, j, tops[k - 1] if k else None)
        if k == len(piles):
            piles.append(j)
            tops.append(link)
        else:
            piles[k], tops[k] = j, link
    out: list[tuple[int, int]] = []
    link = tops[-1] if tops else None
    while link:
        out.append((link[0], link[1]))
        link = link[2]
    # Grow each anchor over equal neighbours.
    free, matched = set(pool), dict((j, i) for i, j in out)
    for i, j in out:
        for step in (-1, 1):
            x, y = i + step, j + step
            while 0 <= x < len(a) and 0 <= y < len(b) and y in free and y not in matched and a[x] == b[y]:
                matched[y] = x
                x, y = x + step, y + step
    return sorted((i, j) for j, i in matched.items())


def aligned_lines(earlier: list[int], later: list[int], words: list[int], least: int = BLOCK_WORDS) -> list[int]:
    """Positions of ``later`` inside aligned common blocks of at least ``least`` words."""
    out: set[int] = set()
    known = set(earlier)
    pool = both = [j for j, h in enumerate(later) if h in known]
    while pool:
        pairs = patience(earlier, later, pool)
        if not pairs:
            break
        pairs.sort(key=lambda p: p[1])
        run: list[int] = []
        last = None
        for i, j in [*pairs, (-9, -9)]:
            if last is not None and (i, j) != (last[0] + 1, last[1] + 1):
                if sum(words[k] for k in run) >= least:
                    out.update(run)
                run = []
            run.append(j)
            last = (i, j)
        done = {j for _, j in pairs}
        pool = [j for j in pool if j not in done]
    # Repeated lines may be aligned elsewhere and split a block: its least runs are then looked up.
    if sum(words[j] for j in both) >= least and not out.issuperset(both):
        size = dict(zip(later, words))
        one = lambda h, w: least_runs(np.array(h, np.int64), np.array(w, np.int64), np.array([0, len(h)]), least)
        _, _, held = one(earlier, [size.get(h, 0) for h in earlier])
        at, to, runs = one(later, words)
        found = np.isin(runs, held)
        for x, y in zip(at[found].tolist(), to[found].tolist()):
            out.update(range(x, y))
    return sorted(out)


def deletions(spark: SparkSession, docs: DataFrame, *, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(line table, doc_id + text_hash + positions to delete) of id_text-shaped docs.

    The earlier of two documents is that of lesser (doc_id, text_hash), null ids first; rows
    with equal id and text are one document.
    """
    lines = written(spark, line_table(docs), "lines")
    me = F.struct(F.coalesce("doc_id", F.lit(-(2**63))).alias("i"), F.col("text_hash").alias("t"))
    places = run_table(lines, block_words)
    firsts = written(
        spark,
        places.groupBy("h").agg(
            F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n")
        ).where(F.col("first") != F.col("last")).drop("last"),
        "run-firsts", small=True
    )
    total = lines.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    # Hot runs are few by their definition and go by broadcast; all others are joined by hash.
    is_hot = F.col("n") * HOT_SHARE > F.lit(total)
    hot = places.join(F.broadcast(firsts.where(is_hot).select("h", "first")), "h")
    cold = places.join(firsts.where(~is_hot).select("h", "first"), "h")
    pairs = hot.unionByName(cold).where(F.col("doc") != F.col("first")).select("doc", "first").distinct()
    own = lines.dropDuplicates(["doc_id", "text_hash"]).select(me.alias("doc"), "doc_id", "text_hash", F.col("lines").alias("later"), "words")
    first = lines.dropDuplicates(["doc_id", "text_hash"]).select(me.alias("first"), F.col("lines").alias("earlier"))
    both = pairs.join(own, "doc").join(first, "first").select("doc_id", "text_hash", "earlier", "later", "words")

    def align(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [aligned_lines(a, b, w, block_words) for a, b, w in zip(*(part.column(k).to_pylist() for k in (2, 3, 4)))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "text_hash", "at"])

    found = both.mapInArrow(B.tidy(align), "doc_id bigint, text_hash bigint, at array<int>").where(F.size("at") > 0)
    return lines, found.groupBy("doc_id", "text_hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"))


def report(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_lines, n_deleted, deleted_at, words_deleted for every row.

    Null texts have no lines; an empty text has one empty line; repeated rows are each reported
    alike; ties between documents go by id, then by text hash.
    """
    rows = id_text(docs, id_col, text_col)
    lines, gone = deletions(spark, rows, block_words=block_words)
    d = gone.select(F.col("doc_id").alias("gi"), F.col("text_hash").alias("gt"), "at")
    got = lines.join(d, F.col("doc_id").eqNullSafe(F.col("gi")) & (F.col("text_hash") == F.col("gt")), "left")
    at = F.coalesce("at", F.array().cast("array<int>"))
    out = got.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.size(at).cast("long").alias("n_deleted"), at.alias("deleted_at"),
        F.aggregate(at, F.lit(0).cast("long"), lambda s, k: s + F.get("words", k)).alias("words_deleted")
    )
    zero = F.lit(0).cast("long")
    none = rows.where("text is null").select(
        "doc_id", zero.alias("n_lines"), zero.alias("n_deleted"), F.array().cast("array<int>").alias("deleted_at"),
        zero.alias("words_deleted")
    )
    return out.unionByName(none)


def deduplicated(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with the aligned blocks cut from the later documents' texts; all other columns stay.

    A document that had words and has none left is wholly contained in earlier ones and goes.
    An integer column ``n_chars`` is set to the new length where the text changed. Null texts stay
    as they are; the earlier of two documents is that of lesser id, null ids first, and of equal
    ids that of lesser text hash; repeated rows are cut alike.
    """
    _, gone = deletions(spark, id_text(docs, id_col, text_col), block_words=block_words)
    i, t, at, keep = fresh(docs, "id", "hash", "at", "left")
    d = gone.select(F.col("doc_id").alias(i), F.col("text_hash").alias(t), F.col("at").alias(at))
    text = by_name(docs, text_col).cast("string")
    joined = docs.join(d, by_name(docs, id_col).cast("long").eqNullSafe(d[i]) & (F.xxhash64(text) == d[t]), "left")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, k: ~F.array_contains(F.col(at), k)), "\n")
    joined = joined.withColumn(keep, F.when(F.col(at).isNotNull(), left))
    joined = joined.where(F.col(keep).isNull() | F.col(keep).rlike(r"[^\x20\x09-\x0D]"))
    cols = []
    for c, kind in docs.dtypes:
        if c.lower() == text_col.lower():
            cols.append(F.coalesce(F.col(keep), by_name(docs, c)).alias(c))
        elif c.lower() == "n_chars" and kind in ("int", "bigint"):
            cols.append(F.when(F.col(keep).isNotNull(), F.length(keep).cast(kind)).otherwise(by_name(docs, c)).alias(c))
        else:
            cols.append(by_name(docs, c))
    return joined.select(*cols)
