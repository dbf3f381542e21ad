"""Stupid-backoff scores from n-gram count tables partitioned by hash.

Texts are dealt into groups of some megabytes. Each group sends its distinct n-grams with their
counts to the partitions of the count table, which are ranges of the n-gram hash; a partition sums
what all groups sent and answers each group, in the order of its request, with the corpus counts
of the table. Answers are joined to their group's texts, whose n-grams are exploded again, take
their counts and are summed per document.

The relations are those of the SQL (n-grams, counts, tokens), but rows of one n-gram each would be
many times the input on disk (``relational_scores`` does it so, for small tables and tests). So a
row carries thousands: sorted hash arrays as compressed delta bytes, and a group's texts as one
compressed block, which is shuffled once and read by request and scoring.

    S(w | c) = count(c w) / count(c)           if the table keeps c w
             = 0.4 * S(w | shorter c)          otherwise
    S(w)     = count(w) / tokens

The table keeps n-grams of two or more words seen at least ``min_count`` times, and all words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import _batch as B
from weft.llm._shared import id_text, written

ORDER, MIN_COUNT, BACKOFF = 3, 2, 0.4
#: Bytes of text in a group, and n-grams in a partition of the count table.
GROUP_BYTES, PART_GRAMS = 5 << 20, 1 << 20
#: N-grams are told apart by so many bits more than their number has: a false match befalls one
#: in 2**SPARE_BITS of them at most, at every size (until all 64 bits are used, at 2**40 n-grams).
SPARE_BITS = 32


def pack(values: np.ndarray) -> bytes:
    """A sorted uint64 array as compressed byte planes of its differences."""
    d = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view("<u8").ravel(), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    """Counts as bytes, those from 255 on apart."""
    big = values >= 255
    small = np.where(big, 255, values).astype(np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(small.tobytes() + values[big].astype("<u8").tobytes())


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u8", -1, n).astype(np.int64)
    return out


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    s = np.sort(values)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(new)
    return s[at], np.diff(np.append(at, len(s)))


def grams(data: np.ndarray, off: np.ndarray, order: int, keep: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(word offsets per document, and for each n the hashes and the last-word positions of n-grams).

    Words are runs without ASCII white space, A-Z lower-cased.
    """
    low = B.lower_ascii(data)
    start, end, woff = B.words(low, off, B.is_word_bytes(data))
    wh = B.segment_hash(low, start, end)
    hashes, last = [], []
    for n in range(1, order + 1):
        win, _ = B.window_owner(woff, n)
        h = B.window_hash(wh, n)[win] if len(win) else np.zeros(0, np.uint64)
        hashes.append(B.mix(h + np.uint64(n * 0xE7037ED1A0B428DB % 2**64)) >> np.uint64(64 - keep))
        last.append(win + n - 1)
    return woff, hashes, last


BLOCK = "g bigint, ids binary, sizes binary, texts binary"


def _blocks(batches):
    """Texts as groups: a row for about GROUP_BYTES of text (a longer text is a group of its own)."""
    from pyspark import TaskContext

    part, n, size = TaskContext.get().partitionId(), 0, 0
    ids: list = []
    texts: list[bytes] = []

    def row():
        packer = zstandard.ZstdCompressor(level=3)
        known = np.array([i is not None for i in ids])
        key = np.array([0 if i is None else i for i in ids], "<i8").tobytes() + known.tobytes()
        sizes = np.array([len(t) for t in texts], "<i8").tobytes()
        blobs = [pa.array([packer.compress(x)], pa.binary()) for x in (key, sizes, b"".join(texts))]
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) + n], pa.int64()), *blobs], names=["g", "ids", "sizes", "texts"])

    for batch in batches:
        for lo, hi, data, off in B.slices(batch.column(1)):
            for i, t in zip(batch.column(0).slice(lo, hi - lo).to_pylist(), B.doc_bytes(data, off)):
                if texts and size + len(t) > GROUP_BYTES:
                    yield row()
                    ids, texts, size, n = [], [], 0, n + 1
                ids.append(i)
                texts.append(t)
                size += len(t)
    if texts:
        yield row()


def _unblocked(ids: bytes, sizes: bytes, texts: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(document ids, bytes, offsets) of a group."""
    opener = zstandard.ZstdDecompressor()
    size = np.frombuffer(opener.decompress(sizes), "<i8")
    raw = opener.decompress(ids)
    known = np.frombuffer(raw, bool, len(size), 8 * len(size))
    key = pa.array(np.frombuffer(raw, "<i8", len(size)), mask=~known)
    data = np.frombuffer(opener.decompress(texts), np.uint8) if size.sum() else np.zeros(0, np.uint8)
    return key, data, np.concatenate([[0], np.cumsum(size)])


def _rows(batch: pa.RecordBatch, *names: str):
    return zip(*(batch.column(n).to_pylist() for n in names))


def _requests(order: int, keep: int, bits: int):
    """g, p, h, c, n: each group's distinct n-grams and their counts, for each part of the table."""
    shift = np.uint64(keep - bits)

    def run(batches):
        for batch in batches:
            for k, (g,) in enumerate(_rows(batch, "g")):
                _, data, off = _unblocked(*next(_rows(batch.slice(k, 1), "ids", "sizes", "texts")))
                value, count = distinct(np.concatenate(grams(data, off, order, keep)[1]))
                cut = np.searchsorted((value >> shift).astype(np.int64), np.arange((1 << bits) + 1))
                parts = np.flatnonzero(np.diff(cut)).tolist()
                bounds = [(cut[p], cut[p + 1]) for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([g] * len(parts), pa.int64()), pa.array(parts, pa.int64()), pa.array([pack(value[a:b]) for a, b in bounds], pa.binary()),
                        pa.array([pack_counts(count[a:b]) for a, b in bounds], pa.binary()), pa.array([int(b - a) for a, b in bounds], pa.int64()),
                    ],
                    names=["g", "p", "h", "c", "n"],
                )

    return B.tidy(run)


def _answer(table: pa.Table) -> pa.Table:
    """Of one part of the table: the corpus counts of what each group asked for."""
    parts = [(g, unpack(h), unpack_counts(c, n)) for g, h, c, n in _rows(table, "g", "h", "c", "n")]
    value = np.concatenate([v for _, v, _ in parts])
    order = np.argsort(value)
    value = value[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    total = np.add.reduceat(np.concatenate([c for _, _, c in parts])[order], np.flatnonzero(new))
    back = np.empty(len(value), np.int64)
    back[order] = total[np.cumsum(new) - 1]
    out, lo = [], 0
    for _, v, _ in parts:
        out.append(pack_counts(back[lo : lo + len(v)]))
        lo += len(v)
    return pa.table({"g": pa.array([g for g, _, _ in parts], pa.int64()), "p": table.column("p"), "c": pa.array(out, pa.binary()), "n": table.column("n")})


def _scored(order: int, keep: int, min_count: int, backoff: float):
    """Documents of groups that are joined with their answers, in the order of p."""

    def one(block, answers) -> pa.RecordBatch:
        key, data, off = _unblocked(*block)
        woff, hashes, last = grams(data, off, order, keep)
        del data
        ends = np.cumsum([0, *(len(h) for h in hashes)])
        every = np.concatenate(hashes)
        del hashes
        place = np.argsort(every)
        every = every[place]
        new = np.ones(len(every), bool)
        new[1:] = every[1:] != every[:-1]
        count = np.concatenate([unpack_counts(x["c"], x["n"]) for x in answers]) if answers else np.zeros(0, np.int64)
        if len(count) != new.sum():
            raise ValueError("the answers do not fit the group's n-grams")
        found = np.empty(len(every), np.int64)
        found[place] = count[np.cumsum(new) - 1]
        of = [found[a:b] for a, b in zip(ends, ends[1:])]
        del every, place, new, count
        n_words = int(woff[-1])
        done = np.zeros(n_words, bool)
        logs = np.zeros(n_words)
        level = np.zeros(n_words, np.int64)
        best = np.minimum(np.arange(n_words) - np.repeat(woff[:-1], np.diff(woff)) + 1, order)
        for n in range(order, 0, -1):
            at, c = last[n - 1], of[n - 1]
            take = ~done[at]
            if n > 1:
                take &= c >= min_count
            at, c = at[take], c[take]
            steps = (best[at] - n) * np.log(backoff)
            if n > 1:
                context = np.zeros(n_words, np.int64)
                context[last[n - 2]] = of[n - 2]
                logs[at] = np.log(c) - np.log(context[at - 1]) + steps
            else:
                logs[at] = np.log(c) + steps  # less log(tokens), which the last step knows
            done[at], level[at] = True, n
        doc = np.repeat(np.arange(len(woff) - 1), np.diff(woff))
        k = len(woff) - 1
        return pa.RecordBatch.from_arrays(
            [
                key, pa.array(np.diff(woff), pa.int64()), pa.array(np.bincount(doc, level < best, k).astype(np.int64)),
                pa.array(np.bincount(doc, level == 1, k).astype(np.int64)), pa.array(np.bincount(doc, logs, k)),
            ],
            names=["doc_id", "n_tokens", "n_backoff", "n_word_level", "part"],
        )

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, sizes, texts, answers = next(_rows(batch.slice(k, 1), "ids", "sizes", "texts", "answers"))
                yield one((ids, sizes, texts), answers or [])

    return B.tidy(run)


def scores(
    spark: SparkSession, docs: DataFrame, *, order: int = ORDER, min_count: int = MIN_COUNT, backoff: float = BACKOFF,
    id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, n_backoff, log_score (natural), mean_log_score per row of docs.

    n_backoff counts tokens not scored at the highest order their place allows; with ``min_count``
    1 every n-gram of the corpus counts. Null and empty texts have no tokens, log_score 0 and a
    null mean; repeated rows count each and are each reported; an empty table gives an empty table.
    """
    rows = id_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(5, int(np.ceil(np.log2(max(1, size / 6 * order / PART_GRAMS)))))
    keep = min(64, max(40, SPARE_BITS + int(np.ceil(np.log2(max(2, size / 6 * order))))))
    # Partitions follow the input, whatever the session's number: some groups, or parts of the
    # count table, to each. Requests and scoring read one exchange of the groups.
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(least, size // (2 * GROUP_BYTES))
    groups = rows.mapInArrow(B.tidy(_blocks), BLOCK).repartition(n, "g")
    requests = groups.mapInArrow(_requests(order, keep, bits), "g bigint, p bigint, h binary, c binary, n bigint")
    answers = requests.repartition(max(least, (1 << bits) // 8), "p").groupBy("p").applyInArrow(_answer, "g bigint, p bigint, c binary, n bigint")
    by_group = answers.repartition(n, "g").groupBy("g").agg(F.array_sort(F.collect_list(F.struct("p", "c", "n"))).alias("answers"))
    parts = groups.join(by_group, "g", "left").mapInArrow(
        _scored(order, keep, min_count, backoff), "doc_id bigint, n_tokens bigint, n_backoff bigint, n_word_level bigint, part double"
    )
    log_score = F.col("part") - F.col("n_word_level") * F.lit(float(np.log(max(_tokens(rows), 1))))
    return parts.select(
        "doc_id", "n_tokens", "n_backoff", log_score.alias("log_score"),
        F.when(F.col("n_tokens") > 0, log_score / F.col("n_tokens")).alias("mean_log_score")
    )


def _tokens(rows: DataFrame) -> int:
    """All tokens of the corpus."""

    def count(batches):
        for batch in batches:
            n = sum(len(B.words(data, off, B.is_word_bytes(data))[0]) for _, _, data, off in B.slices(batch.column(0)))
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return rows.select("text").mapInArrow(B.tidy(count), "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def relational_scores(
    spark: SparkSession, docs: DataFrame, *, order: int = ORDER, min_count: int = MIN_COUNT, backoff: float = BACKOFF,
    id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``scores`` with an n-gram a row: exploded n-grams, a count table by hash, joins and sums.

    No packing and no hashes in place of words, at many times the disk. The same cases as ``scores``.
    """
    rows = written(
        spark,
        id_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("r", F.monotonically_increasing_id()),
        "rows"
    )
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = rows.select("r", F.regexp_extract_all(lower, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"))
    places = words.where(F.size("w") > 0).select("r", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
    gram = lambda i, n: F.when(i >= n, F.array_join(F.slice("w", i - n + 1, n), " "))
    at = places.select("r", "i", *(gram(F.col("i"), n).alias(f"g{n}") for n in range(1, order + 1)))
    every = at.select(F.explode(F.array(*(F.col(f"g{n}") for n in range(1, order + 1)))).alias("gram")).where("gram is not null")
    counts = written(spark, every.groupBy("gram").agg(F.count(F.lit(1)).alias("c")), "counts")
    total = at.count()
    for n in range(1, order + 1):
        at = at.join(counts.select(F.col("gram").alias(f"g{n}"), F.col("c").alias(f"c{n}")), f"g{n}", "left")
        # The context of an n-gram is the (n - 1)-gram that ends one word before.
        if n > 1:
            context = F.regexp_extract(f"g{n}", r"^(.*) [^ ]*$", 1)
            at = at.withColumn("x", context).join(counts.select(F.col("gram").alias("x"), F.col("c").alias(f"x{n}")), "x", "left").drop("x")
    best = F.least("i", F.lit(order))
    level, score = F.lit(1), F.log("c1") - F.log(F.lit(float(max(total, 1))))
    for n in range(2, order + 1):
        known = F.col(f"c{n}") >= min_count
        level, score = F.when(known, n).otherwise(level), F.when(known, F.log(f"c{n}") - F.log(f"x{n}")).otherwise(score)
    scored = at.select("r", (level < best).cast("long").alias("back"), (score + (best - level) * F.lit(float(np.log(backoff)))).alias("s"))
    sums = scored.groupBy("r").agg(F.count(F.lit(1)).alias("k"), F.sum("back").alias("b"), F.sum("s").alias("s"))
    zero = F.lit(0).cast("long")
    return rows.join(sums, "r", "left").select(
        "doc_id", F.coalesce("k", zero).alias("n_tokens"), F.coalesce("b", zero).alias("n_backoff"),
        F.coalesce("s", F.lit(0.0)).alias("log_score"), (F.col("s") / F.col("k")).alias("mean_log_score")
    )
