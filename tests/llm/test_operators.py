"""The ten operators against brute force, the reference libraries, SQL and planted cases."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weft.llm import _batch as B
from weft.llm import _stats as S
from weft.llm import dart_minhash, decontaminate, gbt, html_diff, line_dedup, ngram_lm, quality_classifier, quality_rules, queries, sp_codec, token_counts, token_store
from weft.llm.word_cache import WordEncoder

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD_BPE, PIECE_BPE = queries.tokenizer_file("word_bpe_49k.json"), queries.tokenizer_file("piece_bpe_32k.model")
#: Null, empty, blank and odd texts, a very long one, repeated rows, a repeated id, a null id.
EDGES = [(1, None), (2, ""), (3, "  \n\t "), (4, "One two\nthree."), (4, "One two\nthree."), (4, "another text of the same id"), (None, "no id at all"), (5, "long " * 30000), (6, "é ́ 日本語 🙂 <s> a\r\nb <|endoftext|> x▁y"), (7, "a  b   c ")]


def documents(spark, rows, extra=False):
    df = spark.createDataFrame([(i, t, "en", f"src{k}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    if extra:  # names that operators use inside
        for c in ("digest", "text_hash", "n_tokens", "at", "doc", "__id", "g", "items", "score"):
            df = df.withColumn(c, df["source"])
    return df


def empty(spark):
    return documents(spark, []).limit(0)


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


# 1


def brute_hits(text, items, n=10):
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in s or ""))
    w, hit, found = words(text), set(), set()
    for item, s in items:
        iw = words(s)
        for i in range(max(1, len(iw) - n + 1) if iw else 0):
            win = iw[i : i + n]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit.update(range(j, j + len(win)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination_equals_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{k}" for k in range(30)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, text(r.choice([1, 3, 9, 10, 14]))) for k in range(40)] + [(99, None), (98, "..."), (97, "É1 naïve")]
    docs = [(k, text(r.randrange(80))) for k in range(30)] + [(50, items[4][1]), (51, "X, " + items[7][1].upper() + "!"), (52, "é1-naïve É1 NAïVE")] + EDGES
    bench = spark.createDataFrame(items, "item_id int, text string")
    for block in (1 << 20, 60):
        got = decontaminate.find_contamination(spark, documents(spark, docs, True), bench, block_bytes=block).collect()
        key = lambda x: (x[0] is None, x[0] or 0, *map(str, x[1:]))
        want = sorted(((i, *brute_hits(t, items)) for i, t in docs), key=key)
        assert sorted(((x["doc_id"], x["n_words"], x["n_hit"], x["items"]) for x in got), key=key) == want
        assert all(sum(s["last"] - s["first"] + 1 for s in x["spans"]) == x["n_hit"] for x in got)
    clean = decontaminate.decontaminated(spark, documents(spark, docs, True), bench)
    assert sorted(str(x["doc_id"]) for x in clean.collect()) == sorted(str(i) for i, t in docs if not brute_hits(t, items)[1])
    assert decontaminate.find_contamination(spark, empty(spark), bench).count() == 0
    none = decontaminate.find_contamination(spark, documents(spark, docs), bench.limit(0))
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(docs)


# 2, 3, 8


def library_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(WORD_BPE).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_short_items_at_the_end_of_the_last_document():
    for item in ("yes", "42", "x", "\u4e2d"):
        machine = decontaminate.Machine([("a", item)], 10)
        for texts in ([item], ["other words", item], [item, "no"]):
            data = np.frombuffer("".join(texts).encode(), np.uint8)
            off = np.cumsum([0, *(len(t.encode()) for t in texts)])
            _, n_hit, items, _ = decontaminate.search_slice(machine, data, off)
            assert n_hit.tolist() == [int(t == item) for t in texts] and [x != [] for x in items] == [t == item for t in texts]


def test_word_encoder_equals_library(spark):
    texts = [t for _, t in EDGES] + ["ABC.. x,, don't it's We'll 12a3. <|STARTOFTEXT|>. <|startoftext|>. ÀÉ! İx ﬁ ǅ Ω. ΑΣ. \x01 a\x01b", "\x1c a \x85b c"] + [x["text"] for x in table(spark, "documents").select("text").collect()]
    got = WordEncoder(WORD_BPE).encode([(t or "").encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == library_ids(texts)


def test_token_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_store(spark, documents(spark, EDGES, True), WORD_BPE, path, buckets=3)
    got = sorted(token_store.read_store(spark, path).collect(), key=lambda x: x["start"])
    keys = [(-1 if x["doc_id"] is None else x["doc_id"]) for x in got]
    assert keys == sorted(keys) and len(got) == len(EDGES)
    want = Counter((i, tuple(ids + [2])) for (i, _), ids in zip(EDGES, library_ids([t for _, t in EDGES])))
    assert Counter((x["doc_id"], tuple(np.frombuffer(bytes(x["ids"]), "<u4").tolist())) for x in got) == want
    run = 0
    for x in got:
        assert x["start"] == run and x["ids_crc32"] == zlib.crc32(bytes(x["ids"])) and x["n_tokens"] == len(x["ids"]) // 4
        run += x["n_tokens"]
    assert token_store.read_document(spark, path, 7) == [library_ids(["a  b   c "])[0] + [2]]
    assert len(token_store.read_document(spark, path, 4)) == 3
    token_store.write_store(spark, empty(spark), WORD_BPE, path + "-empty")
    assert token_store.read_store(spark, path + "-empty").count() == 0


def test_token_store_splits_a_frequent_id(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [(k, f"text {k}") for k in range(60)] + [(30, f"again {k % 3}") for k in range(300)]
    token_store.write_store(spark, documents(spark, rows), WORD_BPE, path, buckets=9)
    shards = spark.read.parquet(f"{path}/shards").collect()
    assert len({x["bucket"] for x in shards if 30 in x["doc_ids"]}) >= 5 and max(len(x["doc_ids"]) for x in shards) < 100
    got = sorted(token_store.read_store(spark, path).collect(), key=lambda x: x["start"])
    assert [x["doc_id"] for x in got] == sorted(i for i, _ in rows)
    assert [x["start"] for x in got] == np.cumsum([0, *(x["n_tokens"] for x in got)])[:-1].tolist()
    assert len(token_store.read_document(spark, path, 30)) == 301


def test_token_store_splits_rows_without_an_id(spark, tmp_path):
    rows = [(None, f"no id {k}") for k in range(300)] + [(k, f"text {k}") for k in range(-20, 20)]
    token_store.write_store(spark, documents(spark, rows).repartition(3), WORD_BPE, str(tmp_path / "s"), buckets=8)
    shards = spark.read.parquet(str(tmp_path / "s" / "shards")).orderBy("bucket", "shard").collect()
    held = [sum(i is None for i in x["doc_ids"]) for x in shards]
    assert sum(held) == 300 and max(held) < 120 and sum(n > 0 for n in held) > 3
    ids = [i for x in shards for i in x["doc_ids"]]
    assert ids == [None] * 300 + list(range(-20, 20))


def test_token_counts_use_the_cache(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    rows = EDGES + [(8, "One two\nthree.")]
    want = Counter((i, len((t or "").encode()), len(ids)) for (i, t), ids in zip(rows, library_ids([t for _, t in rows])))
    got = token_counts.token_counts(spark, documents(spark, rows, True), WORD_BPE, cache_path=path)
    assert Counter(map(tuple, got.collect())) == want
    assert token_counts.read_cache(spark, path).count() == len({t or "" for _, t in rows})
    # Another table: only its one new text is added; a second tokenizer has counts of its own.
    again = token_counts.token_counts(spark, documents(spark, rows + [(9, "brand new")]), WORD_BPE, cache_path=path)
    assert again.count() == len(rows) + 1 and token_counts.read_cache(spark, path).count() == len({t or "" for _, t in rows}) + 1
    pieces = token_counts.token_counts(spark, documents(spark, [(1, "Hello  world")]), PIECE_BPE, cache_path=path)
    import sentencepiece

    assert pieces.first()["n_tokens"] == len(sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE).encode("Hello  world"))
    assert token_counts.token_counts(spark, empty(spark), WORD_BPE).count() == 0


def test_sentencepiece_parity_and_round_trip(spark):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    rows = EDGES + [(20 + k, t) for k, t in enumerate([" ", " a ", "\n", "a\n b\n\n  c", "▁▁ x", "aaaaaaa " * 5, "     ", "\u0000x"])] + [tuple(x) for x in table(spark, "documents").select("doc_id", "text").collect()]
    codec = sp_codec.Codec(PIECE_BPE)
    got = codec.encode([(t or "").encode() for _, t in rows])
    assert [np.frombuffer(x, "<u4").tolist() for x, _ in got] == [lib.encode(t or "") for _, t in rows]
    assert codec.verified > 0 and not codec.differing and all(ok for _, ok in got)
    out = sp_codec.encode_decode(documents(spark, rows, True), PIECE_BPE).collect()
    assert len(out) == len(rows) and all(x["parity"] for x in out)
    assert all(x["round_trip"] or x["doc_id"] in (6, 24) for x in out)  # a literal marker decodes as a space
    assert sp_codec.encode_decode(empty(spark), PIECE_BPE).count() == 0


class Off:
    """A backend that makes another id of each piece ``e``."""

    def __init__(self, inner, one, other):
        self.inner, self.one, self.other = inner, one, other

    def encode_batch_fast(self, texts, add_special_tokens):
        from types import SimpleNamespace

        return [SimpleNamespace(ids=[self.other if i == self.one else i for i in x.ids]) for x in self.inner.encode_batch_fast(texts, add_special_tokens=add_special_tokens)]


def test_sentencepiece_ids_come_from_the_backend():
    codec = sp_codec.Codec(PIECE_BPE)
    lib = codec.check
    one, other = lib.piece_to_id("▁the"), lib.piece_to_id("▁of")
    codec.tokenizer = Off(codec.tokenizer, one, other)
    texts = ["in the end", "no such word", "a ▁ the", ""]
    got = codec.encode([t.encode() for t in texts])
    assert [ok for _, ok in got] == [False, True, False, True] and codec.differing == {b"the"}
    assert [np.frombuffer(x, "<u4").tolist() for x, _ in got] == [[other if i == one else i for i in lib.encode(t)] for t in texts]


def proto_field(n, kind, data):
    return bytes([n << 3 | kind]) + data


def proto_block(n, data):
    size, out = len(data), b""
    while size > 127:
        out, size = out + bytes([size & 127 | 128]), size >> 7
    return proto_field(n, 2, out + bytes([size]) + data)


def unigram_file(path, pieces, squeeze):
    """A SentencePiece file of a unigram model with byte fallback."""
    import struct

    field, block = proto_field, proto_block
    body = b"".join(block(1, block(1, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    body += block(2, field(3, 0, b"\x01") + bytes([35 << 3 & 127 | 128, 35 << 3 >> 7]) + b"\x01")
    body += block(3, block(1, b"identity") + field(3, 0, b"\x01") + field(4, 0, bytes([squeeze])) + field(5, 0, b"\x01"))
    path.write_bytes(body)
    return str(path)


def test_unigram_model_over_the_table(spark, tmp_path):
    """The pieces of the BPE file under unigram scores, over all documents."""
    import sentencepiece

    with open(PIECE_BPE, "rb") as f:
        pieces = [(p, -1.0 - np.log(k + 1.37) if kind == sp_codec.NORMAL else s, kind) for k, (p, s, kind) in enumerate(sp_codec.Model(f.read()).pieces)]
    for squeeze in (0, 1):
        path = unigram_file(tmp_path / f"u{squeeze}.model", pieces, squeeze)
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        rows = EDGES + [tuple(x) for x in table(spark, "documents").select("doc_id", "text").collect()]
        out = sp_codec.encode_decode(documents(spark, rows), path).collect()
        known = Counter((i, tuple(lib.encode(t or ""))) for i, t in rows)
        other = [x for x in out if (x["doc_id"], tuple(x["ids"])) not in known]
        assert [x for x in out if not x["parity"]] == other and len(other) < 0.03 * len(rows)
        text, points = dict((i, t) for i, t in rows), [s for _, s, _ in pieces]
        for x in other:  # another cut of the same score
            theirs = lib.encode(text[x["doc_id"]])
            assert lib.decode(list(x["ids"])) == lib.decode(theirs) and abs(sum(points[i] for i in x["ids"]) - sum(points[i] for i in theirs)) < 1e-2


def test_unigram_model_is_rebuilt(tmp_path):
    """A small hand-made unigram model with byte fallback, against the reference library."""
    import sentencepiece

    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{b:02X}>", -20.0, 6) for b in range(256)] + [("▁", -3.0, 1), ("▁he", -2.0, 1), ("llo", -2.5, 1), ("l", -4.0, 1), ("o", -4.1, 1), ("h", -5.0, 1), ("e", -5.1, 1)]
    path = unigram_file(tmp_path / "small.model", pieces, 1)
    lib, codec = sentencepiece.SentencePieceProcessor(model_file=path), sp_codec.Codec(path)
    texts = ["hello", "  hello   hello ", "hellö hole", "", " "]
    assert [(np.frombuffer(x, "<u4").tolist(), ok) for x, ok in codec.encode([t.encode() for t in texts])] == [(lib.encode(t), True) for t in texts]


# 4, 10


def brute_stats(x):
    ws, seen, dup = re.findall(r"[^\x20\x09-\x0D]+", x), set(), 0
    for line in x.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
        seen.add(line)
    count, cover = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4)), set()
    for i in range(len(ws) - 4):
        if count[tuple(ws[i : i + 5])] > 1:
            cover.update(range(i, i + 5))
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(cover)


def test_quality_rules(spark):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    rules = quality_rules.train(docs, labels)
    rows = EDGES + [(30, "a b c d e f a b c d e g\nx\nx\n\n\n" * 2)] + [tuple(x) for x in docs.select("doc_id", "text").collect()]
    got = quality_rules.judge(documents(spark, rows, True), rules).collect()
    want = Counter((i, *brute_stats(t or "")) for i, t in rows)
    assert Counter((x["doc_id"], *(x[k] for k in S.BASE)) for x in got) == want
    assert all(x["base_failed"] == (x["n_words"] < 10 or 100 * x["n_repeat_words"] > 20 * x["n_words"]) and not (x["kept"] and x["base_failed"]) for x in got)
    kept = quality_rules.kept_rows(documents(spark, rows, True), rules)
    assert sorted(str(x["doc_id"]) for x in kept.collect()) == sorted(str(x["doc_id"]) for x in got if x["kept"])
    good = {x["doc_id"]: x["quality"] for x in labels.collect()}
    of = {x["doc_id"]: x for x in got}
    clean = [i for i, q in good.items() if q == 1 and not of[i]["base_failed"]]
    assert sum(of[i]["kept"] for i in clean) >= 0.97 * len(clean)
    assert sum(of[i]["kept"] for i, q in good.items() if q == 0) <= 0.2 * sum(q == 0 for q in good.values())
    none = quality_rules.train(docs, labels.limit(0))
    assert all(x["kept"] != x["base_failed"] for x in quality_rules.judge(docs, none).collect())
    assert quality_rules.judge(empty(spark), rules).count() == 0


def test_quality_rules_are_fitted_on_every_labelled_row(spark):
    """More rows than the 20,000 that fits were once bounded to; the same bits as one block of all rows, however they are spread."""
    n = 21_000
    noise = F.when(F.expr("pmod(hash(id, 5), 10) = 0"), F.expr("1 - pmod(hash(id), 2)")).otherwise(F.expr("pmod(hash(id), 2)"))
    text = F.expr("concat('one two three four five six seven eight nine ten ', repeat('Ab! ', int(pmod(hash(id, 1), 9) * (1 - pmod(hash(id), 2)))), repeat('0', int(pmod(hash(id, 2), 30))), ' end ', id)")
    docs, labels = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text")), spark.range(n).select(F.col("id").alias("doc_id"), noise.cast("int").alias("quality"))
    rows = quality_rules.labelled(quality_rules.statistics(docs), labels, "quality").toPandas()
    names, x = S.ratios({k: rows[k].to_numpy() for k in S.COLUMNS})
    y, fold, cuts = rows["y"].to_numpy(), rows["fold"].to_numpy(), gbt.cuts_of(x)
    assert len(rows) == n and 0 < y.sum() < n and set(fold) == set(range(quality_rules.FOLDS))
    counts = [(int((fold != k).sum()), int(y[fold != k].sum())) for k in range(quality_rules.FOLDS + 1)]
    held = gbt.InMemory(gbt.block(x, y, fold, cuts, [gbt.base_value(*c) for c in counts]))
    forests = gbt.boost(held, cuts, counts, [quality_rules.MONOTONE.get(k, 0) for k in names])
    rules = quality_rules.train(docs.repartition(7), labels)
    for k in ("feature", "threshold", "left", "right", "value", "roots", "base"):
        assert np.array_equal(getattr(rules.forest, k), getattr(forests[-1], k)), k
    out = np.zeros(n)
    for k, forest in enumerate(forests[:-1]):
        out[fold == k] = forest.score(x[fold == k])
    good = np.sort(out[y == 1])
    exact = good[int((1 - quality_rules.KEEP_GOOD) * len(good))]
    assert exact < 0.5 and exact * (1 - 2**-12) < rules.threshold <= exact


def test_kept_equals_a_walk_over_the_trees(spark):
    """Scores and verdicts against one document at a time, walked from each root to its leaf."""
    docs = table(spark, "documents")
    rules = quality_rules.train(docs, table(spark, "labels"))
    f, rows = rules.forest, EDGES + [tuple(x) for x in docs.select("doc_id", "text").collect()]

    def score(features):
        total = f.base
        for root in f.roots:
            at = root
            while f.left[at] != at:
                at = f.left[at] if features[f.feature[at]] <= f.threshold[at] else f.right[at]
            total += f.value[at]
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, total))))

    want = Counter()
    for i, t in rows:
        data = np.frombuffer((t or "").encode(), np.uint8)
        points = score(S.ratios(S.document_stats(data, np.array([0, len(data)])))[1][0])
        n_words, _, _, _, n_repeat = brute_stats(t or "")
        want[(i, round(points, 9), n_words >= 10 and 100 * n_repeat <= 20 * n_words and points >= rules.threshold)] += 1
    assert len(f.roots) == 60 and len({k[1] for k in want}) > 10  # the trees tell documents apart
    assert Counter((x["doc_id"], round(x["score"], 9), x["kept"]) for x in quality_rules.judge(documents(spark, rows, True), rules).collect()) == want


def test_trees_keep_monotonic_constraints():
    r = np.random.default_rng(1)
    x = r.random((2000, 3))
    y = (x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.2 * r.random(2000) > 0.7).astype(float)
    forest = gbt.fit(x, y, [1, 0, -1])
    grid, rest = np.linspace(0, 1, 60), r.random((40, 3))
    for j, sign in ((0, 1), (2, -1)):
        for row in rest:
            m = np.tile(row, (60, 1))
            m[:, j] = grid
            assert (np.diff(forest.raw(m)) * sign >= -1e-9).all()
    assert ((forest.score(x) > 0.5) == y).mean() > 0.9


def test_quality_classifier_on_held_out_rows(spark):
    sf = SF.replace("sf0.001", "sf0.01") if os.path.isdir(SF.replace("sf0.001", "sf0.01")) else SF
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_classifier.fit(quality_classifier.with_features(docs), labels)
    got = {x["doc_id"]: x for x in quality_classifier.scored(quality_classifier.with_features(docs), model).collect()}
    held = [(got[x["doc_id"]], x["quality"]) for x in labels.collect() if zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1]
    assert all(x["held_out"] for x, _ in held) and np.mean([x["predicted"] == q for x, q in held]) > 0.95
    flipped = labels.withColumn("quality", 1 - labels["quality"]).where("crc32(cast(doc_id as string)) % 3 = 1")
    other = quality_classifier.fit(quality_classifier.with_features(docs), labels.where("crc32(cast(doc_id as string)) % 3 <> 1").unionByName(flipped))
    assert np.allclose(other.mean, model.mean)  # held-out labels change nothing
    edge = quality_classifier.scored(quality_classifier.with_features(documents(spark, EDGES, True)), model).collect()
    assert len(edge) == len(EDGES) and all(0 <= x["score"] <= 1 for x in edge)
    assert quality_classifier.scored(quality_classifier.with_features(empty(spark)), model).count() == 0
    # Labels of one class, or none: the prior decides, alike for all.
    for one, sign in ((labels.where("quality = 1"), 1), (labels.where("quality = 0"), -1), (labels.limit(0), 0)):
        m = quality_classifier.fit(quality_classifier.with_features(docs), one)
        assert np.sign(np.round(m.odds, 9)) == sign
        assert {round(x["score"], 9) for x in quality_classifier.scored(quality_classifier.with_features(docs.limit(20)), m).collect()} == {round(float(1 / (1 + np.exp(-2 * sign * np.sqrt(abs(m.odds))))), 9)}


def test_quality_classifier_equals_brute_force(spark):
    """Means, covariances and log odds from all rows at once; sums do not depend on partitions."""
    docs, labels = table(spark, "documents"), table(spark, "labels")
    feats = quality_classifier.with_features(docs)
    model = quality_classifier.fit(feats, labels)
    again = quality_classifier.fit(feats.repartition(13), labels.repartition(5))
    assert (model.mean == again.mean).all() and (model.covariance == again.covariance).all()
    of = {x["doc_id"]: x["quality"] for x in labels.collect() if zlib.crc32(str(x["doc_id"]).encode()) % 3 != 1}
    rows = [(x["doc_id"], x["x"]) for x in feats.collect()]
    x = [np.array([v for i, v in rows if of.get(i) == k]) for k in (0, 1)]
    cov = [np.cov(a.T, bias=True) for a in x]
    both = sum(len(a) * c for a, c in zip(x, cov)) / sum(map(len, x))
    cov = [0.6 * c + 0.3 * both + 0.1 * np.diag(np.diag(both)) + 1e-4 * np.eye(len(both)) for c in cov]
    every = np.array([v for _, v in rows])
    log_density = []
    for a, c in zip(x, cov):
        d = every - a.mean(0)
        log_density.append(-0.5 * np.einsum("ij,ij->i", d @ np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1])
    want = log_density[1] - log_density[0] + np.log((len(x[1]) + 1) / (len(x[0]) + 1))
    assert np.allclose(model.gap(every), want, rtol=1e-3, atol=0.05)


# 5


def test_page_differencing(spark):
    page = lambda title, body, menu="": f"<html><head><title>t</title><script>x('</p>')</script></head><body><nav><a>Home</a></nav><div class='ad'>Buy {title}</div><article><h1>{title}</h1>{body}</article><div id='comments'><p>nice</p></div><footer>&copy; site</footer></body></html>"
    bare = lambda title, *ps: "<body><div>Site name</div><p>About us</p>" + f"<h2>{title}</h2>" + "".join(f"<p>{p}</p>" for p in ps) + "<div>Imprint &amp; contact</div>"
    rows = [
        (1, "http://a.org/en/1", page("T1", "<p><b>One &amp; two<br>\n three<p>Four")), (2, "http://a.org/en/1?copy", page("T1", "<p><b>One &amp; two<br>\n three<p>Four")),
        (3, "http://b.org/x/1", bare("First", "Own words of the first.", "More of it.")), (4, "http://b.org/x/2", bare("Second", "Own words of the second.")), (5, "http://b.org/x/2#top", bare("Third", "Third text.")),
        (6, "http://c.org/alone", bare("Lonely", "Nothing beside it.")), (7, None, None), (8, "http://d.org/", ""), (9, "http://e.org/", "<p>unclosed <b>bold <i>both</p><!-- <p>no</p> --><style>p{}</style>tail"), (9, "http://e.org/", "<p>unclosed <b>bold <i>both</p><!-- <p>no</p> --><style>p{}</style>tail"),
    ]
    df = spark.createDataFrame([(*x, "z") for x in rows], "page_id long, url string, html string, host string").repartition(1)
    got = defaultdict(list)
    for x in html_diff.extract(df).collect():
        assert x["n_chars"] == len(x["text"])
        got[x["page_id"]].append(x["text"])
    assert got[1] == got[2] == ["T1\n\nOne & two three\n\nFour"]
    assert got[3] == ["First\n\nOwn words of the first.\n\nMore of it."] and got[4] == ["Second\n\nOwn words of the second."] and got[5] == ["Third\n\nThird text."]
    assert got[6] == ["Site name\n\nAbout us\n\nLonely\n\nNothing beside it.\n\nImprint & contact"] and got[7] == got[8] == [""]
    assert got[9] == ["unclosed bold both\n\ntail"] * 2
    assert html_diff.extract(df.limit(0)).count() == 0


def test_page_differencing_decides_outside_articles(spark):
    page = lambda k: f"<body><div>Site name</div><p>Lead {k}</p><article><h1>T{k}</h1><p>Text {k}, long enough to be its own.</p><p>Same closing words.</p></article><div>Second column {k}</div><div>Imprint</div></body>"
    rows = [(k, f"http://a.org/{k}", page(k)) for k in range(1, 4)] + [(4, "http://a.org/4", page(3))]  # the last is a copy
    got = {x["page_id"]: x["text"] for x in html_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)).collect()}
    want = lambda k: f"Lead {k}\n\nT{k}\n\nText {k}, long enough to be its own.\n\nSame closing words.\n\nSecond column {k}"
    assert got == {1: want(1), 2: want(2), 3: want(3), 4: want(3)}


def test_copies_without_markup_lose_their_template(spark):
    page = lambda k: "<body><div>Site name</div>" + f"<p>Own words of page {k}. " + f"word{k} " * 20 + "</p><div>Imprint and contact</div>"
    rows = [(k, f"http://a.org/{k}", page(min(k, 3))) for k in range(1, 6)]
    got = {x["page_id"]: x["text"] for x in html_diff.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)).collect()}
    assert all(x.startswith("Own words") and "Imprint" not in x for x in got.values()) and got[3] == got[4] == got[5]


def planted_site(r, host, n, nodes):
    """Pages of one host whose articles are known: menus, adverts, boxes and footers have other words on each page."""
    words = lambda k: " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(k))
    style, box, out = r.choice(["x9k", "zone-7", "qq"]), r.choice(["article", "main", "div class='social-science'", "div class='content related-work'", "div id='search-results-article'", "div class='ad-free'", "section"]), []
    for k in range(n):
        own = [words(r.randint(1, 6)), *(words(r.randint(20, 60)) for _ in range(r.randint(2, 6)))]
        menu = "".join(f"<li><a href='/{k}'>{words(1)}</a>" for _ in range(r.randint(2, 7)))
        noise = [f"<ul class='{style}'>{menu}</ul>", f"<div class='{style}-{k}'>{words(5)}</div>", f"<div id=b{k}><span>{words(3)}</span></div>"]
        end = f"<div class='{style} end'><p>{words(6)}</p></div><footer>{words(4)}</footer>"
        body = f"<h1>{own[0]}</h1>" + "".join(f"<p>{x}</p>" for x in own[1:])
        out.append((nodes + k, f"https://{host}/{k // 3}/{k}?p={k}", f"<html><head><title>{words(2)}</title></head><body>{''.join(noise)}<{box}>{body}</{box.split()[0]}>{end}</body></html>", "\n\n".join(own)))
    return out


def test_planted_articles_are_found_by_differencing(spark, monkeypatch):
    """No page has a listed word beside its article, so the neighbours alone tell; the texts are known from how the pages were made."""
    r = random.Random(8)
    rows = [x for h in range(12) for x in planted_site(r, f"h{h}.org", r.randint(2, 9), 100 * h)]
    df = spark.createDataFrame([x[:3] for x in rows], "page_id long, url string, html string")
    want = {x[0]: x[3] for x in rows}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 7, 211):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert {x["page_id"]: x["text"] for x in html_diff.extract(df).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    # Without a neighbour they all keep something of the site.
    assert all(html_diff.main_text(html_diff.shaped(x[2]), "/", None, None) != x[3] for x in rows)


def test_differencing_needs_no_word_lists_where_there_are_neighbours(spark, monkeypatch):
    pages = table(spark, "pages").collect()
    hosts = Counter(re.sub(r"^\w+://([^/?#]*).*", r"\1", x["url"]) for x in pages)
    with_lists = {x["page_id"]: x["text"] for x in html_diff.extract(table(spark, "pages")).collect()}
    for x in pages:
        if hosts[re.sub(r"^\w+://([^/?#]*).*", r"\1", x["url"])] > 1:
            others = [html_diff.shaped(y["html"]) for y in pages if y["html"] != x["html"] and y["url"].split("/")[2] == x["url"].split("/")[2]][:2]
            own = [(t, c, False, key) for t, c, _, key in html_diff.shaped(x["html"])]
            if others:
                assert html_diff.main_text(own, "/", ("/", [b[-1] for b in others[0]]), None) == with_lists[x["page_id"]]


@pytest.mark.parametrize("html,text", [
    ('<div class="social-science"><p>One two three</p><p>four</p></div>', "One two three\n\nfour"), ('<div class="ad-free"><p>x y</p></div>', "x y"), ('<div class="content related-work"><p>x y</p></div>', "x y"),
    ('<div class="post comment-free"><p>x y</p></div>', "x y"), ('<div id="search-results-article"><p>x y</p></div>', "x y"), ("<article><header><h1>Head</h1></header><p>x</p></article>", "Head\n\nx"),
    ('<form><div class="widget"><article><p>x</p></article></div></form><div class="top-ad">b</div><div class="cookie-banner">c</div>', "x"), ('<p>short</p><div class="comments"><p>a much longer reader comment</p></div>', "short"),
    ("<p>a</p>" * 3000 + '<div class="promo">b</div>', "\n\n".join(["a"] * 3000)), ('<div class="x">' * 3000 + "deep", "deep")
])
def test_class_words_do_not_hide_the_main_container(html, text):
    assert html_diff.main_text(html_diff.shaped(f"<body>{html}</body>"), "/", None, None) == text


def brute_pages(rows):
    """Each page against the nearest unlike page of its host, one page at a time."""
    def key(row):
        m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)([^?#]*)", row[1] or "")
        return (m[1].lower(), m[2]) if m else ("", "")

    def order(row):
        return (*key(row), str(row[0]).rjust(20, "0"), row[1] or "")

    ordered, out = sorted(rows, key=order), []
    for at, row in enumerate(ordered):
        host, path = key(row)
        sides = []
        for others in (reversed(ordered[:at]), ordered[at + 1 :]):
            near = next((x for x in others if host and (key(x)[0] != host or x[2] != row[2])), None)
            sides.append((key(near)[1], [t for t, _, _ in html_diff.blocks(near[2] or "")]) if near and key(near)[0] == host else None)
        out.append((row[0], row[1], html_diff.main_text(html_diff.blocks(row[2] or ""), path, *sides)))
    return sorted(out, key=str)


def test_pages_do_not_depend_on_partitions(spark):
    r = random.Random(3)
    words = lambda n: " ".join(r.choice("abcdefghij") * 3 for _ in range(n))
    html = []
    for k in range(40):
        lines = [words(3) for _ in range(r.randrange(1, 6))]
        tag = r.choice(["div", "article", "p"])
        html.append("<body><div>Top of the site</div>" + f"<{tag}>" + "".join(f"<p>{x}</p>" for x in lines) + f"</{tag}><p>{r.choice(['Imprint', 'Contact'])}</p></body>")
    rows = [(k, r.choice([None, "no host", *["http://big.org"] * 6, "https://small.org"]), r.choice(html[:4] * 6 + html)) for k in range(150)]
    rows = [(k, u and u + f"/{r.choice(['a', 'ab', 'b'])}/{r.randrange(30)}?q={k}", h) for k, u, h in rows] + [(900 + k, f"http://same.org/{k:03}", html[k // 60]) for k in range(120)]
    rows += [(7, "http://big.org/a/1", None), (7, "http://big.org/a/1", None)]
    want = brute_pages(rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 7, 211):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = html_diff.extract(df.repartition(max(1, n // 30))).collect()
            assert sorted(((x["page_id"], x["url"], x["text"]) for x in got), key=str) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_odd_pages_take_linear_time():
    import time

    began = time.time()
    for page in ("<a " * 60000, "<b>" * 60000 + "<p>x", "<p><div>" * 30000, "<!" * 60000, "<a x='" + "y" * 200000, "<i a" + "b" * 200000 + ">", "</i>" * 60000, "<script>" * 30000, "&amp;" * 60000):
        html_diff.blocks(page)
    assert time.time() - began < 20
    assert [t for t, _, _ in html_diff.blocks("<p>a<script>x</p></script>b<p>c<script>d")] == ["ab", "c"]
    assert [t for t, _, _ in html_diff.blocks("1 < 2 <3 <p class=x>a > b</p><![CDATA[raw <b>]]>end<a href='unclosed>x")][:3] == ["1 < 2 <3", "a > b", "raw <b>endx"]


def test_common_subsequence():
    r = random.Random(2)
    for _ in range(200):
        a, b = ([r.choice("abcde") for _ in range(r.randrange(12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = html_diff.common(a, b)
        it = iter(b)
        assert len(got) == best[-1][-1] and all(a[k] in it for k in sorted(got))


# 6


def test_line_dedup(spark):
    r = random.Random(3)
    line = lambda n: " ".join(f"u{r.randrange(10**6)}" for _ in range(n))
    passage, second, short = [line(30), "ok", line(25)], [line(60)], line(8)
    rows = [
        (101, "\n".join([line(12), *passage, line(12), *second])), (102, "\n".join([short, *second, line(9), *passage, line(11)])),  # moved blocks
        (103, "\n".join([short, line(40)])), (104, "\n".join([*second, line(7), *second])), (105, line(50)),
    ]
    rows += [(110 + k, "\n".join(passage)) for k in range(30)] + EDGES
    got = {}
    for x in line_dedup.report(spark, documents(spark, rows, True)).collect():
        got.setdefault(x["doc_id"], []).append(x["deleted_at"])
    assert got[101] == [[]] and got[102] == [[1, 3, 4, 5]] and got[103] == [[]] and got[104] == [[0, 2]] and got[105] == [[]]
    assert all(got[110 + k] == [[0, 1, 2]] for k in range(30)) and all(x == [] for i, _ in EDGES for x in got[i])
    out = {x["doc_id"]: x for x in line_dedup.deduplicated(spark, documents(spark, rows, True)).collect()}
    assert 112 not in out and out[102]["text"] == "\n".join([rows[1][1].split("\n")[k] for k in (0, 2, 6)]) and out[102]["n_chars"] == len(out[102]["text"]) and out[102]["digest"] == "src1"
    assert out[101]["text"] == rows[0][1] and set(out) == {101, 102, 103, 104, 105} | {i for i, _ in EDGES}
    assert line_dedup.deduplicated(spark, documents(spark, rows, True)).columns == documents(spark, rows, True).columns
    assert line_dedup.report(spark, empty(spark)).count() == 0
    twice = documents(spark, [(1, "\n".join(passage)), (1, "\n".join(passage))])
    assert line_dedup.deduplicated(spark, twice).count() == 2  # repeated rows are one document


def brute_deletions(rows, least=40):
    """Lines inside a block of ``least`` words that stands whole in a document of lesser id."""
    split = [t.split("\n") for _, t in rows]
    out = []
    for k, own in enumerate(split):
        gone = set()
        for other in split[:k]:
            for i in range(len(own)):
                for j in range(len(other)):
                    n = 0
                    while i + n < len(own) and j + n < len(other) and own[i + n] == other[j + n]:
                        n += 1
                    if sum(len(x.split()) for x in own[i : i + n]) >= least:
                        gone.update(range(i, i + n))
        out.append(sorted(gone))
    return out


def test_line_dedup_finds_blocks_behind_their_lines_first_holder(spark):
    r = random.Random(9)
    line = lambda n: " ".join(f"u{r.randrange(10**6)}" for _ in range(n))
    passage, verse = [line(12) for _ in range(5)], [line(3) for _ in range(20)]
    edited = [*passage[:2], line(12), *passage[3:]]
    rows = [(1, "\n".join([line(9), *edited]))] + [(k, "\n".join([line(9), *passage])) for k in range(2, 9)]
    rows += [(k, "\n".join([line(6), *verse, line(6)])) for k in range(20, 24)]
    rows += [(30, "\n".join(["", *passage[:3], "", *verse[:9], line(4), *passage[1:], "", *verse[5:]]))]
    got = {x["doc_id"]: x["deleted_at"] for x in line_dedup.report(spark, documents(spark, rows)).collect()}
    want = brute_deletions(rows)
    assert want[2] == [1, 2, 3, 4, 5] and want[9] == list(range(1, 21))
    assert [got[i] for i, _ in rows] == want
    # Few distinct lines, so that blocks overlap, repeat and move.
    lines = [line(n) for n in (1, 3, 4, 7, 12, 14, 25, 39, 41)] + [""]
    rows = [(k, "\n".join(r.choice(lines) for _ in range(r.randrange(1, 14)))) for k in range(60)]
    got = {x["doc_id"]: x["deleted_at"] for x in line_dedup.report(spark, documents(spark, rows)).collect()}
    assert [got[i] for i, _ in rows] == brute_deletions(rows)


# 7


def brute_scores(rows, order=3, least=2, back=0.4):
    docs = [[w for w in re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))] for _, t in rows]
    c = Counter(tuple(d[i : i + n]) for d in docs for n in range(1, order + 1) for i in range(len(d) - n + 1))
    total, out = sum(len(d) for d in docs), []
    for d in docs:
        s = steps = 0
        for i in range(len(d)):
            k = min(i + 1, order)
            while k > 1 and c[tuple(d[i - k + 1 : i + 1])] < least:
                k, s = k - 1, s + np.log(back)
            steps += k < min(i + 1, order)
            s += np.log(c[tuple(d[i - k + 1 : i + 1])]) - np.log(c[tuple(d[i - k + 1 : i])] if k > 1 else total)
        out.append((len(d), steps, round(float(s), 6)))
    return out


def test_stupid_backoff_equals_brute_force(spark, monkeypatch):
    r = random.Random(4)
    rows = EDGES + [(100 + k, " ".join(r.choice("abcdefgh") for _ in range(r.randrange(40)))) for k in range(60)]
    for order in (2, 3):
        got = ngram_lm.scores(spark, documents(spark, rows, True), order=order).collect()
        want = Counter((i, *x) for (i, _), x in zip(rows, brute_scores(rows, order)))
        assert Counter((x["doc_id"], x["n_tokens"], x["n_backoff"], round(x["log_score"], 6) + 0.0) for x in got) == want
    assert ngram_lm.scores(spark, empty(spark)).count() == 0
    # Every n-gram counts; groups of a few texts; a row for each n-gram.
    monkeypatch.setattr(ngram_lm, "GROUP_BYTES", 100)
    rows = [x for x in rows if x[0] != 5]
    want = Counter((i, *x) for (i, _), x in zip(rows, brute_scores(rows, 3, 1)))
    for f in (ngram_lm.scores, ngram_lm.relational_scores):
        got = f(spark, documents(spark, rows, True), min_count=1).collect()
        assert Counter((x["doc_id"], x["n_tokens"], x["n_backoff"], round(x["log_score"], 6) + 0.0) for x in got) == want
    assert ngram_lm.relational_scores(spark, empty(spark)).count() == 0


def test_gram_arrays_pack():
    r = np.random.default_rng(0)
    v = np.unique(r.integers(0, 2**63, 5000).astype(np.uint64))
    c = r.integers(1, 2000, len(v))
    assert (ngram_lm.unpack(ngram_lm.pack(v)) == v).all() and (ngram_lm.unpack_counts(ngram_lm.pack_counts(c), len(c)) == c).all()


# 9


def brute_groups(rows, similarity=0.8):
    """Connected components under the weighted Jaccard similarity of all pairs."""
    sets, out = [], {}
    for _, t in rows:
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(Counter([tuple(w[k : k + 5]) for k in range(len(w) - 4)] or ([tuple(w)] if w else [])))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            least, most = sum((sets[a] & sets[b]).values()), sum((sets[a] | sets[b]).values())
            if sets[a] and least >= similarity * most - 1e-9:
                root[find(a)] = find(b)
    for k in range(len(rows)):
        out.setdefault(find(k), set()).add(rows[k][0])
    return sorted(sorted(x) for x in out.values())


def near_rows():
    r = random.Random(6)
    words = lambda n: [f"w{r.randrange(10**5)}" for _ in range(n)]
    rows = []
    head = words(9)
    for _ in range(6):
        base = words(r.choice([30, 200]))
        for k in range(8):
            v = list(base)
            for _ in range(k // 2):
                v[r.randrange(len(v))] = "changed"
            rows.append(" ".join(v))
    rows += [" ".join(head + words(6)) for _ in range(40)]  # half alike, never 0.8
    line, own = words(8), words(60)
    rows += [" ".join(line * n + own) for n in (2, 20, 22, 40)]  # the same shingles, other weights
    return list(enumerate(rows))


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    rows = near_rows()
    for at_once, shingles in ((512, 1 << 20), (3, 1 << 20), (512, 300)):
        monkeypatch.setattr(dart_minhash, "CELL_DOCS", at_once)
        monkeypatch.setattr(dart_minhash, "CELL_SHINGLES", shingles)
        got = defaultdict(set)
        for x in dart_minhash.groups(spark, documents(spark, rows, True)).collect():
            got[x["class_id"]].add(x["doc_id"])
        assert sorted(sorted(x) for x in got.values()) == brute_groups(rows)
        assert all(k == min(v) for k, v in got.items())


def rim_rows(seed, copies=300, away=6):
    """Near copies of one text with two words changed each, and documents at the rim of the group."""
    r = random.Random(seed)
    base = [f"b{r.randrange(10**6)}" for _ in range(300)]
    rows = []
    for k in range(copies + away):
        v = list(base)
        for n, at in enumerate(r.sample(range(300), 2 if k < copies else 6)):
            v[at] = f"c{k}x{n}"
        rows.append(" ".join(v))
    return list(enumerate(rows))


def test_rim_of_a_large_near_copy_group(spark):
    for seed in (1, 2):
        rows = rim_rows(seed)
        got = defaultdict(set)
        for x in dart_minhash.groups(spark, documents(spark, rows)).collect():
            got[x["class_id"]].add(x["doc_id"])
        assert sorted(sorted(x) for x in got.values()) == brute_groups(rows)


def template_rows(pairs=150):
    """Pairs of similarity just over 0.8 in buckets full of documents that share most of one template."""
    r = random.Random(8)
    base = [f"t{k}" for k in range(400)]
    rows = []
    for p in range(pairs):
        one = base[:300] + [f"p{p}x{r.randrange(10**6)}" for _ in range(100)]
        two = list(one)
        for k in r.sample(range(304, 396, 5), 8):
            two[k] = f"q{p}x{k}"
        rows += [" ".join(one), " ".join(two)]
    return list(enumerate(rows))


def test_large_buckets_are_compared_whole(spark, monkeypatch):
    rows = template_rows()
    monkeypatch.setattr(dart_minhash, "CELL_DOCS", 16)
    docs = documents(spark, rows)
    signed = dart_minhash.signed(docs.select("doc_id", "text"), 8, 5, 5, True)
    bands = {x["doc_id"]: x["bands"] for x in signed.collect()}
    root = {x["doc_id"]: x["class_id"] for x in dart_minhash.groups(spark, docs, bands=8).collect()}
    want = [x for x in brute_groups(rows) if len(x) == 2]
    met = [(a, b) for a, b in want if any(x == y for x, y in zip(bands[a], bands[b]))]
    assert len(want) == 150 and len(met) > 100
    assert [(a, b) for a, b in met if root[a] != root[b]] == []
    assert all(root[a] == a for a, _ in want)  # no more than the true pairs are linked


def test_near_duplicate_edges(spark):
    rows = EDGES + [(50, "one TWO three"), (51, "Totally different words here for once")]
    out = dart_minhash.groups(spark, documents(spark, rows, True)).collect()
    assert len(out) == len(rows)
    assert {x["class_id"] for x in out if x["doc_id"] == 50} == {4}  # the same words
    assert {x["class_id"] for x in out if x["doc_id"] in (1, 2, 3)} == {1, 2, 3}  # no words
    kept = dart_minhash.one_of_each(spark, documents(spark, rows, True))
    ids = Counter(x["doc_id"] for x in kept.collect())
    assert ids[4] == 2 and ids[50] == 0 and ids[None] == 1 and ids[1] == ids[2] == ids[3] == 1
    assert kept.columns == documents(spark, rows, True).columns
    assert dart_minhash.groups(spark, empty(spark)).count() == 0


def test_signatures_estimate_weighted_similarity():
    r = np.random.default_rng(7)
    for n in (5, 50, 2000):
        key = np.sort(r.integers(0, 2**63, n).astype(np.uint64))
        wa, wb = r.integers(1, 4, n), r.integers(1, 4, n)
        sig = dart_minhash.signatures(np.concatenate([key, key]), np.concatenate([wa, wb]), np.array([0, n, 2 * n]), 2000)
        want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        assert abs((sig[0] == sig[1]).mean() - want) < 0.05
        # Real weights, below and above the unit; the scale of all weights does not matter.
        wa, wb = r.uniform(0, 0.4, n) ** 2 * 50, r.uniform(0, 0.4, n) ** 2 * 50
        want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
        for scale in (0.01, 1.0, 100.0):
            sig = dart_minhash.signatures(np.concatenate([key, key]), np.concatenate([wa, wb]) * scale, np.array([0, n, 2 * n]), 2000)
            assert abs((sig[0] == sig[1]).mean() - want) < 0.05


def test_darts_follow_the_logarithm_of_the_weights():
    key = np.arange(1, 4, dtype=np.uint64)
    element, strip = dart_minhash._strips(np.array([0.0, 0.25, 10.0**6]), 1.0)
    assert element.tolist() == [1] + [2] * 21 and strip.tolist() == [0, *range(21)]
    sig = dart_minhash.signatures(key, np.array([0.0, 0.25, 10.0**6]), np.array([0, 1, 2, 3]), 50)
    assert not sig[0].any() and sig[1].all() and sig[2].all()


def test_near_duplicate_recall_by_similarity(spark):
    """Pairs found by their weighted similarity, in a corpus whose buckets hold thousands of texts."""
    r = random.Random(12)
    base = [f"t{k}" for k in range(120)]
    rows, pairs = [], []
    for k in range(5200):  # most of one template: alike, never 0.8
        rows.append(" ".join(base[:96] + [f"o{k}x{j}" for j in range(24)]))
    for p in range(120):
        one = [f"p{p}x{j}" for j in range(200)]
        two = list(one)
        for at in r.sample(range(4, 196, 6), 1 + p % 6):
            two[at] = "other"
        pairs.append((len(rows), len(rows) + 1))
        rows += [" ".join(one), " ".join(two)]
    root = {x["doc_id"]: x["class_id"] for x in dart_minhash.groups(spark, documents(spark, list(enumerate(rows)))).collect()}
    shingle = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    found, bands = Counter(), Counter()
    for a, b in pairs:
        x, y = shingle(rows[a]), shingle(rows[b])
        s = len(x & y) / len(x | y)
        bands[int(s * 20)] += 1
        found[int(s * 20)] += root[a] == root[b]
        assert (root[a] == root[b]) == (s >= 0.8) or abs(s - 0.8) < 0.02
    assert all(found[k] >= 0.9 * bands[k] for k in bands if k >= 16) and sum(bands[k] for k in bands if k >= 16) > 50
    assert len({root[k] for k in range(5200)}) == 5200


# Shared parts and the registered queries.


def test_segment_hash_depends_on_bytes_alone():
    data = np.frombuffer(b"abc abc xabc abcd", np.uint8)
    h = B.segment_hash(data, np.array([0, 4, 9, 13, 13]), np.array([3, 7, 12, 16, 17]))
    assert h[0] == h[1] == h[2] == h[3] != h[4]
    col = pa.array(["a", None, "", "bb" * 100, "c"])
    assert [hi - lo for lo, hi, _, _ in B.slices(col, 50)] == [4, 1] or sum(hi - lo for lo, hi, _, _ in B.slices(col, 50)) == 5


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    want = con.execute(queries.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_contract_columns(spark):
    want = {
        "op1_wu_manber_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], "op2_token_store": ["doc_id", "start", "n_tokens", "ids_crc32"],
        "op3_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"], "op4_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
        "op5_page_differencing": ["page_id", "url", "text", "n_chars"], "op10_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    }
    for name, cols in want.items():
        df = queries.queries()[name](spark, SF)
        assert set(cols) <= set(df.columns)
        assert df.count() == table(spark, "pages" if name.startswith("op5") else "documents").count()


def test_no_item_is_the_digest_of_nothing(spark):
    x = queries.op1_wu_manber_decontamination(spark, SF).where("n_items = 0").first()
    assert x["items_sha256"] == hashlib.sha256(b"").hexdigest()


def test_intermediate_tables_are_released(spark):
    from weft.llm import _shared

    kept = _shared.written(spark, documents(spark, EDGES), "kept")
    assert kept.count() == len(EDGES)
    _shared.release(spark)
    assert not _shared._MADE
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        _shared.written(spark, documents(spark, EDGES), "gone").count() or _shared.release(spark)
        spark.read.parquet(_shared.new_path(spark, "nothing")).count()
