"""The registered queries, one for each operator, over whole tables; and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import (
    chat_format, dart_minhash, decontaminate, html_diff, line_dedup, ngram_lm, quality_classifier, quality_rules, sp_codec, token_counts, token_store,
    vector_codes, whitening
)
from weft.llm import pipeline as corpus
from weft.llm._shared import table, written

#: Tokens above which a document does not fit.
TOKEN_LIMIT = 2048


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest_columns(found)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = token_store.round_trip(spark, table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), with_ids=False)
    return back.select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = token_counts.token_counts(spark, table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))
    return got.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = written(spark, quality_rules.statistics(table(spark, sf_dir, "documents")), "statistics")
    return quality_rules.judged(stats, quality_rules.fit(stats, table(spark, sf_dir, "labels")))


def document_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of the quality rules that SQL can state: the base statistics and the base rules."""
    return quality_rules.judge(table(spark, sf_dir, "documents"), quality_rules.base_rules()).drop("score", "kept")


def op5_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_diff.extract(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = line_dedup.report(spark, table(spark, sf_dir, "documents"))
    return got.withColumn("deleted_at", F.array_join(F.col("deleted_at").cast("array<string>"), ","))


def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = ngram_lm.scores(spark, table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_tokens", "n_backoff", F.round("log_score", 3).alias("log_score"), F.round("mean_log_score", 4).alias("mean_log_score"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sp_codec.encode_decode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))
    return got.select("doc_id", "n_bytes", "n_tokens", "ids_crc32", "round_trip", "parity")


def op9_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.groups(spark, table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = written(spark, quality_classifier.with_features(table(spark, sf_dir, "documents")), "features")
    return quality_classifier.scored(features, quality_classifier.fit(features, table(spark, sf_dir, "labels")))


def op11_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = chat_format.format_conversations(chat_format.with_probe(spark, table(spark, sf_dir, "conversations")))
    return chat_format.digests(pieces)


def op12_tsqr_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark, table(spark, sf_dir, "embeddings"))


def op13_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(spark, table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.run(spark, sf_dir)


def queries() -> dict:
    ops = [
        op1_wu_manber_decontamination, op2_token_store, op3_token_counts, op4_quality_rules, op5_page_differencing, op6_line_dedup,
        op7_stupid_backoff, op8_sentencepiece, op9_dart_minhash, op10_quality_classifier, op11_chat_template, op12_tsqr_whitening,
        op13_delta_lloyd, pipeline, document_statistics
    ]
    return {f.__name__: f for f in ops}


OP1_SQL = r"""
WITH norm AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10 + 1, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT k FROM win), places AS (
  SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM norm, sizes WHERE len(w) >= k)
), occ AS (SELECT r, i, p.k AS k, item FROM places p JOIN win ON p.k = win.k AND p.s = win.s),
hit AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + k)) AS j FROM occ) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM norm LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

#: Blocks are runs of equal lines at one distance in two documents.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, i - 1 AS p, l[i] AS t, len(regexp_extract_all(l[i], '[^\x20\x09-\x0D]+')) AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
pairs AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM l a JOIN l b ON a.t = b.t AND a.doc_id < b.doc_id WHERE a.w > 0),
same AS (SELECT a, b, y.p, y.w, y.p - x.p AS shift FROM pairs JOIN l x ON x.doc_id = a JOIN l y ON y.doc_id = b AND y.t = x.t),
runs AS (SELECT *, p - row_number() OVER (PARTITION BY a, b, shift ORDER BY p) AS run FROM same),
gone AS (SELECT DISTINCT b, p, w FROM (SELECT b, p, w, sum(w) OVER (PARTITION BY a, b, shift, run) AS block FROM runs) WHERE block >= 40),
cut AS (SELECT b, count(*) AS n, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS places, sum(w) AS words FROM gone GROUP BY b)
SELECT doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_deleted, coalesce(places, '') AS deleted_at, CAST(coalesce(words, 0) AS BIGINT) AS words_deleted
FROM documents LEFT JOIN cut ON b = doc_id
"""

STATISTICS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
win AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) > 4)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1),
words AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS j FROM twice) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(words.n, 0) AS BIGINT) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(words.n, 0) > 20 * len(w) AS base_failed
FROM d LEFT JOIN lines USING (r) LEFT JOIN words USING (r)
"""

OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS c FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
n1 AS (SELECT a, count(*) AS n FROM t GROUP BY a), n2 AS (SELECT b, a, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY b, a), n3 AS (SELECT c, b, a, count(*) AS n FROM t WHERE c IS NOT NULL GROUP BY c, b, a),
total AS (SELECT sum(n) AS n FROM n1),
s AS (
  SELECT t.r, least(t.i, 3) AS best, CASE WHEN n3.n >= 2 THEN 3 WHEN n2.n >= 2 THEN 2 ELSE 1 END AS lvl,
    CASE WHEN n3.n >= 2 THEN ln(n3.n) - ln(m2.n) WHEN n2.n >= 2 THEN ln(n2.n) - ln(m1.n) ELSE ln(n1.n) - ln(total.n) END AS l
  FROM t JOIN n1 ON n1.a = t.a LEFT JOIN n2 ON n2.b = t.b AND n2.a = t.a LEFT JOIN n3 ON n3.c = t.c AND n3.b = t.b AND n3.a = t.a
    LEFT JOIN n2 m2 ON m2.b = t.c AND m2.a = t.b LEFT JOIN n1 m1 ON m1.a = t.b, total
), g AS (SELECT r, count(*) AS k, count(*) FILTER (WHERE lvl < best) AS back, sum(l + (best - lvl) * ln(0.4)) AS l FROM s GROUP BY r)
SELECT doc_id, CAST(coalesce(k, 0) AS BIGINT) AS n_tokens, CAST(coalesce(back, 0) AS BIGINT) AS n_backoff, round(coalesce(l, 0), 3) AS log_score, round(l / k, 4) AS mean_log_score
FROM d LEFT JOIN g USING (r)
"""


#: Exact: all pairs that share a shingle (its k-th occurrence is an element of its own), then components.
OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, array_to_string(w[i : i + 4], ' ') AS g, i FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
s AS (SELECT doc_id, hash(g || ' ' || row_number() OVER (PARTITION BY doc_id, g ORDER BY i)) AS h FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (h) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT doc_id, min(root) AS class_id FROM r GROUP BY doc_id
"""


#: The lengths are those of the template's constant texts; an escape is one character more.
OP11_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), control AS (SELECT unnest(['<s>', '</s>', '[INST]', '[/INST]', '[REPLY]', '[ROLE]', '[/ROLE]', chr(92)]) AS c),
extra AS (
  SELECT s, CAST(sum((length(s) - length(replace(s, c, ''))) // length(c)) AS BIGINT) AS n
  FROM (SELECT role AS s FROM t UNION SELECT text FROM t), control GROUP BY s
), sized AS (
  SELECT t.*, CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 ELSE 17 + length(role) + r.n END + length(text) + x.n AS size
  FROM t JOIN extra r ON r.s = role JOIN extra x ON x.s = text
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, md5(role || chr(10) || text))) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, md5(role || chr(10) || text)) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def _lloyd_sql(rounds: int = 2) -> str:
    """The rounds written out: d(i, part, entry, near) has each part's least distance, with its entry in the low six bits."""
    nearest = """n{k} AS (
  SELECT i, p, min(d * 64 + e) AS near FROM (
    SELECT i, v.p, e, sum((v.c - b.c) * (v.c - b.c)) AS d FROM v JOIN b{k} b ON b.p = v.p AND b.j = v.j GROUP BY i, v.p, e
  ) GROUP BY i, p
)"""
    books = """b{k} AS (
  SELECT o.p, o.e, o.j, coalesce((s - ((s % n) + n) % n) // n, o.c) AS c FROM b{o} o LEFT JOIN (
    SELECT v.p, near % 64 AS e, j, CAST(sum(c) AS BIGINT) AS s, count(*) AS n FROM v JOIN n{o} m ON m.i = v.i AND m.p = v.p GROUP BY ALL
  ) t ON t.p = o.p AND t.e = o.e AND t.j = o.j
)"""
    steps = [nearest.format(k=0)] + [x.format(k=k, o=k - 1) for k in range(1, rounds + 1) for x in (books, nearest)]
    return (
        """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS i, * FROM (
    SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c) OR abs(c) >= 1048576)) = 0
  )
), v AS (
  SELECT i, (k - 1) // (len(x) // 16) AS p, (k - 1) % (len(x) // 16) AS j, x[k] AS c FROM (SELECT i, x, unnest(range(1, len(x) + 1)) AS k FROM kept)
), b0 AS (SELECT p, i AS e, j, c FROM v WHERE i < 64),
"""
        + ",\n".join(steps)
        + f""",
coded AS (
  SELECT vec_id, label, string_agg(substr('0123456789abcdef', 1 + CAST(near % 64 // 16 AS INT), 1) || substr('0123456789abcdef', 1 + CAST(near % 16 AS INT), 1), '' ORDER BY p) AS code,
    CAST(sum(near // 64) AS BIGINT) AS error
  FROM n{rounds} JOIN kept USING (i) GROUP BY i, vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) FROM b{rounds}) AS codebooks_sha256
FROM coded
"""
    )


OP13_SQL = _lloyd_sql()


def oracle_sql() -> dict[str, str]:
    """SQL where it expresses the whole query; the others are tested against brute force."""
    return {
        "op1_wu_manber_decontamination": OP1_SQL, "op6_line_dedup": OP6_SQL, "op7_stupid_backoff": OP7_SQL, "op9_dart_minhash": OP9_SQL,
        "op11_chat_template": OP11_SQL, "op13_delta_lloyd": OP13_SQL, "document_statistics": STATISTICS_SQL
    }
