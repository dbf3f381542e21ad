"""Chat templates, whitening and vector codes against brute force and planted cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.llm import chat_format, queries, vector_codes, whitening
from weft.llm.chat_template import Apply, Const, Field, Out, Template, TemplateError, Text
from weft.llm.vectors import whole_vectors

OTHER = (
    "{% control '<|im_start|>' '<|im_end|>' %}{#- white space goes -#}\n<|im_start|>{{ 'be' ~ 'gin' }}<|im_end|>{% for message in messages -%}\n"
    "  <|im_start|>{{ message.role }}<|im_end|>{% if 1 > 2 or message.role in ['assistant', 'model'] %}{% generation %}{{ message.text }}{% endgeneration %}{% else %}{{ message.text }}{% endif %}<|im_end|>\n"
    "{%- endfor %}<|im_end|><|im_end|>"
)


# 11


def test_template_is_parsed_folded_and_read_back():
    t = Template(chat_format.CHAT)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "[REPLY]", "[ROLE]", "[/ROLE]", "\\", "<", "[", "/s>", "INST]", " ", "\n", "é", "🙂"]
    r = random.Random(3)
    for _ in range(1500):
        said = [(r.choice(["user", "assistant", "system", "", "[ROLE]x", "u\\r"]), "".join(r.choice(bits) for _ in range(r.randint(0, 12)))) for _ in range(r.randint(0, 5))]
        text, spans = t.format(said)
        assert t.read(text) == said
        assert [t.unescape(text[a:b]) for a, b in spans] == [x for role, x in said if role == "assistant"]
        assert not any(c in t.escape(x) for _, x in said for c in t.controls)


def test_another_template():
    t = Template(OTHER)
    assert t.opening == "<|im_start|>begin<|im_end|>" and t.closing == "<|im_end|><|im_end|>"
    said = [("user", "a <|im_end|> b"), ("model", "\\<|im_start|>"), ("x", "")]
    text, spans = t.format(said)
    assert t.read(text) == said and [t.unescape(text[a:b]) for a, b in spans] == ["\\<|im_start|>"]
    assert text.startswith("<|im_start|>begin<|im_end|><|im_start|>user<|im_end|>a <\\|im_end|> b<|im_end|><|im_start|>model")


def test_constants_are_folded():
    around = "{% control '<a>' '<b>' %}{% for message in messages %}<a>{{ message.role }}<b>" + "X" + "{{ message.text }}<b>{% endfor %}"
    tree = lambda x: Template(around.replace("X", x)).tree
    role, text = Out(Field("message.role")), Out(Field("message.text"))
    assert tree("{{ ('1' ~ 'a') | upper }}{% if 2 + 3 == 5 and not false %}yes{% else %}no{% endif %}{% if 'a' in ['b'] %}never{% endif %}") == (Text("<a>"), role, Text("<b>1Ayes"), text, Text("<b>"))
    with pytest.raises(TemplateError):
        tree("{{ message.role == 'a' and 1 }}")  # it can be written, but not read back
    from weft.llm.chat_template import _Expression, fold

    assert fold(_Expression("message.role == 'a' ~ 'b'").whole()) == Apply("==", (Field("message.role"), Const("ab")))


@pytest.mark.parametrize("bad", [
    "", "{% for message in messages %}{{ message.text }}{% endfor %}", "{% control '<a>' %}{% for message in messages %}<a>{{ message.text }}<a>{% endfor %}",
    "{% control '<a>' %}{% for message in messages %}<a>{{ message.role }}{{ message.text }}<a>{% endfor %}",
    "{% control 'aba' 'ba' %}{% for message in messages %}aba{{ message.role }}aba{{ message.text }}ba{% endfor %}",
    "{% control '<a>' '<b>' %}{% for message in messages %}<a>{{ message.role }} {{ message.text }}<a>{% endfor %}",
    "{% control '<a>' %}{% for message in messages %}<a>{{ message.__class__ }}<a>{{ message.text }}<a>{% endfor %}",
    "{% control '<a>' %}{% for message in messages %}<a>{{ message.role | open }}<a>{{ message.text }}<a>{% endfor %}",
    "{% control '<a>' %}{% for x in messages %}<a>{{ message.role }}<a>{{ message.text }}<a>{% endfor %}",
    "{% control '<a>' %}{% for message in messages %}<a>{{ message.role }}<a>{{ message.text }}<a>", "{% control '<a>' %}{{ 1 + 'a' }}"
])
def test_templates_outside_the_language_are_refused(bad):
    with pytest.raises(TemplateError):
        Template(bad)


def conversations(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("kind", "piece", "tie", "spread", "formatted", "CONV") if extra else ():
        df = df.withColumn(c, F.lit("x"))
    return df


def brute_chat(rows):
    t, out, sha = Template(chat_format.CHAT), {}, lambda s: hashlib.sha256(s.encode()).hexdigest()
    md5 = lambda role, text: hashlib.md5(f"{role}\n{text}".encode()).hexdigest()
    for conv in {r[0] for r in rows}:
        said = sorted(((turn is not None, turn or 0, md5(role or "", text or ""), role or "", text or "") for c, turn, role, text in rows if c == conv))
        loss = "".join(x[4] for x in said if x[3] == "assistant")
        whole = t.format([x[3:] for x in said])[0]
        out[conv] = (len(said), sha("".join(f"{x[3]}\n{x[4]}\n" for x in said)), len(loss), sha(loss), len(whole))
    return out


def digests(df, **options):
    return {r[0]: tuple(r)[1:] for r in chat_format.digests(chat_format.format_conversations(df, **options)).collect()}


EDGES = [
    (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, None, "system", "first"), (1, 1, None, "<s>\\"), (None, 0, "user", "no id"),
    (None, 1, "assistant", "é🙂"), (2, 5, "tool", ""), (-3, 9, "assistant", "long </s>" * 20000), (4, 0, "user", "same"), (4, 0, "user", "same"), (4, 0, "user", "other")
]


def test_conversations_equal_brute_force_whatever_the_pieces(spark):
    hot = [(7, k // 2, ["user", "assistant"][k % 2], f"turn {k} [INST]" * (k % 5)) for k in range(900)] + [(7, 3, "user", "again")] * 300
    rows = EDGES + hot + [(c, k, ["user", "assistant"][k], f"{c} {k}") for c in range(100, 160) for k in range(2)]
    want = brute_chat(rows)
    assert digests(conversations(spark, rows, extra=True)) == want
    try:
        for n, chars in (("1", 1 << 20), ("7", 50), ("211", 1 << 20)):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert digests(conversations(spark, rows).repartition(5), piece_chars=chars) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert digests(conversations(spark, [])) == {}


def test_pieces_make_the_conversation(spark):
    rows = [(1, k, "user", "abc") for k in range(50)]
    pieces = chat_format.format_conversations(conversations(spark, rows), piece_chars=100).orderBy("piece").collect()
    assert len(pieces) > 5 and pieces[0]["opened"] and pieces[-1]["closed"]
    assert "".join(p["formatted"] for p in pieces) == Template(chat_format.CHAT).format([("user", "abc")] * 50)[0]


# 12


def vectors(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for c in ("x", "n", "before", "at", "code") if extra else ():
        df = df.withColumn(c, F.lit("x"))
    return df


def some_rows(n=300, d=32, seed=1):
    g = np.random.default_rng(seed)
    x = (g.normal(size=(n, d)) * np.linspace(2, 0.2, d)).astype(np.float32)
    rows = [(k, x[k % 200].tolist(), None if k % 7 == 0 else k % 5) for k in range(n)]
    odd = [(900, None, 1), (901, [None] * d, 1), (902, [float("nan")] * d, 1), (903, [float("inf")] + [0.0] * (d - 1), 1), (904, [], 1), (905, [1e30] * d, 1)]
    return rows + odd + [(None, rows[3][1], 2)], rows


def steps(rows):
    return np.floor(256 * np.array([r[1] for r in rows], float)).astype(np.int64)


def test_whitening_equals_an_eigendecomposition(spark):
    rows, kept = some_rows()
    kept = kept + [rows[-1]]
    x = steps(kept)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = fit - fit.mean(0)
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1], v[:, ::-1]
    for parts in (1, 7):
        out = whitening.whiten(spark, vectors(spark, rows, extra=True).repartition(parts)).collect()
        assert len(out) == 4 * len(kept) and {r["component"] for r in out} == {1, 2, 3, 4}
        by_id = {}
        for r in out:
            by_id.setdefault((r["vec_id"], r["component"]), r)
            assert r["n"] == n and abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-12 and r["identity_error"] < 1e-9
        for k in range(4):
            got = np.array([by_id[i, k + 1]["whitened"] for i, _, _ in kept])
            want = (x - fit.mean(0)) @ v[:, k] / np.sqrt(e[k])
            assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-9
        for (i, _, _), row in zip(kept, x):
            assert by_id[i, 1]["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(row, s))


def test_factors_merge_over_a_tree(spark):
    rows, kept = some_rows(n=200, d=8)
    fit = whitening.fit_list(spark, whole_vectors(vectors(spark, rows))).repartition(30)
    n, sums = whitening.exact_sums(fit, 8)
    r = whitening.triangle(fit, n, sums, 8)
    x = np.unique(steps(kept), axis=0)
    c = x - x.mean(0)
    assert n == len(x) and sums == x.sum(0).tolist() and np.allclose(r.T @ r, c.T @ c, rtol=1e-12)


def test_whitening_without_variance(spark):
    flat = [(k, [0.5, k / 4, 0.25, 0.0], 0) for k in range(6)]
    out = whitening.whiten(spark, vectors(spark, flat)).orderBy("vec_id", "component").collect()
    assert len(out) == 24 and out[0]["explained"] == 1.0
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in out) and out[0]["identity_error"] < 1e-12
    one = whitening.whiten(spark, vectors(spark, [(1, [0.5, 1.0], 0)] * 3)).collect()
    assert len(one) == 6 and all(r["n"] == 1 and r["deviation"] == 0 and r["whitened"] is None and r["identity_error"] is None for r in one)
    assert whitening.whiten(spark, vectors(spark, [])).collect() == []
    with pytest.raises(ValueError):
        whitening.whiten(spark, vectors(spark, [(1, [0.5, 1.0], 0), (2, [0.5], 0)]))


def test_deviation_beyond_64_bits_is_null():
    m = whitening.Whitening(1 << 40, [3 << 50, 1], np.zeros((2, 1)), np.ones(1), 1.0)
    assert m.deviations(np.array([[1 << 20, 5], [3 << 10, 0]])) == [None, 1]


def test_centred_keeps_digits_when_products_would_not_fit():
    x = np.array([[(1 << 27) + 1, -5]])
    n, sums = 1 << 36, [((1 << 27) << 36) + (1 << 35), -(5 << 36) + 7]
    assert np.allclose(whitening.centred(x, n, sums), [[0.5, -7 / n]], rtol=1e-6)


# 13


def brute_codes(rows, parts, entries=64, rounds=2):
    keep = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, steps([r])[0].tolist()))
    x = steps(keep)
    width = x.shape[1] // parts
    part = [[tuple(map(int, row[p * width : (p + 1) * width])) for p in range(parts)] for row in x]
    books = [[part[k][p] for k in range(min(entries, len(keep)))] for p in range(parts)]
    nearest = lambda a, p: min((sum((i - j) ** 2 for i, j in zip(a, c)), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        near = [[nearest(v[p], p)[1] for p in range(parts)] for v in part]
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p] for v, c in zip(part, near) if c[p] == k]
                if own:
                    books[p][k] = tuple(sum(c) // len(own) for c in zip(*own))
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, by_label = [], {}
    for (i, _, label), v in zip(keep, part):
        found = [nearest(v[p], p) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append([i, "".join(f"{k:02x}" for _, k in found), error, label])
    return sorted(((i, c, e, by_label[lab], digest) for i, c, e, lab in out), key=str)


@pytest.mark.parametrize("entries,parts", [(64, 16), (3, 4)])
def test_codes_equal_brute_force(spark, entries, parts):
    rows, kept = some_rows(n=260)
    kept = kept + [rows[-1], rows[-1]]
    want = brute_codes(kept, parts, entries)
    for n in (1, 9):
        df = vectors(spark, rows + [rows[-1]], extra=True).repartition(n)
        assert sorted(map(tuple, vector_codes.compress(spark, df, parts=parts, entries=entries).collect()), key=str) == want


def test_codes_of_few_and_no_rows(spark):
    few = [(5, [0.25, -0.5], 1), (None, [100000.0, 3.0], None), (5, [0.25, -0.75], 1)]
    got = sorted(map(tuple, vector_codes.compress(spark, vectors(spark, few), parts=2).collect()), key=str)
    assert got == brute_codes(few, 2)
    assert vector_codes.compress(spark, vectors(spark, [(1, None, 1)])).collect() == []
    with pytest.raises(ValueError):
        vector_codes.compress(spark, vectors(spark, few), parts=16)


def test_only_moved_parts_are_sent(spark):
    """The second round sends the sums of parts that moved: applied to the first round's, they make a full recount."""
    rows, _ = some_rows(n=260)
    state = whole_vectors(vectors(spark, rows), "label").withColumn("before", F.lit(None).cast("binary"))
    first = vector_codes.first_codebooks(state, 16, 64)
    books, last = vector_codes.fit_codebooks(spark, whole_vectors(vectors(spark, rows), "label"), rounds=1)
    second = vector_codes.assign(last, books)
    moved = second.where("before <> code")
    parts = sum(a != b for r in moved.collect() for a, b in zip(r["before"], r["code"]))
    delta = vector_codes.contributions(second, books)
    counts = delta.where("at = -1").agg(F.sum("delta"), F.sum(F.abs("delta"))).first()
    assert 0 < parts < 16 * last.count() / 2 and counts[0] == 0 and 0 < counts[1] <= 2 * parts
    full = lambda df: {tuple(r)[:3]: r["delta"] for r in df.groupBy("part", "entry", "at").agg(F.sum("delta").alias("delta")).where("delta <> 0").collect()}
    before = vector_codes.contributions(vector_codes.assign(state, first), books)
    again = vector_codes.contributions(second.withColumn("before", F.lit(None).cast("binary")), books)
    assert full(before.unionByName(delta)) == full(again)


def test_new_queries_equal_their_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    for name in ("op11_chat_template", "op13_delta_lloyd"):
        con = duckdb.connect()
        for t in ("conversations", "embeddings"):
            con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
        df = queries.queries()[name](spark, sf)
        cols = sorted(df.columns)
        want = sorted((tuple(r) for r in con.sql(f"select {', '.join(cols)} from ({queries.oracle_sql()[name]})").fetchall()), key=str)
        assert sorted((tuple(r) for r in df.select(*cols).collect()), key=str) == want
