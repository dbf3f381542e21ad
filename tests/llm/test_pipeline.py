"""The pipeline against a brute-force version of its stages, and on planted cases."""

import os
import random

import corpus_pipeline
from tests.llm.test_operators import SF, brute_groups, brute_hits
from weft.llm import quality_rules


def stages(spark, docs, sf_dir, tmp_path):
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(path := str(tmp_path / str(k)))
        out.append(spark.read.parquet(path))
    return out


def test_stages_on_the_test_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = stages(spark, docs, SF, tmp_path)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and all(x.columns == docs.columns for x in got[1:5])
    rows = [{x["doc_id"]: x["text"] for x in df.collect()} for df in got[:5]]
    judged = {x["doc_id"]: x["kept"] for x in quality_rules.judge(docs, quality_rules.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    assert set(rows[1]) == {i for i, k in judged.items() if k}
    # Lines: every kept text is the input's lines with some left out; what went stands in an earlier document.
    earlier: set[str] = set()
    for i in sorted(rows[1]):
        lines, left = rows[1][i].split("\n"), rows[2].get(i, "").split("\n") if i in rows[2] else []
        it = iter(lines)
        assert all(x in it for x in left)
        gone = [x for x in lines if x not in left]
        assert all(x in earlier for x in gone)
        earlier.update(lines)
    groups = brute_groups(sorted(rows[2].items()))
    assert set(rows[3]) == {g[0] for g in groups}
    items = [tuple(x) for x in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(rows[4]) == {i for i, t in rows[3].items() if not brute_hits(t, items)[1]}
    last = got[5].collect()
    assert {x["doc_id"] for x in last} == set(rows[4]) and all(x["round_trip"] for x in last)


def test_planted_cases(spark, tmp_path):
    r = random.Random(9)
    base = [x["text"] for x in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").orderBy("doc_id").collect()]
    good = [t for t in base if len(t.split()) > 80][:12]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    words = lambda n: " ".join("".join(r.choice("etaoinshr") for _ in range(5)) for _ in range(n)).capitalize() + "."
    clean = ["\n".join(words(25) for _ in range(6)) for _ in range(6)]
    passage = words(55)
    near = clean[0].split(" ")
    near[70] = "changed"
    rows = [(1000 + k, t) for k, t in enumerate(clean)] + [(1100, clean[1]), (1101, " ".join(near)), (1102, f"{words(30)}\n{passage}\n{words(30)}"), (1103, f"{words(30)}\n{passage}"), (1104, f"{words(30)}\n{item}\n{words(30)}")]
    docs = spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in rows + [(k, t) for k, t in enumerate(good)]], "doc_id long, text string, lang string, source string, n_chars long")
    got = stages(spark, docs, SF, tmp_path)
    kept = {x["doc_id"] for x in got[4].collect()}
    assert {1000 + k for k in range(6)} | {1102, 1103} <= kept
    assert not {1100, 1104} & kept
    text = {x["doc_id"]: x["text"] for x in got[2].collect()}
    assert passage in text[1102] and passage not in text[1103]


def test_run_gives_the_last_stage(spark):
    assert os.path.isdir(SF)
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns) and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, clashing names in another case; and no rows at all."""
    good = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars between 600 and 3000").orderBy("doc_id").limit(4).collect()
    rows = [(x["doc_id"], x["text"]) for x in good] + [(None, good[0]["text"]), (None, None), (77, None), (78, ""), (good[1]["doc_id"], good[1]["text"])]
    docs = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(rows)], "doc_id long, Text string, lang string, n_chars int")
    for c in ("text_hash", "at", "class_id", "kept", "__id", "bands", "h"):
        docs = docs.withColumn(c, docs["lang"])
    for name, some in (("some", docs), ("none", docs.limit(0))):
        os.makedirs(tmp_path / name)
        got = stages(spark, some, SF, tmp_path / name)
        assert all(x.columns == docs.columns for x in got[1:5]) and got[5].columns[:2] == ["doc_id", "n_tokens"]
        counts = [x.count() for x in got]
        assert counts == sorted(counts, reverse=True) and (counts[5] > 0) == (name == "some")
    assert {x["doc_id"] for x in spark.read.parquet(str(tmp_path / "some" / "2")).collect()} <= {i for i, _ in rows}
