"""Every registered query of the graph engine against its SQL."""

import json
import os

import pytest

from weft import catalog

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    value = lambda x: None if x is None else round(float(x), 6) if not isinstance(x, (str, bool)) else x
    return [columns[k] for k in order], sorted((tuple(value(r[k]) for k in order) for r in data), key=str)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, db, name):
    got = catalog.queries()[name](spark, SF)
    want = db.execute(catalog.oracle_sql()[name])
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows([c[0] for c in want.description], want.fetchall())


def test_flagship_and_backup(spark):
    assert catalog.flagship(spark, SF).columns == ["x", "score", "matched_by"]
    lines = catalog.queries()["backup_document"](spark, SF).orderBy("part", "gid").collect()
    document = json.loads("".join(x["line"] for x in lines))
    assert document["version"] == 1 and len(document["nodes"]) + len(document["edges"]) + 3 == len(lines)


def test_vectors_are_scaled_in_their_own_precision(spark, tmp_path):
    """0.3195 lies below 319.5 thousandths as a double and on it as a float, which is what the table and its SQL hold."""
    spark.createDataFrame([(k, [0.3194999992847443] + [0.25] * 63) for k in range(3)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    name = "mp_embeddings_self_transform"
    assert sorted(map(tuple, catalog.queries()[name](spark, str(tmp_path)).collect())) == sorted(con.execute(catalog.oracle_sql()[name]).fetchall())
