"""Message sums that are the same bits in any order."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import message_passing as mp


def program(spark, seed, n=60, m=1200, hub=0.5):
    r = random.Random(seed)
    number = lambda: float(np.float32(r.choice([r.uniform(-1, 1), r.uniform(-1, 1) * 10.0 ** r.randint(-20, 15), 0.0, 1e-40])))
    nodes = [(f"n{k}", ["t"], [number(), number()]) for k in range(n)]
    relations = [(f"r{k}", r.choice("abc"), f"n{r.randrange(n)}", "n0" if r.random() < hub else f"n{r.randrange(n)}", number()) for k in range(m)]
    return spark.createDataFrame(nodes, mp.NODES), spark.createDataFrame(relations, mp.RELATIONS), nodes, relations


LAYER = mp.Layer(2, 2, {"a": [[0.3, -1.7], [2.2, 0.1]], "b": [[1.1, 0.7], [-0.9, 3.3]], "c": [[-0.2, 0.6], [0.4, -2.1]]}, [[0.5, 0.25], [1.5, -0.75]], [0.1, -0.2])


@pytest.mark.parametrize("value", [1.0, -1.0, 0.1 * 3, 2.0**-298, -(2.0**-290) * 1.5, 3.4e38 * 3.4e38, 2.0**24, 2.0**24 - 1, -(2.0**48), 2.0**-24, 1e-30, 123456.789, float(np.float32(0.1)) * float(np.float32(1e-20))])
def test_bins_add_up_to_the_term(spark, value):
    a = float(np.float32(value)) if abs(value) < 3e38 and abs(value) > 1e-37 else value
    got = spark.range(1).select(mp.binned(F.lit(a)).alias("b")).first()["b"]
    assert sum(Fraction(x["m"]) * Fraction(2) ** (mp.BIN_BITS * x["k"]) for x in got) == Fraction(a)
    assert all(abs(x["m"]) < 2 ** (mp.BIN_BITS + 1) for x in got)


def test_exact_sums_are_near_the_true_ones(spark):
    nodes, relations, n, r = program(spark, 1)
    x = {k: v for k, _, v in n}
    got = {(s["dst"], s["type_key"]): list(s["sums"]) for s in mp.exact_messages(nodes, relations, 2).collect()}
    want: dict = {}
    for _, t, a, b, w in r:
        want.setdefault((b, t), [Fraction(0), Fraction(0)])
        for i in range(2):
            want[b, t][i] += Fraction(w) * Fraction(x[a][i])
    assert set(got) == set(want)
    for key, sums in want.items():
        for a, b in zip(got[key], sums):
            assert abs(Fraction(a) - b) <= abs(b) * Fraction(1, 2**50) + Fraction(2) ** -320


def test_layers_are_bit_equal_on_any_partitions(spark):
    nodes, relations, _, _ = program(spark, 2)
    seen = set()
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 7, 211):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            rows = mp.exact_messages(nodes.repartition(n), relations.repartition(min(n, 40)).orderBy(F.rand(n)), 2).collect()
            seen.add(tuple(sorted((x["dst"], x["type_key"], *(v.hex() for v in x["sums"])) for x in rows)))
            y = mp.apply_layer(nodes.repartition(n), relations.repartition(min(n, 40)), LAYER, exact=True).collect()
            seen.add(tuple(sorted((x["key"], *(float(v).hex() for v in x["y"])) for x in y)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(seen) == 2


def test_exact_layer_edges(spark):
    nodes, relations, _, _ = program(spark, 3, n=5, m=9)
    plain = {x["key"]: x["y"] for x in mp.apply_layer(nodes, relations, LAYER).collect()}
    exact = {x["key"]: x["y"] for x in mp.apply_layer(nodes, relations, LAYER, exact=True).collect()}
    assert set(plain) == set(exact) and all(np.allclose(plain[k], exact[k], rtol=1e-5) for k in plain)
    assert mp.apply_layer(nodes, relations.limit(0), LAYER, exact=True).count() == 5
    with pytest.raises(Exception, match="not finite"):
        mp.exact_messages(nodes, relations.withColumn("w", F.lit(float("inf")).cast("float")), 2).collect()
