"""As-of joins against brute force, with a key that spans many ranges."""

import random

import pytest

from weft.operators.asof import asof


def brute(left, right):
    out = []
    for i, k, t in left:
        near = [(t2, v) for k2, t2, v in right if k is not None and t is not None and k2 == k and t2 is not None and t2 <= t]
        out.append((i, k, t, max(near, key=lambda x: (x[0], x[1] is not None, x[1] or 0)) if near else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_asof_equals_brute_force(spark, ranges):
    r = random.Random(ranges)
    key = lambda: r.choice(["hot"] * 6 + ["a", "b", "c", None])
    time = lambda: r.choice([None, *range(40), *range(15)])
    left = [(k, key(), time()) for k in range(300)] + [(7, "hot", 3)] * 2
    right = [(key(), time(), r.choice([None, *range(9)])) for _ in range(200)] + [("hot", 5, 1)] * 60 + [("late", 99, 1)]
    got = asof(spark.createDataFrame(left, "id long, k string, t int"), spark.createDataFrame(right, "k string, t int, v int"), "k", "t", ranges)
    assert sorted(((x["id"], x["k"], x["t"], tuple(x["found"]) if x["found"] else None) for x in got.collect()), key=str) == brute(left, right)


def test_asof_of_nothing(spark):
    left, right = spark.createDataFrame([(1, "a", 1)], "id long, k string, t int"), spark.createDataFrame([], "k string, t int, v int")
    assert asof(left, right, "k", "t").first()["found"] is None
    assert asof(left.limit(0), right, "k", "t").count() == 0
