"""Exact inner products of large components: against Python's whole numbers, or an error."""

import math
import random

import pytest
from pyspark.errors import PySparkException

from caseloom.llm import vectors


def plain(rows, k=5):
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    out = []
    for q in whole:
        if q % 50 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def found(spark, rows, **how):
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(tuple(r) for r in vectors.top_products(d, **how).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("size", [1.0, 1e5, 1e6])
def test_scores_are_exact(spark, size):
    rng = random.Random(int(size))
    rows = [(i, [size * rng.uniform(-1, 1) for _ in range(6)]) for i in range(160)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, bucket=16, block=2) == plain(rows)


def test_products_beyond_a_long_cancel_exactly(spark):
    big = 1e12
    rows = [(0, [big, big, 1.0]), (1, [big, -big, 3.0]), (2, [-big, big, 5.0]), (3, [big, -big - 1 / 256, 2.0]), (4, [-big, -big, 0.0]), (5, [-2 * big, big, 0.0])]
    assert found(spark, rows, k=3) == plain(rows, 3)
    assert found(spark, rows, k=3)[0] == (0, 1, 2, 256 * 5 * 256)


def test_what_no_long_holds_is_an_error(spark):
    with pytest.raises(PySparkException, match="does not fit a long"):
        found(spark, [(0, [1e12, 1.0]), (1, [1e12, 2.0])])
    with pytest.raises(PySparkException, match="does not fit a long"):
        found(spark, [(0, [1e17, 1.0]), (1, [1.0, 2.0])])
    rows = [(0, [1.0, 1.0]), (1, [2.0, 2.0]), (2, [float("nan"), 1e300]), (3, [None, 1e300])]
    assert found(spark, rows) == [(0, 1, 1, 256 * 256 * 4)]
