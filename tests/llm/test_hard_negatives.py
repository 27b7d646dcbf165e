"""Hard negatives against plain sorting of all scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from quercus.llm import hard_negatives as H

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()),
        T.StructField("score", T.StringType()), T.StructField("row", T.StringType()), T.StructField("anchor", T.StringType()),
    ]
)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def brute(rows, every=50):
    usable = []
    for place, (i, v, label) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((place, i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for place, i, label, q in usable:
        if i % every:
            continue
        scored = [(-sum(x * y for x, y in zip(q, other, strict=False)), j, p, lab) for p, j, lab, other in usable if p != place]
        for score, j, _, _ in sorted(s for s in scored if s[3] == label)[:5]:
            inside = sorted(s for s in scored if s[3] != label and -50 * score <= -100 * s[0] <= -95 * score)[:3]
            out += [(i, j, rank, n, -score, -s) for rank, (s, n, _, _) in enumerate(inside, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def odd_vectors():
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0.05 * (i % 4), 0.2) for _ in range(20)], i % 4) for i in range(400)]
    rows += [(400 + i, list(rows[50 * i][1]), rows[50 * i][2] + 1) for i in range(5)]  # ties with the anchors themselves
    rows += [(1000, [0.1] * 5, 1), (1050, [0.2] * 40, 1), (1100, [], 1), (1101, [0.0] * 20, 2), (1150, [-0.3] * 20, 3), (50, rows[50][1], rows[50][2])]
    rows += [(None, [0.1] * 20, 1), (1200, None, 1), (1201, [0.1] * 20, None), (1250, [math.nan] * 20, 1), (1251, [0.1, None], 1), (1300, [math.inf] + [0.1] * 19, 2)]
    rows += [(7, rows[7][1], 9), (7, rows[7][1], 9)]
    return rows


def test_mine_is_brute_force(spark, ws, odd_vectors):
    expected = brute(odd_vectors)
    assert len(expected) > 50
    assert sorted(map(tuple, H.mine(table(spark, odd_vectors), ws).collect())) == expected
    # several blocks of anchors and of vectors, and tiles that end anywhere
    assert sorted(map(tuple, H.mine(table(spark, odd_vectors).repartition(7), ws, anchor_bytes=1200).collect())) == expected


def test_large_components(spark, ws):
    rng = random.Random(2)
    for scale in (40.0, 3e4, 3e6):  # scores within single, double and integer precision
        rows = [(i, [rng.uniform(0, scale) for _ in range(8)], i % 3) for i in range(101)]
        assert sorted(map(tuple, H.mine(table(spark, rows), ws).collect())) == brute(rows)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    import pyarrow as pa

    def vectors(n, low):
        x = (rng.normal(size=(n, 64)) + np.linspace(low, -low, 64)) * 50
        flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * 64), pa.array(x.astype(np.int64).ravel()))
        return H.Vectors.of(np.arange(n), np.arange(n), np.zeros(n, np.int64), flat)

    rows, anchors = vectors(500, 6), vectors(20, 6)
    exact = rows.x.astype(np.int64) @ anchors.x.astype(np.int64).T
    left = []
    for (mean, deviation), (mean_a, deviation_a) in zip(rows.levels(), anchors.levels(), strict=True):
        middle, reach = mean @ mean_a.T, deviation @ deviation_a.T
        assert (middle - reach <= exact + 0.5).all() and (exact <= middle + reach + 0.5).all()
        left.append(int((middle + reach >= np.quantile(exact, 0.999)).sum()))
    assert left[0] >= left[1] >= left[2] and left[2] < left[0]
    bar = np.full(20, np.quantile(exact, 0.99).astype(np.int64))
    i, j, score = H.bounded_pairs(rows, anchors, rows.levels(), anchors.levels(), slice(0, 500), slice(0, 20), bar, np.full(20, H.NEVER))
    wanted = np.argwhere(exact >= bar)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(map(tuple, wanted.tolist())) and (exact[i, j] == score).all()


def test_nothing_to_mine(spark, ws):
    assert H.mine(table(spark, []), ws).collect() == []
    assert H.mine(table(spark, [(1, [0.5], 1), (2, [0.5], 1)]), ws).collect() == []
    assert H.mine(table(spark, [(50, [0.5], 1)]), ws).collect() == []
