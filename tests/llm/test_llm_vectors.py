"""Exact top-k and hard negatives against brute force: ties, repeated rows, shared and null ids, odd vectors, empty tables, passes and blocks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lucerna.llm import exact_topk, hard_negatives, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, row string, v string, block int"
NAN, INF = float("nan"), float("inf")


def some_rows():
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((6, 5))
    rows = [(i, [float(np.float32(x)) for x in centre[i % 6] + 0.3 * rng.standard_normal(5)], i % 4) for i in range(240)]
    rows += [(1000 + i, [0.5, 0.25, -0.5, 0.0, 1.0], 1) for i in range(40)]  # one vector many times
    rows += [(1000, [0.5, 0.25, -0.5, 0.0, 1.0], 1), (0, rows[0][1], 0), (0, rows[7][1], 2)]  # a repeated row; shared ids
    rows += [(None, rows[3][1], 1), (None, None, 1), (20, None, 2), (40, [], 1), (60, [], 0), (80, [1.0, None, 0.0, 0.0, 0.0], 1)]
    rows += [(100, [NAN] * 5, 1), (120, [INF] + [0.0] * 4, 1), (140, [1.0, 2.0], 3), (160, [2.0, 1.0], 2), (180, [0.0] * 5, 0), (200, rows[5][1], None)]
    return [(*r, "x", "y", 9) for r in rows]


def whole(rows):
    return [(i, [math.floor(256 * x) for x in v], label) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def first(scored, k):
    return sorted(scored, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:k]


def slow_top_k(rows, every, k):
    out = []
    for q, (i, v, _) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j) for c, (j, w, _) in enumerate(rows) if c != q and len(v) == len(w)]
        out += [(i, r + 1, j, s) for r, (s, j) in enumerate(first(scored, k))]
    return out


def slow_negatives(rows, every, positives, negatives):
    out = []
    rows = [r for r in rows if r[2] is not None]
    for q, (i, v, label) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for c, (j, w, other) in enumerate(rows) if c != q and len(v) == len(w)]
        for p, j, _ in first([s for s in scored if s[2] == label], positives):
            near = [s for s in scored if s[2] != label and 80 * p <= 100 * s[0] <= 100 * p]
            out += [(i, j, r + 1, n[1], p, n[0]) for r, n in enumerate(first(near, negatives))]
    return out


def key(r):
    return tuple((x is None, x or 0) for x in r)


@pytest.mark.parametrize("k,bins,per_pass", [(5, 512, 4096), (3, 4, 7), (400, 16, 50)])
def test_exact_top_k(spark, k, bins, per_pass):
    rows = some_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = exact_topk.exact_top_k(df, F.col("id") % 20 == 0, k=k, bins=bins, per_pass=per_pass).collect()
    assert sorted(map(tuple, got), key=key) == sorted(slow_top_k(whole(rows), 20, k), key=key)


@pytest.mark.parametrize("block_rows,file_rows,per_pass", [(512, 16384, 2048), (8, 32, 5)])
def test_hard_negatives(spark, block_rows, file_rows, per_pass):
    rows = some_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = hard_negatives.hard_negatives(df, F.col("id") % 10 == 0, block_rows=block_rows, file_rows=file_rows, per_pass=per_pass).collect()
    want = slow_negatives(whole(rows), 10, 5, 5)
    assert len(want) > 200 and sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_fewer_and_none(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_topk.exact_top_k(none, F.col("id") % 2 == 0).collect() == []
    assert hard_negatives.hard_negatives(none, F.col("id") % 2 == 0).collect() == []
    one = spark.createDataFrame([(2, [1.0], 0, "", "", 0)], SCHEMA)
    assert exact_topk.exact_top_k(one, F.col("id") % 2 == 0).collect() == []
    assert hard_negatives.hard_negatives(one, F.col("id") % 2 == 0).collect() == []


def test_products_beyond_doubles_are_exact():
    a, b = np.array([[2.0**31, 3.0], [1.0, 1.0]]), np.array([[2.0**30 + 1, -7.0]])
    assert vectors.inner_products(a, b).tolist() == [[2**31 * (2**30 + 1) - 21], [2**30 - 6]]
    with pytest.raises(OverflowError):
        vectors.inner_products(np.array([[2.0**40]]), np.array([[2.0**40]]))


def test_bounds_hold_every_product():
    rng = np.random.default_rng(5)
    q, m = np.floor(rng.normal(0, 90, (20, 7))), np.floor(rng.normal(5, 90, (50, 7)))
    least, most = hard_negatives.score_bounds(q, m.min(axis=0), m.max(axis=0))
    scores = q @ m.T
    assert (least <= scores.min(axis=1)).all() and (most >= scores.max(axis=1)).all()


def test_zone_maps_leave_blocks_unread(spark):
    """Three far groups of one label each: an anchor's positives come from the blocks around it."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in (np.eye(3)[i % 3] * 5 + 0.05 * rng.standard_normal(3))], 0, "", "", 0) for i in range(600)]
    whole_rows = vectors.whole_vectors(spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id as id", "embedding as x", "cast(label as long) as label"))
    blocks = hard_negatives.Blocks(whole_rows, 50, 200)
    asked = next(vectors.passes(whole_rows, F.col("id") == 0, 10))
    shared = spark.sparkContext.broadcast(asked)
    wanted = hard_negatives.reaching_blocks(blocks.zones, shared, np.array([20 * 256.0**2])).count()
    assert 4 <= wanted <= 6 < blocks.zones.count()
