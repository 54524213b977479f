"""Hard negatives against all scores; bounds that hold for any codebook."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from allelia.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, positives=5, most=3):
    kept = []
    for n, (i, x, label) in enumerate(rows):
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        kept.append((n, i, label, [math.floor(256 * float(np.float32(c))) for c in x]))
    big = 2**63 - 1
    out = []
    for a in kept:
        if a[1] is None or a[1] % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(a[3], b[3])), big if b[1] is None else b[1], b[0], b[2]) for b in kept if b[0] != a[0])
        for s, pid, _, _ in [x for x in scored if x[3] == a[2]][:positives]:
            hard = [x for x in scored if x[3] != a[2] and -50 * s <= -100 * x[0] <= -95 * s][:most]
            out += [(a[1], pid, r + 1, x[1], -s, -x[0]) for r, x in enumerate(hard)]
    return sorted(out)


def table(n=400, width=12, seed=1):
    rnd = np.random.default_rng(seed)
    centre = rnd.normal(size=(10, width))
    rows = [(i, (centre[i % 3] + rnd.normal(size=width)).astype(np.float32).tolist(), int(rnd.integers(10)) if i % 5 else 0) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [1.0] * width, None), (n + 2, [float("nan")] * width, 1), (n + 3, [None] * width, 1), (n + 4, [float("inf")] * width, 1), (n + 5, [0.5, 0.25], 0), (n + 6, [], 0)]
    rows += [(50, rows[50][1], rows[50][2]), (None, rows[3][1], 2)] + [(1000 + i, rows[50][1], i % 4) for i in range(120)]  # copies and ties
    return rows


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("v", "num", "block", "score", "rank")})
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in negatives.mine(negatives.usable(df).withColumn("label", shifted), **how).collect())


@pytest.mark.parametrize("how", [{}, {"block": 40, "parts": 5, "centroids": 3, "train_rows": 20}, {"parts": 12, "centroids": 1}])
def test_all_scores(spark, how):
    rows = table()
    assert run(spark, rows, **how) == plain(rows)


def test_query(spark, sf_dir):
    from allelia.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted(tuple(r) for r in queries.op13_hard_negatives(spark, sf_dir).collect())
    assert got and got == plain(rows)


def test_few_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 1)]) == [] and run(spark, [(50, [1.0], 1), (51, [1.0], 1), (52, [0.9], 2)]) == [(50, 51, 1, 52, 65536, 58880)]


def test_too_large_a_component(spark):
    with pytest.raises(Exception, match="must be under"):
        run(spark, [(50, [1e9], 1), (51, [1.0], 1)])


def test_bounds_hold_and_prune():
    rnd = np.random.default_rng(5)
    v, q = rnd.integers(-300, 300, (500, 16)).astype(np.int32), rnd.integers(-300, 300, (9, 16)).astype(np.int32)
    exact = v.astype(np.int64) @ q.T.astype(np.int64)
    spread = []
    for centroids in (1, 8, 256):
        book = negatives.trained(v, 8, centroids)
        low, high = negatives.Coded(v, *negatives.encoded(v, book), book).bounds(q)
        assert (low <= exact).all() and (exact <= high).all()
        spread.append((high - low).mean())
    assert spread[0] > 2 * spread[1] > 3 * spread[2]
