"""What is dealt out between tasks, and that odd rows still give what plain loops say."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from allelia import queries
from allelia.operators import collapse, coupling
from allelia.params import Collapse


def plan(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def signum(x):
    return (x > 0) - (x < 0)


def test_reads_are_not_read_again_for_numbers_and_degrees(spark, sf_dir, capsys):
    found = plan(queries.hyper(spark, sf_dir, "cap").drop("path", "signs"), capsys)
    assert "l_orderkey" not in found  # the reads three times over, before
    assert "Exchange hashpartitioning" not in found  # few blocks: the patterns stay where they are


def test_patterns_meet_their_blocks_between_two_exchanges_where_blocks_are_many(spark, sf_dir, capsys):
    limit = "spark.sql.autoBroadcastJoinThreshold"
    few = sorted(map(tuple, queries.hyper(spark, sf_dir, "cap").collect()))
    old = spark.conf.get(limit)
    try:
        spark.conf.set(limit, "-1")
        m = queries.hyper(spark, sf_dir, "cap")
        found = plan(m.drop("path", "signs"), capsys)
        assert found.count("Exchange hashpartitioning(block") == 2 and "path#" not in found.partition("Exchange hashpartitioning(block")[0]
        assert sorted(map(tuple, m.collect())) == few
    finally:
        spark.conf.set(limit, old)


@pytest.mark.parametrize("numbered_first", [True, False])
def test_patterns_of_odd_rows(spark, numbered_first):
    """Reads without a name, with nulls and zeros, reads of one block, twice the same rows, a block without a number."""
    rnd = random.Random(3)
    rows = [(rnd.choice([None, *range(60)]), rnd.choice([None, 0, 1, 2, 3]), rnd.choice([None, 0.0, -2.0, -1.0, 1.0, 3.0])) for _ in range(150)]
    rows += rows[:40]
    at, seen = defaultdict(dict), {}
    for read, block, v in rows:
        at[read][block] = v if at[read].get(block) is None else at[read][block] + (v or 0)
    for vals in at.values():
        path = sorted((b for b, v in vals.items() if v), key=lambda b: (b is not None, b))
        if len(path) > 1:
            first = signum(vals[path[0]])
            key = tuple(path), tuple(signum(vals[b]) * first for b in path)
            raw, n = seen.get(key, ([0] * len(path), 0))
            seen[key] = [x + vals[b] * first for x, b in zip(raw, path)], n + 1
    order = {k: i for i, k in enumerate(sorted(seen, key=lambda k: [[(x is not None, x) for x in part] for part in k]))}
    total, degree = defaultdict(float), defaultdict(int)
    for (path, _), (raw, _) in seen.items():
        for b, x in zip(path, raw):
            total[b] += abs(x)
            degree[b] += 1
    want = sorted((order[k], b, raw, k[1][i], n, len(k[0]), degree[b], abs(raw) / total[b]) for k, (raws, n) in seen.items() for i, (b, raw) in enumerate(zip(k[0], raws)) if b is not None)
    projected = spark.createDataFrame(rows, "read_id long, block int, v double").groupBy("read_id", "block").agg(F.sum("v").alias("v")).where("v <> 0")
    pats = collapse.patterns(collapse.read_vectors(projected))
    m = collapse.hyper_matrix(collapse.pattern_ids(pats), Collapse(norm="sum")) if numbered_first else collapse.pattern_ids(collapse.hyper_matrix(pats, Collapse(norm="sum")))
    got = sorted((r.hyper, r.block, r.raw, r.signs[r.path.index(r.block)], r.reads, r.degree, r.block_degree, r.domination) for r in m.collect())
    assert any(None in p for p, _ in seen) and len(got) == len(want) > 30
    for a, b in zip(got, want):
        assert a == pytest.approx(b)


def test_no_patterns(spark):
    none = spark.createDataFrame([(1, 0, 1.0), (2, 3, 1.0)], "read_id long, block int, v double")
    m = collapse.hyper_matrix(collapse.pattern_ids(collapse.patterns(collapse.read_vectors(none))))
    assert m.count() == 0 and {"hyper", "value", "domination"} <= set(m.columns)


def test_scores_of_candidates_over_odd_rows(spark):
    """Repeated rows, nulls, blocks and patterns that only one side has; against a plain loop over all triples."""
    rnd = random.Random(5)
    some = lambda n, *values: [tuple(rnd.choice(v) for v in values) for _ in range(n)]
    ids, blocks, cands, signs = [None, *range(12)], [None, *range(5)], [None, 0, 1, 2], [None, -1, 1]
    hyper = some(60, ids, blocks, [None, 0.0, 0.5, -1.5, 2.0])
    samples, eta = some(25, blocks, cands, signs), [*some(50, ids, cands, signs), (40, 3, 1)]
    samples += samples[:4] + [(0, 7, 1), (9, 3, 1)]
    eta += eta[:6]
    soft = [(0, 1, 0.5), (1, 2, -2.0), (None, 2, 1.0), (0, 2, None), (3, 77, 1.0)]
    want, eq = {}, lambda a, b: a is not None and a == b

    def add(cand, *factors):
        want[cand] = want.get(cand, 0.0) + (0.0 if None in factors else factors[0] * factors[1] * factors[2])

    for h, b, v in hyper:
        for sb, c, z in samples:
            for eh, ec, s in eta:
                if eq(h, eh) and eq(b, sb) and eq(c, ec):
                    add(c, v, z, s)
    for left, right, w in soft:
        for lb, c, z in samples:
            for rb, rc, y in samples:
                if eq(left, lb) and eq(right, rb) and eq(c, rc):
                    add(c, w, z, y)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = coupling.compressed_score(frame(hyper, "hyper long, block int, value double"), frame(soft, "l int, r int, coeff double"), frame(samples, "block int, cand int, z int"), frame(eta, "hyper long, cand int, s int"))
    assert len(want) >= 3 and {r.cand: r.score for r in found.collect()} == {c: pytest.approx(v) for c, v in want.items()}
